"""Importance resampling towards a target distribution (operator 11).

Features are hashed into buckets; the gain of a bucket compares its share in
the target texts with its share in all documents. The gains are one array, a
document's weight the mean over its features. A fixed share of the documents
is drawn by weight plus Gumbel noise: exact count jobs over the stored scores
narrow the cutoff, first by score, then by id among the documents that tie
there, and only the drawn rows are range-partitioned for their ranks.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlytics.llm import text as TX
from churnlytics.llm.common import store

BUCKETS = 10_000
WORDS = 2          # words of the longest feature
LEAST_WORDS = 20   # of a document that can be drawn
PERCENT = 25
SEED = 7
WAYS = 16          # parts into which one count job splits the cutoff's range; 2 halves it
LAST = (1 << 63) - 1


def feature_buckets(raw: bytes, split: bytes, buckets: int = BUCKETS, longest: int = WORDS) -> tuple[np.ndarray, int]:
    """(bucket of every feature, number of words) of a text's UTF-8 bytes: all
    runs of 1 to ``longest`` words, joined by a space, repeats included."""
    words = raw.translate(split).split()
    crcs = state = [zlib.crc32(w) for w in words]
    spaced = [b" " + w for w in words]
    for k in range(1, longest):
        # A run's checksum goes on from that of the run one word shorter.
        state = [zlib.crc32(w, c) for w, c in zip(spaced[k:], state)]
        crcs = crcs + state
    return np.array(crcs, np.int64) % buckets, len(words)


def bucket_totals(texts: DataFrame, buckets: int = BUCKETS, longest: int = WORDS) -> np.ndarray:
    """Features in each bucket over all of ``texts(text)``: tasks count their
    texts, Spark adds the counts; only ``buckets`` numbers reach the driver."""

    def run(batches):
        split, total = TX.split_table(), np.zeros(buckets, np.int64)
        for part in TX.slices(batches, 0):
            for text in part.column(0):
                if text.is_valid:
                    got, _ = feature_buckets(text.as_py().encode("utf-8"), split, buckets, longest)
                    total += np.bincount(got, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of B buckets."""
    all_s, all_t, b = float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + b) / ((s + 1.0) * (all_t + b))))
                     for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, fixed by the id (a null id: as the empty one)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
           longest: int = WORDS, seed: int = SEED) -> DataFrame:
    """``(id, n_words, n_features, weight, score)`` of every row of ``docs``."""

    def run(batches):
        split = TX.split_table()
        for part in TX.slices(batches):
            n_words, n_features, weight, score = [], [], [], []
            for i, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                got, n = feature_buckets((text.as_py() or "").encode("utf-8"), split, len(gains), longest)
                w = int(gains[got].sum()) // len(got) if len(got) else 0
                n_words.append(n)
                n_features.append(len(got))
                weight.append(w)
                score.append(w + noise(i, seed))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(x, pa.int64()) for x in (n_words, n_features, weight, score)]],
                names=["id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, n_words long, n_features long, weight long, score long")


def bisected(rows: DataFrame, col: str, least: int, ways: int = WAYS) -> tuple[int, int]:
    """The smallest value v of the long ``col`` such that at least ``least`` of
    ``rows`` are at or below v, and how many are strictly below it. Every round
    is one job of exact counts that splits the range left into ``ways``."""
    lo, hi = rows.agg(F.min(col), F.max(col)).first()
    below = 0  # rows below lo
    while lo < hi:
        cuts = sorted({lo + (hi - lo) * k // ways for k in range(1, ways)} | {lo + (hi - lo) // 2})
        counts = rows.agg(*[F.count(F.when(F.col(col) <= c, 1)) for c in cuts]).first()
        for c, n in zip(cuts, counts, strict=True):
            if n >= least:
                hi = c
                break
            lo, below = c + 1, n
    return lo, below


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS,
             buckets: int = BUCKETS, longest: int = WORDS, seed: int = SEED, ways: int = WAYS) -> DataFrame:
    """Every row of ``docs``: its id, n_features, weight, score and rank, the
    place among the floor(``percent`` N / 100) highest scores of the N documents
    of ``least_words`` words or more (ties to the smaller id), null if not drawn.

    Two passes read the texts (counts, scores); all else works on the stored
    scores. Undrawn rows are not shuffled, ranks come from sorted ranges and
    the ranges' sizes.

    Defined cases: a null, empty or wordless text has no features, weight 0 and
    is not drawn (with ``least_words`` 0 it can be); a null id has the noise of
    the empty id and comes last among ties; rows that share an id are ranked
    one by one, those that tie even so in the order in which they were read;
    very long texts are read whole, one at a time; an empty table gives an
    empty result, an empty target the gains of a target without features; other
    columns are not read. Ids must be integers.
    """
    gains = bucket_gains(bucket_totals(docs.select(F.col(text_col).alias("text")), buckets, longest),
                         bucket_totals(target.select(F.col(target_col).alias("text")), buckets, longest))
    every = store(scored(docs, gains, id_col, text_col, longest, seed)
                  .withColumns({"able": F.col("n_words") >= least_words, "low": -F.col("score"),
                                "tie": F.coalesce("id", F.lit(LAST)), "row": F.monotonically_increasing_id()}))
    shown = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    able = every.where("able")
    most = percent * able.count() // 100
    if most == 0:
        return every.select(*shown, F.lit(None).cast("long").alias("rank"))
    cut, above = bisected(able, "low", most, ways)
    tie, _ = bisected(able.where(F.col("low") == cut), "tie", most - above, ways)
    drawn = F.col("able") & ((F.col("low") < cut) | ((F.col("low") == cut) & (F.col("tie") <= tie)))
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-most // 1_000_000), min(most // 1000, usual))
    order = ["low", "tie", "row"]
    ranges = store(every.where(drawn).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sizes = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = (ranges.withColumn("no", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
              .join(F.broadcast(offsets), "part")
              .withColumn("rank", (F.col("before") + F.col("no")).cast("long")))
    # Rows that repeat the last drawn one beyond the share stay undrawn.
    return (ranked.select(*shown, F.when(F.col("rank") <= most, F.col("rank")).alias("rank"))
            .unionByName(every.where(~drawn).select(*shown, F.lit(None).cast("long").alias("rank"))))


RESAMPLE_SQL = r"""
WITH texts AS (
  SELECT true AS own, row_number() OVER () AS no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL
  SELECT false, row_number() OVER (), NULL,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), runs AS (
  SELECT own, no, unnest(list_concat(words, list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1]))) AS f
  FROM texts
), features AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM runs)
), codes AS (
  -- CRC-32 bit by bit: a byte comes in, then eight shifts (-1)
  SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, len(h), 2),
           lambda k: list_concat([((strpos('0123456789ABCDEF', h[k]) - 1) * 16 + strpos('0123456789ABCDEF', h[k + 1]) - 1)::BIGINT],
                            [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) % 10000 AS bucket
  FROM features
), placed AS (
  SELECT own, no, bucket FROM runs JOIN codes USING (f)
), counts AS (
  SELECT bucket, count(*) FILTER (WHERE own) AS s, count(*) FILTER (WHERE NOT own) AS t FROM placed GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((sum(s) OVER ()) + 10000)::DOUBLE)
                                 / ((s + 1)::DOUBLE * ((sum(t) OVER ()) + 10000)::DOUBLE)))::BIGINT AS gain FROM counts
), weights AS (
  SELECT no, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight
  FROM placed JOIN gains USING (bucket) WHERE own GROUP BY no
), scores AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM (SELECT * FROM texts WHERE own) LEFT JOIN weights USING (no)
), ranks AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (WHERE n_words >= 20) OVER () AS n FROM scores
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank
FROM ranks
"""

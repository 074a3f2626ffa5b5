"""Filter interaction audit (operator 13): wide packed counters.

A document's failed filters are a bit mask. For a mask, what every step of
every order of the filters does with the document is fixed; those outcomes are
the fields of one wide integer, a field for each (counter, order, step). The
integers of a part are summed, in the tasks that read its documents and then
up a tree, and the sums' fields are the counts. A field has more bits than the
number of documents, so no field overflows into the next.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Callable, Mapping

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlytics.llm import text as TX
from churnlytics.llm.common import store

COUNTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
MOST_PARTS = 256  # sums that a task holds at once, and rows that one merge adds up
SIGNS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONTINUATION = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point


def few_words(raw: bytes, words: list[bytes]) -> bool:
    return len(words) < 200


def repetitive(raw: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def shouting(raw: bytes, words: list[bytes]) -> bool:
    return 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 3 * len(raw.translate(None, CONTINUATION))


def has_signs(raw: bytes, words: list[bytes]) -> bool:
    return len(raw) != len(raw.translate(None, SIGNS))


# Failure conditions on a text's UTF-8 bytes and its words (the runs between
# ASCII white space); the last letter is the exact duplicates.
TEXT_FILTERS: dict[str, Callable[[bytes, list[bytes]], bool]] = {
    "A": few_words, "B": repetitive, "C": shouting, "D": has_signs}
DUPLICATE = "E"


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
                  filters: Mapping[str, Callable[[bytes, list[bytes]], bool]] = TEXT_FILTERS) -> DataFrame:
    """``(id, part, mask)`` of every row of ``docs``: bit k stands for the k-th
    of ``filters``, the bit after them for an exact duplicate (some row with a
    smaller id has the same text). Null texts are empty, null parts the empty
    string; a null id is no duplicate and makes none."""

    def run(batches):
        for part in TX.slices(batches, 2):
            masks, digests = [], []
            for text in part.column(2):
                raw = (text.as_py() or "").encode("utf-8")
                words = raw.split()
                masks.append(sum(1 << k for k, f in enumerate(filters.values()) if f(raw, words)))
                digests.append(hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
                names=["id", "part", "mask", "digest"])

    rows = store(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(part_col, F.lit("")).alias("part"),
                             F.col(text_col).alias("text"))
                 .mapInArrow(run, "id long, part string, mask int, digest binary"))
    # Counted map-side; only texts that stand in several ids come back.
    first = (rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
             .where("first < last").select("digest", "first"))
    return rows.join(first, "digest", "left").select(
        "id", "part", F.col("mask").bitwiseOR(
            F.when(F.col("id") > F.col("first"), F.lit(1 << len(filters))).otherwise(0)).alias("mask"))


class Layout:
    """The fields of the packed integers: one for each counter, order and step."""

    def __init__(self, letters: str, bits: int):
        self.letters, self.bits = letters, bits
        self.orders = ["".join(p) for p in itertools.permutations(letters)]
        self.steps = len(letters)
        self.block = len(self.orders) * self.steps

    def shift(self, counter: int, order: int, step: int) -> int:
        return ((counter * len(self.orders) + order) * self.steps + step) * self.bits

    def packed(self, mask: int, good: bool, toxic: bool) -> int:
        """The integer of one document: a 1 in the field of every outcome."""
        out = 0
        for o, order in enumerate(self.orders):
            gone = False
            for s, letter in enumerate(order):
                bit = 1 << self.letters.index(letter)
                hit = {"kept": not gone and not mask & bit, "removed": not gone and bool(mask & bit),
                       "redundant": gone and bool(mask & bit), "unique_fails": mask == bit}
                gone |= hit["removed"]
                hit |= {"good_lost": hit["removed"] and good, "toxic_lost": hit["removed"] and toxic}
                for c, name in enumerate(COUNTERS):
                    if hit[name]:
                        out |= 1 << self.shift(c, o, s)
        return out

    def rows(self, total: int):
        """(order, step from 1, *counters, removals of the step's filter over
        all orders) of a sum of packed integers."""
        field = (1 << self.bits) - 1
        raw = total.to_bytes(len(COUNTERS) * self.block * self.bits // 8 + 1, "little")

        def at(counter: int, order: int, step: int) -> int:
            low = self.shift(counter, order, step)
            return int.from_bytes(raw[low // 8:(low + self.bits) // 8 + 1], "little") >> low % 8 & field

        shapley: dict[str, int] = defaultdict(int)
        found = []
        for o, order in enumerate(self.orders):
            for s, letter in enumerate(order):
                values = [at(c, o, s) for c in range(len(COUNTERS))]
                shapley[letter] += values[COUNTERS.index("removed")]
                found.append((order, s + 1, *values))
        return [(*row, shapley[row[0][row[1] - 1]]) for row in found]


def packed_sums(marked: DataFrame, layout: Layout) -> DataFrame:
    """``(part, total binary)``, one row a part: the sums of the packed
    integers of ``marked(part, mask, good, toxic)``."""

    def add(batches):
        known: dict[tuple, int] = {}
        sums: dict[str, int] = defaultdict(int)

        def out():
            no = TaskContext.get().partitionId()
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([no] * len(sums), pa.int64()),
                 pa.array([x.to_bytes(x.bit_length() // 8 + 1, "little") for x in sums.values()], pa.binary())],
                names=["part", "task", "total"])
            sums.clear()
            return batch

        for batch in batches:
            groups = pa.Table.from_batches([batch]).group_by(["part", "mask", "good", "toxic"]).aggregate([([], "count_all")])
            for row in groups.to_pylist():
                key = (row["mask"], row["good"], row["toxic"])
                if key not in known:
                    known[key] = layout.packed(*key)
                sums[row["part"]] += row["count_all"] * known[key]
                if len(sums) >= MOST_PARTS:
                    yield out()
        yield out()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(int.from_bytes(x, "little") for x in pdf["total"])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "task": pdf["task"].iloc[:1],
                             "total": [total.to_bytes(total.bit_length() // 8 + 1, "little")]})

    sums = store(marked.mapInArrow(add, "part string, task long, total binary"))
    while True:
        most = sums.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return sums.select("part", "total")
        branches = -(-most // MOST_PARTS)
        sums = store(sums.withColumn("branch", F.pmod(F.xxhash64("task", "total"), F.lit(branches)) if branches > 1 else F.lit(0))
                     .groupBy("part", "branch").applyInPandas(merge, "part string, task long, total binary"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "lang",
                 filters: Mapping[str, Callable[[bytes, list[bytes]], bool]] = TEXT_FILTERS) -> DataFrame:
    """What every step of every order of the filters does, one row per part
    (value of ``part_col``), filter_order and step, zeros included: kept after
    the step, removed here, redundant (fails the step's filter, removed
    earlier), unique_fails (fails that filter only), good_lost and toxic_lost
    (removed here though ``labels`` has quality 1, or toxic 1, for the id), and
    shapley, the step's filter's removals summed over all orders.

    Defined cases: a null or empty text has no words, so it fails A alone, and
    E if a smaller id has such a text too; a null part is the empty string; a
    row with a null id is counted, has no label and is no duplicate; rows that
    share an id count one by one and are no duplicates of each other; an id
    with several labels is good, or toxic, if one of them says so; very long
    texts are read whole, one at a time; an empty table gives no rows; other
    columns are not read. Ids must be integers.
    """
    letters = "".join(filters) + DUPLICATE
    masks = failure_masks(docs, id_col, text_col, part_col, filters)
    known = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
             .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")))
    marked = masks.join(known, "id", "left").select(
        "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    marked = store(marked)
    layout = Layout(letters, marked.count().bit_length() + 1)

    def unpack(batches):
        for batch in batches:
            for part, total in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = layout.rows(int.from_bytes(total, "little"))
                order, step, *counts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(rows), pa.string()), pa.array(order, pa.string()), pa.array(step, pa.int32()),
                     *[pa.array(c, pa.int64()) for c in counts]],
                    names=["part", "filter_order", "step", *COUNTERS, "shapley"])

    return packed_sums(marked, layout).mapInArrow(
        unpack, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*COUNTERS, "shapley")))


AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), firsts AS (
  SELECT text, min(doc_id) AS first_id FROM d GROUP BY text
), marks AS (
  SELECT w.part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
                  100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * length(w.text),
                  regexp_matches(w.text, '[#$%&*|]'), coalesce(w.doc_id > f.first_id, false)] AS fails,
         w.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good,
         w.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM w JOIN firsts f ON w.text = f.text
), masks AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic
  FROM marks GROUP BY part, fails
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT [a.l, b.l, c.l, d.l, e.l] AS o FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT o, unnest(range(1, 6)) AS step FROM orders
), hits AS (
  SELECT m.*, array_to_string(o, '') AS filter_order, step, o[step] AS letter,
         fails[ascii(o[step]) - 64] AS here,
         len(list_filter(o[1:step - 1], lambda x: fails[ascii(x) - 64])) > 0 AS gone,
         len(list_filter(fails, lambda x: x)) = 1 AS single
  FROM masks m, steps
), totals AS (
  SELECT part, filter_order, step, any_value(letter) AS letter,
         sum(CASE WHEN NOT gone AND NOT here THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN NOT gone AND here THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN gone AND here THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN here AND single THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN NOT gone AND here THEN n_good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN NOT gone AND here THEN n_toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM hits GROUP BY part, filter_order, step
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM totals
"""

"""Benchmark decontamination (operator 4): DataFrame functions only.

Each benchmark item gives its windows of ``n`` consecutive words. A window is
known by its longest word (the anchor); the table of windows is broadcast as a
hash table on the anchor, every word of every document probes it, and a probe
that meets an anchor is verified against all words of the window. The corpus
itself is never shuffled; only hits are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlytics.llm.common import UPPER, WORD_RE, neutral, store

# The same words, found before A-Z are lower-cased.
ANY_CASE_RE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 32 << 20


def words(col: Column) -> Column:
    """Words of a text after lower-casing A-Z; null has none."""
    low = F.translate(F.coalesce(col, F.lit("")), UPPER, UPPER.lower())
    return F.regexp_extract_all(low, F.lit(WORD_RE), F.lit(0))


def item_windows(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows ``(win array, anchor, back, items array<string>)``:
    ``back`` is the anchor's place in the window."""
    w = (benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
         .where("item IS NOT NULL AND size(w) > 0")
         .withColumn("n", F.least(F.size("w"), F.lit(n)))
         .withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
         .select("item", F.slice("w", F.col("i"), F.col("n")).alias("win"))
         .groupBy("win").agg(F.collect_set("item").alias("items")))
    best = F.array_max(F.transform("win", lambda x, i: F.struct(F.length(x).alias("l"), x.alias("x"),
                                                                (-i).alias("k"))))
    return (w.withColumn("best", best)
            .select("win", F.col("best.x").alias("anchor"), (-F.col("best.k")).alias("back"),
                    F.array_sort("items").alias("items")))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
              item_id: str = "item_id", item_text: str = "text",
              broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows with hits only: ``(id, key, n_hit, spans array<struct<start, until>>,
    items array<string>)``; ``key`` is the text's hash, so that rows which
    share an id but not a text stay apart.

    The windows' size is measured; beyond ``broadcast_bytes`` they are dealt
    into parts below it and the corpus is scanned once for each part.
    """
    win = store(item_windows(benchmark, n, item_id, item_text))
    size = win.agg(F.sum(F.aggregate("win", F.lit(160), lambda a, x: a + 24 + F.octet_length(x))
                         + 40 * F.size("items"))).first()[0] or 0
    parts = max(1, math.ceil(size / broadcast_bytes))
    pos = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"),
                      words(F.col(text_col)).alias("w")) \
              .select("id", "key", "w", F.posexplode("w").alias("pos", "word"))
    found = None
    for part in range(parts):
        some = win.where(F.pmod(F.xxhash64("win"), F.lit(parts)) == part) if parts > 1 else win
        hit = (pos.join(F.broadcast(some), F.col("word") == F.col("anchor"))
               .withColumn("start", F.col("pos") - F.col("back"))
               .where("start >= 0 AND start + size(win) <= size(w)")
               .where("slice(w, start + 1, size(win)) = win")
               .select("id", "key", "start", (F.col("start") + F.size("win")).alias("until"), "items"))
        found = hit if found is None else found.unionByName(hit)
    rows = found.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "until"))).alias("at"),
                                          F.collect_set("items").alias("items"))
    # Overlapping places become disjoint spans.
    spans = F.aggregate(
        "at", F.array().cast("array<struct<start:int,until:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["until"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["start"].alias("start"),
                F.greatest(F.element_at(acc, -1)["until"], x["until"]).alias("until")))))
        .otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["until"].alias("until"))))))
    return (rows.select("id", "key", spans.alias("spans"),
                        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
            .withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"),
                                             lambda a, s: a + s["until"] - s["start"])))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs``: the id, n_words, n_hit, n_items,
    items_sha256, contaminated.

    Defined cases: a null or empty text has no words; an item without words or
    without an id is not looked for; items of fewer than ``n`` words are one
    window; equal items count each by its own id; repeated rows are answered
    each; null ids are kept; other columns are not read; an empty benchmark
    leaves every document clean (items_sha256 is that of the empty string).
    """
    hits = find_hits(docs, benchmark, n, id_col, text_col, item_id, item_text, broadcast_bytes)
    d = docs.select(F.col(id_col).alias("did"), F.xxhash64(text_col).alias("dkey"),
                    F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(ANY_CASE_RE))
                    .cast("long").alias("n_words"))
    j = d.join(hits, F.col("did").eqNullSafe(F.col("id")) & (F.col("dkey") == F.col("key")), "left")
    return j.select(F.col("did").alias(id_col), "n_words",
                    F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
                    F.col("n_hit").isNotNull().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "document",
                  id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without contamination, with its own columns: ``mode`` 'document'
    leaves out rows with a hit, 'span' cuts the words that are hit (and the
    separators after them) out of the text. Cases as in ``contamination``."""
    if mode not in ("document", "span"):
        raise ValueError("mode is 'document' or 'span'")
    hits = find_hits(docs, benchmark, n, id_col, text_col, item_id, item_text, broadcast_bytes)
    plain = neutral(docs)
    own, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    on = own.eqNullSafe(hits["id"]) & (F.xxhash64(text) == hits["key"])
    if mode == "document":
        return plain.join(hits, on, "left_anti").toDF(*docs.columns)
    raw = F.regexp_extract_all(text, F.lit(ANY_CASE_RE), F.lit(0))
    gaps = F.split(text, ANY_CASE_RE)
    kept = F.transform(raw, lambda x, i: F.when(
        F.exists("spans", lambda s: (i >= s["start"]) & (i < s["until"])), F.lit(""))
        .otherwise(F.concat(x, F.element_at(gaps, i + 2))))
    cut = F.concat(F.element_at(gaps, 1), F.array_join(kept, ""))
    j = plain.join(hits, on, "left").withColumn("cut", F.when(F.col("key").isNull(), text).otherwise(cut))
    return j.select(*["cut" if c == text_col else f"c{k}" for k, c in enumerate(docs.columns)]).toDF(*docs.columns)


CONTAMINATION_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0),
hit AS (
  SELECT r, i, n, item_id
  FROM (SELECT r, i, k.n, list_slice(w, i, i + k.n - 1) AS s
        FROM pos, (SELECT DISTINCT n FROM win) k WHERE i + k.n - 1 <= len(w)) p
  JOIN win USING (n) WHERE p.s = win.win),
n_hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN items USING (r)
"""

"""Substring dedup (operator 8): content-defined chunks, deduplicated by digest.

A 32-bit gear hash rolls over the bytes of each text (so it depends on the last
32 bytes). A word end is a boundary where its gear hash is the least among the
three word ends on either side: chunks are whole words, 7 on average and 4 at
least (but at a text's ends), and an insertion moves only the boundaries near it.
Chunks travel as 128-bit digests; of each digest the occurrence in the smallest
document id is the keeper. Consecutive chunks whose keepers are consecutive in
one text form a run, and a run is extended word by word against the keeper's
text, so that the whole passage is known and not only its whole chunks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlytics.llm import text as TX
from churnlytics.llm.common import neutral, store

SIDE = 3          # word ends compared on either side of a boundary
MOST_WORDS = 64   # of a chunk; only text without minima (a repeated word) gets there
WINDOW = 32       # bytes of the gear hash
MIN_RUN = 8       # words of whole common chunks from which a run is extended
MIN_WORDS = 40    # of a passage that is cut out; below the 50 sought, as words are counted in more than one way
# Words that two texts can share beyond a run. Boundaries agree from the window
# and SIDE words behind a passage's beginning on (a word has a byte and a
# separator at least) up to SIDE words before its end, then a chunk may be open.
BEFORE = WINDOW // 2 + SIDE + MOST_WORDS
AFTER = SIDE + MOST_WORDS
BROADCAST_BYTES = 32 << 20
EMIT = 4096       # contexts in an Arrow batch


def gear_table() -> np.ndarray:
    return (TX.byte_values(7) >> np.uint64(32)).astype(np.uint32)


def gear_at(data: np.ndarray, off: np.ndarray, table: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Gear hash of each text after its byte ``at`` (h = 2h + table[byte], from
    0 at the text's beginning), by doubling the window."""
    pad = WINDOW
    h = np.zeros(len(data) + pad * len(off), np.uint32)
    for k in range(len(off) - 1):
        a, b = off[k], off[k + 1]
        h[a + pad * (k + 1):b + pad * (k + 1)] = table[data[a:b]]
    step = 1
    while step < WINDOW:
        nxt = h.copy()
        nxt[step:] += h[:-step] << np.uint32(step)
        h = nxt
        step *= 2
    return h[at + pad * (doc + 1)]


@dataclass
class Chunks:
    """Words and chunks of a string array; a chunk reaches from its first word
    to its last. ``own`` is the text of a chunk, ``first[k]:first[k + 1]`` are
    the chunks and ``words[k]:words[k + 1]`` the words of text k."""
    data: np.ndarray
    start: np.ndarray   # byte of each word
    end: np.ndarray
    hash: np.ndarray
    words: np.ndarray
    own: np.ndarray
    begin: np.ndarray   # first word of each chunk
    last: np.ndarray    # last word of each chunk
    first: np.ndarray


def chunks(hasher: TX.WordHasher, table: np.ndarray, col: pa.Array) -> Chunks:
    data, off, start, end, h, first = TX.doc_words(hasher, col)
    n = len(start)
    if not n:
        z = np.zeros(0, np.int64)
        return Chunks(data, z, z, h, first, z, z, z, np.zeros(len(col) + 1, np.int64))
    doc = np.repeat(np.arange(len(col)), np.diff(first))
    g = gear_at(data, off, table, end - 1, doc).astype(np.int64)
    # Word ends of other texts count as larger than any.
    v = np.full(n + SIDE * (len(col) + 1), 1 << 40, np.int64)
    at = np.arange(n) + SIDE * (doc + 1)
    v[at] = g
    low = np.ones(n, bool)
    for j in range(1, SIDE + 1):
        low &= (g < v[at - j]) & (g <= v[np.minimum(at + j, len(v) - 1)])
    low[first[1:][np.diff(first) > 0] - 1] = True  # a text's last word
    last = np.flatnonzero(low)
    begin = np.empty(len(last), np.int64)
    begin[0] = 0
    begin[1:] = last[:-1] + 1
    size = last - begin + 1
    if size.max() > MOST_WORDS:
        times = -(-size // MOST_WORDS)
        no = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        begin = np.repeat(begin, times) + no * MOST_WORDS
        last = np.minimum(begin + MOST_WORDS - 1, np.repeat(last, times))
    own = doc[begin]
    return Chunks(data, start, end, h, first, own, begin, last, np.searchsorted(own, np.arange(len(col) + 1)))


def chunk_rows(docs: DataFrame) -> DataFrame:
    """``(hi, lo, id, th, place)`` of ``docs(id, th, text)``; ``place`` holds the
    chunk's number and its words (8 bits)."""

    def run(batches):
        hasher, table = TX.WordHasher(), gear_table()
        for part in TX.slices(batches, 2):
            c = chunks(hasher, table, part.column(2))
            raw = c.data.tobytes()
            digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest()
                               for a, b in zip(c.start[c.begin].tolist(), c.end[c.last].tolist(), strict=True))
            both = np.frombuffer(digests, np.int64).reshape(-1, 2)
            place = ((np.arange(len(c.own)) - c.first[c.own]) << 8) | (c.last - c.begin + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()),
                 part.column(0).take(pa.array(c.own)), part.column(1).take(pa.array(c.own)), pa.array(place)],
                names=["hi", "lo", "id", "th", "place"])

    return docs.where("id IS NOT NULL").mapInArrow(run, "hi long, lo long, id long, th long, place long")


def common_runs(docs: DataFrame, min_run: int) -> DataFrame:
    """``(id, th, kid, kth, shift, lo, hi)``: the chunks lo to hi of text
    (id, th) are the chunks lo - shift to hi - shift of their keeper (kid, kth),
    with ``min_run`` words or more. A keeper comes earlier by (id, th, chunk)."""
    rows = chunk_rows(docs).withColumn("no", F.expr("shiftright(place, 8)"))
    # Counted map-side first, so that a chunk of a third of all texts is one row a task.
    known = (rows.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "th", "no")).alias("k"))
             .where("c > 1"))
    again = (rows.join(known, ["hi", "lo"]).where("NOT (id = k.id AND th = k.th AND no = k.no)")
             .select("id", "th", F.col("k.id").alias("kid"), F.col("k.th").alias("kth"),
                     (F.col("no") - F.col("k.no")).alias("shift"), "no", (F.col("place") % 256).alias("n")).distinct())
    key = ["id", "th", "kid", "kth", "shift"]
    # Consecutive chunks at one shift; at most a text's chunks are a group.
    run = again.withColumn("run", F.col("no") - F.row_number().over(Window.partitionBy(*key).orderBy("no")))
    return (run.groupBy(*key, "run").agg(F.min("no").alias("lo"), F.max("no").alias("hi"), F.sum("n").alias("n"))
            .where(F.col("n") >= min_run).drop("run", "n"))


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(id, th, at, word, near array<long>)`` of ``docs(id, th, text)`` for
    the ``at`` in ``wanted(id, th, at array<long>)``: twice a chunk's number,
    plus 1 for its end. ``near`` are hashes of the words before the chunk or
    behind it, the nearest first; ``word`` is the place of the edge."""
    j = docs.join(wanted, ["id", "th"]).select("id", "th", "text", "at")

    def run(batches):
        hasher, table = TX.WordHasher(), gear_table()
        for part in TX.slices(batches, 2):
            c = chunks(hasher, table, part.column(2))
            h, at = c.hash.view(np.int64), part.column(3)
            every = np.repeat(np.arange(part.num_rows), at.value_lengths().to_numpy())
            flat = at.flatten().to_numpy()
            for i in range(0, len(flat), EMIT):
                row, a = every[i:i + EMIT], flat[i:i + EMIT]
                chunk, right = c.first[row] + (a >> 1), (a & 1) == 1
                word = np.where(right, c.last[chunk] + 1, c.begin[chunk])
                lo = np.where(right, word, np.maximum(word - BEFORE, c.words[row]))
                hi = np.where(right, np.minimum(word + AFTER, c.words[row + 1]), word)
                near = [h[x:y] if r else h[x:y][::-1] for x, y, r in zip(lo, hi, right, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(a),
                     pa.array(word - c.words[row]),
                     pa.ListArray.from_arrays(np.cumsum([0, *map(len, near)]).astype(np.int32), np.concatenate(near))],
                    names=["id", "th", "at", "word", "near"])

    rows = j.mapInArrow(run, "id long, th long, at long, word long, near array<long>")
    return rows.dropDuplicates(["id", "th", "at"])  # an exact repetition of a row


def _agree(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays share."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ == 0, F.size(a)).otherwise(differ - 1).cast("long")


def passages(docs: DataFrame, min_words: int, min_run: int, broadcast_bytes: int) -> DataFrame:
    """``(id, th, gone array<long>)``: for each text of ``docs(id, th, text)``
    with any, the passages to cut out as first word, last word + 1, first word,
    and so on. A text is known by its id and its hash ``th``: ids may repeat
    with other texts.

    Each word of a passage maps to an equal word that comes earlier by (id, th,
    place), so what is cut stands whole, in one piece or in several, in the
    texts that stay.
    """
    runs = store(common_runs(docs, min_run))
    ends = runs.select("id", "th", "kid", "kth", "shift", "lo",
                       F.explode(F.array(F.col("lo") * 2, F.col("hi") * 2 + 1)).alias("at"))
    ends = ends.withColumn("kat", F.col("at") - 2 * F.col("shift"))
    wanted = (ends.select("id", "th", "at").union(ends.select("kid", "kth", "kat"))
              .groupBy("id", "th").agg(F.sort_array(F.collect_set("at")).alias("at")))
    near = store(contexts(docs, bounded(store(wanted), F.size("at") * 8 + 56, broadcast_bytes)))
    mine = near.select("id", "th", "at", "word", F.col("near").alias("mine"))
    kept = near.select(F.col("id").alias("kid"), F.col("th").alias("kth"), F.col("at").alias("kat"), "near")
    j = ends.join(mine, ["id", "th", "at"]).join(kept, ["kid", "kth", "kat"])
    j = j.withColumn("more", _agree(F.col("mine"), F.col("near")))
    whole = (j.groupBy("id", "th", "kid", "kth", "shift", "lo")
             .agg(F.min(F.when(F.col("at") % 2 == 0, F.col("word") - F.col("more"))).alias("a"),
                  F.max(F.when(F.col("at") % 2 == 1, F.col("word") + F.col("more"))).alias("b"))
             .where(F.col("b") - F.col("a") >= min_words))
    return (whole.groupBy("id", "th")
            .agg(F.flatten(F.sort_array(F.collect_set(F.array("a", "b")))).alias("gone")))


def bounded(df: DataFrame, size: Column, most: int) -> DataFrame:
    """``df`` to be broadcast if its rows' ``size`` adds up to ``most`` at most."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                min_run: int = MIN_RUN, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with its own columns, repeated passages cut out of the texts,
    and, last, ``_cut_words``, the number of words that went.

    A passage of ``min_words`` words or more goes where it repeats, word for
    word, one that comes earlier by (id, hash of the text, place) and both hold
    a run of common chunks of ``min_run`` words; the run is extended on both
    sides up to the first word that differs (A-Z without regard to case, any
    separators). Shorter repeats (lines, notices) stay. A word goes with the
    separators before it.

    Defined cases: a null text stays null, an empty or wordless one as it is; a
    row with a null id is left alone and not compared; rows that share an id
    but not a text are texts of their own (the one with the smaller 64-bit hash
    counts as the earlier), an exact repetition of a row changes nothing; a
    very long text is read whole, alone; an empty table gives an empty result;
    other columns go through untouched, whatever their names. Ids must be
    integers.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"),
                    F.col(text_col).alias("text"))
    cuts = store(passages(d, min_words, min_run, broadcast_bytes))
    cuts = bounded(cuts.toDF("_cut_id", "_cut_th", "_cut_gone"), F.size("_cut_gone") * 8 + 56, broadcast_bytes)
    plain, place = neutral(docs), docs.columns.index(text_col)
    same = ((plain[f"c{docs.columns.index(id_col)}"].cast("long") == cuts["_cut_id"])
            & (F.xxhash64(plain[f"c{place}"]) == cuts["_cut_th"]))
    j = plain.join(cuts, same, "left").drop("_cut_id", "_cut_th")
    schema = plain.withColumn("_cut_words", F.lit(0).cast("long")).schema

    def run(batches):
        hasher = TX.WordHasher()
        for part in TX.slices(batches, place):
            gone, text = part.column(part.num_columns - 1), part.column(place)
            cut = np.zeros(part.num_rows, np.int64)
            hit = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                data, off, _, end, _, first = TX.doc_words(hasher, text.take(pa.array(hit)))
                raw, values = data.tobytes(), text.to_pylist()
                for k, i in enumerate(hit.tolist()):
                    out, at, done, edges = [], int(off[k]), 0, gone[i].as_py()
                    for a, b in zip(edges[::2], edges[1::2], strict=True):
                        a = max(a, done)  # passages may overlap
                        if a < b:
                            stop = int(end[first[k] + a - 1]) if a else int(off[k])
                            out.append(raw[at:stop])
                            at, done = int(end[first[k] + b - 1]), b
                            cut[i] += b - a
                    out.append(raw[at:int(off[k + 1])])
                    values[i] = b"".join(out).decode("utf-8")
                text = pa.array(values, text.type)
            columns = [text if k == place else part.column(k) for k in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cut)], names=[f.name for f in schema.fields])

    return j.mapInArrow(run, schema).toDF(*docs.columns, "_cut_words")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with its own columns, repeated passages cut out; see ``cut_repeats``."""
    out = neutral(cut_repeats(docs, id_col, text_col, **how))
    return out.select(*out.columns[:-1]).toDF(*docs.columns)

"""MinHash near-dedup (operator 3): BagMinHash signatures of word shingles.

1. One Arrow pass: each text's multiset of 5-word shingles, its digest and its
   BagMinHash signature. Texts with equal multisets are one class.
2. Bands of the signature give buckets of classes. Every member is verified
   against its bucket's smallest class (a star, never all pairs), exactly, by
   multiset overlap.
3. Buckets that still hold several components are compared across components
   in blocks, exactly, in the task: every pair that the size bound and earlier
   links leave. A block gives out a forest of its links, never its pairs, so no
   link that the bands found is lost and groups of copies stay linear.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlytics.llm import text as TX
from churnlytics.llm.common import connected_components, filter_ids, store

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
BLOCK = 2048  # classes of one bucket that one task compares
BIN_ROWS = 4000  # rows of buckets or block pairs that one call gets
U64 = np.uint64


def shingle_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of ``k`` words; a text of fewer, but some,
    words is one shingle. ``first[i]:first[i + 1]`` are the words of text i."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), count)
    if not len(doc):
        return np.zeros(0, np.uint64), doc
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][doc]
    end = first[1:][doc]
    with np.errstate(over="ignore"):
        out = np.zeros(len(doc), np.uint64)
        for j in range(k):
            there = at + j < end
            word = np.where(there, h[np.minimum(at + j, len(h) - 1)], U64(0))
            out = TX.mix(out * U64(0x9E3779B97F4A7C15) + word + U64(j + 1))
    return out, doc


def multisets(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, multiplicity) of the distinct shingles, sorted by text."""
    if not len(h):
        return h, doc, doc
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.append(at, len(h)))


def bag_minhash(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs x m, float64; inf for empty bags) for bags given as
    (hash, text, weight); equal components of two bags have the probability of
    their weighted Jaccard similarity.

    Weights are discretised in steps of one and the levels are gathered in
    dyadic intervals [0,1), [1,2), [2,4), ... Each (shingle, interval) owns a
    Poisson process whose rate is the interval's width; a point carries a
    signature component and a level, and counts if the level lies below the
    weight. Points come in ascending order and a process ends as soon as it
    passes the largest component of its text's signature.
    """
    sig = np.full(n_docs * m, np.inf)
    top = np.full(n_docs, np.inf)
    if not len(h):
        return sig.reshape(n_docs, m)
    low, part = [], []  # the intervals that each item reaches into
    level, who = 0, np.arange(len(h))
    while len(who):
        low.append(np.full(len(who), level, np.float64))
        part.append(who)
        level = max(1, 2 * level)
        who = who[weight[who] > level]
    low, who = np.concatenate(low), np.concatenate(part)
    width = np.maximum(low, 1.0)
    with np.errstate(over="ignore"):
        seed = TX.mix(h[who] ^ (low.astype(np.uint64) + U64(1)) * U64(0xD6E8FEB86659FD93))
    own, limit, x, step = doc[who], weight[who].astype(np.float64), np.zeros(len(who)), 0
    while len(seed):
        block = int(np.clip(32768 // len(seed), 1, 64))
        no = np.arange(step + 1, step + block + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            r = TX.mix(seed[:, None] + no * U64(0x9E3779B97F4A7C15))
            r2 = TX.mix(r ^ U64(0xA0761D6478BD642F))
        gap = -np.log(((r >> U64(11)).astype(np.float64) + 0.5) / 9007199254740992.0) / width[:, None]
        points = np.cumsum(gap, axis=1) + x[:, None]
        component = (r2 & U64(0xFFFFFFFF)) * U64(m) >> U64(32)
        height = low[:, None] + (r2 >> U64(32)).astype(np.float64) / 4294967296.0 * width[:, None]
        good = (height < limit[:, None]) & (points < top[own][:, None])
        np.minimum.at(sig, (own[:, None] * m + component.astype(np.int64))[good], points[good])
        top = sig.reshape(n_docs, m).max(axis=1)
        x = points[:, -1]
        left = x < top[own]
        seed, own, limit, x, width, low = seed[left], own[left], limit[left], x[left], width[left], low[left]
        step += block
    return sig.reshape(n_docs, m)


def signatures(docs: DataFrame, k: int = SHINGLE, m: int = BANDS * ROWS) -> DataFrame:
    """``(id, digest binary, n int, sig array<int>)`` of ``docs(id, text)``;
    digest and sig are null for a text without words."""

    def run(batches):
        hasher = TX.WordHasher()
        for part in TX.slices(batches):
            *_, h, first = TX.doc_words(hasher, part.column(1))
            h, doc, w = multisets(*shingle_hashes(h, first, k), part.num_rows)
            sig = bag_minhash(h, doc, w, part.num_rows, m)
            total = np.bincount(doc, weights=w, minlength=part.num_rows).astype(np.int64)
            cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
            none = total == 0
            pairs = np.column_stack([h, w.astype(np.uint64)])
            digest = [None if none[i] else hashlib.blake2b(pairs[cut[i]:cut[i + 1]].tobytes(), digest_size=16).digest()
                      for i in range(part.num_rows)]
            code = (TX.mix(sig.view(np.uint64)) >> U64(32)).astype(np.uint32).view(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * m, pa.int32()),
                                              pa.array(code.ravel()), mask=pa.array(none))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(digest, pa.binary()), pa.array(total, pa.int32()), arrays],
                names=["id", "digest", "n", "sig"])

    return docs.mapInArrow(run, "id long, digest binary, n int, sig array<int>")


def elements(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``(id, els array<long>)``: the multiset as a sorted set, the copies of a
    shingle told apart by their number."""

    def run(batches):
        hasher = TX.WordHasher()
        for part in TX.slices(batches):
            *_, h, first = TX.doc_words(hasher, part.column(1))
            h, doc, w = multisets(*shingle_hashes(h, first, k), part.num_rows)
            no = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            with np.errstate(over="ignore"):
                e = TX.mix(np.repeat(h, w) + no.astype(np.uint64) * U64(0x8CB92BA72F3D8DD7))
            own = np.repeat(doc, w)
            e = e.view(np.int64)[np.lexsort((e.view(np.int64), own))]
            off = np.searchsorted(own, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(e))],
                names=["id", "els"])

    return docs.mapInArrow(run, "id long, els array<long>")


def band_rows(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """``(rep, n, no, band)``: one row per class and band; ``no`` numbers the bands."""
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.col("sig")[b * rows + r] for r in range(rows)]) for b in range(bands)])
    return classes.select("rep", "n", F.posexplode(keys).alias("no", "band"))


def verified(pairs: DataFrame, docs: DataFrame, similarity: float, k: int) -> DataFrame:
    """The ``pairs(a, b)`` whose multiset overlap is at least ``similarity``."""
    pairs = store(pairs)
    ids = store(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    els = store(elements(filter_ids(docs, ids, "id"), k))
    a = els.select(F.col("id").alias("a"), F.col("els").alias("ea"))
    b = els.select(F.col("id").alias("b"), F.col("els").alias("eb"))
    same = F.size(F.array_intersect("ea", "eb"))
    return (pairs.join(b, "b").join(a, "a").withColumn("same", same)
            .where(F.col("same") >= similarity * (F.size("ea") + F.size("eb") - F.col("same")) - 1e-9)
            .select("a", "b").distinct())


def bucket_forest(left: dict, right: dict, same: bool, no: int, rows: int,
                  similarity: float) -> list[tuple[int, int]]:
    """Links between two blocks of a bucket, enough of them to connect what
    links connect. ``left`` and ``right`` hold rep, comp, n, sig and els.

    Only pairs of different components count that meet in band ``no`` first;
    each of them is verified exactly, whatever its signatures' share, unless
    links found before connect it.
    """
    a, b = len(left["rep"]), len(right["rep"])
    comp = np.unique(np.concatenate([left["comp"], right["comp"]]), return_inverse=True)[1]
    mine, theirs = comp[:a], comp[a:]
    label = np.arange(comp.max() + 1)  # of each component, the one it is connected to
    # The elements of the right side as numbers, so that a text is compared with many at once.
    sizes = np.array([len(y) for y in right["els"]], np.int64)
    begin = np.cumsum(sizes) - sizes
    known, flat = np.unique(np.concatenate(right["els"]), return_inverse=True)
    mark = np.zeros(len(known), bool)
    links = []
    for i in range(a):
        n, size = right["n"], left["n"][i]
        ok = (label[theirs] != label[mine[i]]) & (np.minimum(n, size) >= similarity * np.maximum(n, size))
        if same:
            ok &= right["rep"] > left["rep"][i]
        at = np.flatnonzero(ok)
        if len(at):
            bands = (right["sig"][at] == left["sig"][i]).reshape(len(at), -1, rows).all(axis=2)
            at = at[bands.argmax(axis=1) == no]
        if not len(at):
            continue
        x = np.asarray(left["els"][i])
        place = np.minimum(np.searchsorted(known, x), len(known) - 1)
        place = place[known[place] == x]
        mark[place] = True
        off = np.cumsum(sizes[at]) - sizes[at]
        items = np.arange(sizes[at].sum()) + np.repeat(begin[at] - off, sizes[at])
        both = np.add.reduceat(mark[flat[items]].astype(np.int64), off)
        mark[place] = False
        for j in at[both >= similarity * (len(x) + sizes[at] - both) - 1e-9].tolist():
            if label[theirs[j]] != label[mine[i]]:
                label[label == label[theirs[j]]] = label[mine[i]]
                links.append((int(left["rep"][i]), int(right["rep"][j])))
    return links


def block_rows(rest: DataFrame, n_rows: int, bin_rows: int = BIN_ROWS) -> DataFrame:
    """``rest(no, band, blocks, rep, ...)`` with a row for each pair of blocks
    ``(lo, hi)`` that a class's block ``own`` takes part in; ``n_rows`` is the
    sum of ``blocks``. A ``bin`` holds about ``bin_rows`` rows in whole pairs of
    blocks, so a hot bucket's pairs go to many bins."""
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    bins = max(1, -(-n_rows // bin_rows))
    return (rest.withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
            .withColumn("bin", F.pmod(F.xxhash64("no", "band", "lo", "hi"), F.lit(bins))))


def cross_links(rest: DataFrame, n_rows: int, rows: int, similarity: float) -> DataFrame:
    """Links ``(src, dst)`` between components within buckets: ``rest(no, band,
    blocks, rep, comp, n, sig, els)``, ``n_rows`` as in ``block_rows``. A bucket
    beyond one block is compared block against block; a call gets a bin of
    small buckets or a few pairs of blocks."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        links = []
        for (no, _, lo, hi), g in pdf.groupby(["no", "band", "lo", "hi"], sort=False):
            side = {k: {"rep": h["rep"].to_numpy(), "comp": h["comp"].to_numpy(), "n": h["n"].to_numpy(),
                        "sig": np.stack(h["sig"].to_numpy()), "els": h["els"].to_list()}
                    for k in {lo, hi} if len(h := g[g["own"] == k])}
            if lo in side and hi in side:
                links += bucket_forest(side[lo], side[hi], lo == hi, int(no), rows, similarity)
        return pd.DataFrame(links, columns=["src", "dst"]).astype("int64")

    return block_rows(rest, n_rows).groupBy("bin").applyInPandas(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                    shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: the id, n_shingles, class_id (smallest id
    with the same multiset of shingles), component_id (smallest id that links
    reach), kept (id = component_id).

    Two texts are linked if the multisets of their ``shingle``-word shingles
    overlap by ``similarity`` or more (weighted Jaccard). With 24 bands of 4 a
    pair at 0.8 shares no band with probability 3e-6; a pair that shares one is
    verified exactly or connected by other links.

    Defined cases: null, empty and wordless texts have no shingles, link with
    nothing and are kept; a text of fewer words is one shingle; a row with a
    null id cannot be named by others: class_id and component_id are null and
    it is kept; rows that share an id are one node of the link graph; an empty
    table gives an empty result; other columns are not read. Ids must be
    integers.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sigs = store(signatures(d, shingle, bands * rows))
    named = sigs.where("id IS NOT NULL AND digest IS NOT NULL")
    classes = store(named.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"),
                                                F.first("sig").alias("sig")))
    # Star pairs: each member and the smallest class of its bucket.
    banded = band_rows(classes, bands, rows)
    buckets = store(banded.groupBy("band").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("size"))
                    .where("size > 1"))
    members = store(banded.join(buckets.select("band", "hub"), "band").select("no", "band", "rep", "n", "hub"))
    sizes = classes.select(F.col("rep").alias("hub"), F.col("n").alias("hub_n"))
    star = (members.where("rep <> hub").select(F.col("hub"), "rep", "n").distinct().join(sizes, "hub")
            .where(F.least("n", "hub_n") >= similarity * F.greatest("n", "hub_n"))
            .select(F.col("hub").alias("a"), F.col("rep").alias("b")))
    links = verified(star.distinct(), d, similarity, shingle)
    # Rows that share an id but not a text are one node.
    same_id = named.select("id", "digest").distinct().join(classes.select("digest", "rep"), "digest") \
                   .where("id <> rep").groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")) \
                   .where("rep <> other").select(F.col("rep").alias("src"), F.col("other").alias("dst"))
    comps = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(same_id))
    comps = store(comps)
    # Buckets that still hold several components.
    placed = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left") \
                    .select("no", "band", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = (placed.groupBy("band").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"),
                                        F.count(F.lit(1)).alias("size")).where("c1 < c2")
             .select("band", F.ceil(F.col("size") / block).alias("blocks")))
    rest = store(placed.join(mixed, "band"))
    n_rows = rest.agg(F.sum("blocks")).first()[0] or 0
    if n_rows:
        ids = store(rest.select(F.col("rep").alias("id")).distinct())
        els = store(elements(filter_ids(d, ids, "id"), shingle))
        # A node's own text: rows that share its id may hold others.
        own = els.join(classes.select(F.col("rep").alias("id"), "n", "sig"), "id").where(F.size("els") == F.col("n"))
        full = rest.join(own.withColumnRenamed("id", "rep"), "rep")
        more = store(cross_links(full, n_rows, rows, similarity))
        if not more.isEmpty():
            comps = store(connected_components(
                comps.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(more)))
    return (sigs.select("id", "digest", "n").join(classes.select("digest", "rep"), "digest", "left")
            .join(comps.withColumnRenamed("node", "rep"), "rep", "left")
            .select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("class_id"),
                    F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each group, the smallest id's; its own
    columns. Cases as in ``near_duplicates``."""
    gone = near_duplicates(docs, id_col, text_col, **how).where("NOT kept").select(F.col(id_col).alias("id")).distinct()
    return filter_ids(docs, store(gone), id_col, keep=False)

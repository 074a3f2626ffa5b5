"""Embedding near-dedup (operator 2): cross-polytope hashing.

Each table of the index applies ``n_hashes`` pseudo-random rotations (three
rounds of random signs and a fast Hadamard transform); a hash is the closest
signed axis. A vector stands in the bucket of its closest axes and probes the
buckets next to it. Candidates within a bucket are verified by cosine in
double precision. Equal directions are one class with a count. Buckets beyond
a block are compared block against block; a bucket gives out sums of links and
a forest, never its pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlytics.llm import text as TX
from churnlytics.llm.common import connected_components, store

SIMILARITY = 0.95
PROBES = 4        # neighbouring buckets that a vector looks into, in each table
MISS = 1e-4       # share of pairs just at the similarity that all tables may miss
BLOCK = 1024      # classes of a bucket that one task compares at once
BIN_ROWS = 20_000  # bucket rows that one call gets
U64 = np.uint64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (their length a power of 2)."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x


def signs(seed: int, d: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        bits = TX.mix(np.arange(d, dtype=np.uint64) + U64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return np.where(bits >> U64(63), 1.0, -1.0)


def bucket_codes(unit: np.ndarray, tables: int, n_hashes: int, probes: int = PROBES) -> np.ndarray:
    """(rows x tables x 1 + probes) bucket numbers; the first is a vector's own.

    A probe replaces one hash by its second or third closest axis, those first
    that lie least behind the closest.
    """
    n, dim = unit.shape
    d = 1 << max(1, math.ceil(math.log2(max(dim, 2))))
    x = np.zeros((n, d))
    x[:, :dim] = unit
    rows = np.arange(n)
    out = np.zeros((n, tables, 1 + probes), np.int32)
    alternatives = min(2, d - 1)
    for t in range(tables):
        own = np.zeros((n, n_hashes), np.uint64)
        other = np.zeros((n, n_hashes, alternatives), np.uint64)
        behind = np.zeros((n, n_hashes, alternatives))
        for k in range(n_hashes):
            y = x
            for r in range(3):
                y = hadamard(y * signs((t * 64 + k) * 3 + r, d))
            a = np.abs(y)
            for c in range(1 + alternatives):
                at = a.argmax(axis=1)
                axis = (2 * at + (y[rows, at] < 0)).astype(np.uint64)
                if c == 0:
                    own[:, k], best = axis, a[rows, at].copy()
                else:
                    other[:, k, c - 1], behind[:, k, c - 1] = axis, best - a[rows, at]
                a[rows, at] = -1
        order = np.argsort(behind.reshape(n, -1), axis=1, kind="stable")[:, :probes]
        with np.errstate(over="ignore"):
            # Sum over the hashes, so that a probe changes one summand.
            def part(axis, k):
                return TX.mix(axis + U64(1) + U64((k + 1) << 20) + U64((t + 1) << 32) + U64(dim << 40))
            base = sum(part(own[:, k], k) for k in range(n_hashes))
            out[:, t, 0] = (TX.mix(base) >> U64(32)).astype(np.uint32).view(np.int32)
            for p in range(probes):
                pick = order[:, min(p, order.shape[1] - 1)]
                k, c = pick // alternatives, pick % alternatives
                new = base.copy()
                for j in range(n_hashes):
                    m = k == j
                    new[m] += part(other[m, j, c[m]], j) - part(own[m, j], j)
                out[:, t, 1 + p] = (TX.mix(new) >> U64(32)).astype(np.uint32).view(np.int32)
    return out


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For codes (rows x 1 + probes) of one table: do the vectors share a bucket
    that is one's own?"""
    return (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)


def tables_needed(dim: int, n_hashes: int, similarity: float, probes: int = PROBES, miss: float = MISS) -> int:
    """Tables that lose at most ``miss`` of the pairs just at ``similarity``,
    measured on random pairs."""
    rng = np.random.default_rng(0)
    x, z = rng.normal(size=(2, 2000, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(axis=1)[:, None] * x
    norm = np.linalg.norm(z, axis=1)[:, None]
    if dim < 2 or not norm.all():
        return 1
    y = similarity * x + math.sqrt(1 - similarity ** 2) * z / norm
    a, b = (bucket_codes(v, 1, n_hashes, probes)[:, 0] for v in (x, y))
    q = float(meet(a, b).mean())
    return 1 if q >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - q)))


def unit_vectors(col: pa.Array) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Unit vectors in double precision, None where a vector is null, empty,
    zero or holds null or non-finite components; and their lengths."""
    out: list[np.ndarray | None] = []
    for v in col:
        x = None
        if v.is_valid and len(v.values) and v.values.null_count == 0:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            big = np.abs(x).max()
            if np.isfinite(big) and big > 0:
                x = x / big  # no overflow in the norm
                x = x / np.linalg.norm(x) + 0.0
            else:
                x = None
        out.append(x)
    return out, np.array([0 if x is None else len(x) for x in out])


def directions(vectors: DataFrame) -> DataFrame:
    """``(id, digest, unit array<double>)`` of ``vectors(id, vec)``; null where
    a vector links with nothing."""

    def run(batches):
        for batch in batches:
            units, _ = unit_vectors(batch.column(1))
            digest = [None if u is None else hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in units]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()),
                                              pa.array(units, pa.list_(pa.float64()))], names=["id", "digest", "unit"])

    return vectors.mapInArrow(run, "id long, digest binary, unit array<double>")


def coded(classes: DataFrame, tables: int, n_hashes: int, probes: int) -> DataFrame:
    """``classes(rep, n, unit)`` with ``codes array<int>``, flat by table."""

    def run(batches):
        for batch in batches:
            units = batch.column(2).to_numpy(zero_copy_only=False)
            dims = np.array([len(u) for u in units], np.int64)
            codes = np.zeros((len(units), tables * (1 + probes)), np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for part in np.array_split(at, max(1, len(at) // 4096)):
                    codes[part] = bucket_codes(np.stack(units[part]), tables, n_hashes, probes).reshape(len(part), -1)
            off = pa.array(np.arange(len(units) + 1) * codes.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(off, pa.array(codes.ravel()))],
                                             names=["rep", "n", "unit", "codes"])

    return classes.select("rep", "n", "unit").mapInArrow(run, "rep long, n long, unit array<double>, codes array<int>")


def cell_links(left: dict, right: dict, same: bool, table: int, code: int, width: int, similarity: float):
    """Links between two blocks of a bucket that meet here first: (rep, links,
    root) of the vectors that have any. ``left`` and ``right`` hold unit, rep,
    n and codes (rows x tables x width)."""
    ok = left["unit"] @ right["unit"].T >= similarity
    if same:
        ok &= left["rep"][:, None] < right["rep"][None, :]
    i, j = np.nonzero(ok)
    a, b = left["codes"][i], right["codes"][j]
    own_a, own_b = a[:, table, 0], b[:, table, 0]
    here = (own_a == code) | (own_b == code)
    # They may also meet in the other's own bucket of this table.
    other = np.where(own_a == code, own_b, own_a)
    sees = np.where(own_a == code, (a[:, table] == own_b[:, None]).any(axis=1), (b[:, table] == own_a[:, None]).any(axis=1))
    here &= ~(sees & (other < code))
    for t in range(table):
        here &= ~meet(a[:, t], b[:, t])
    i, j = i[here], j[here]
    if not len(i):
        return None
    links_l = np.bincount(i, weights=right["n"][j], minlength=len(left["rep"])).astype(np.int64)
    links_r = np.bincount(j, weights=left["n"][i], minlength=len(right["rep"])).astype(np.int64)
    root_l, root_r = left["rep"].copy(), right["rep"].copy()
    while True:  # smallest rep of each component of the block's links
        before = root_l.sum(), root_r.sum()
        np.minimum.at(root_l, i, root_r[j])
        np.minimum.at(root_r, j, root_l[i])
        if same:
            root_l = root_r = np.minimum(root_l, root_r)
            root_r = root_r.copy()
        if before == (root_l.sum(), root_r.sum()):
            break
    a, b = links_l > 0, links_r > 0
    return (np.concatenate([left["rep"][a], right["rep"][b]]), np.concatenate([links_l[a], links_r[b]]),
            np.concatenate([root_l[a], root_r[b]]))


def bucket_links(rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """``(rep, links, root)`` from bucket rows ``(bin, tab, code, lo, hi, own,
    rep, n, unit, codes)``; a bin holds many small buckets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (tab, code, lo, hi), g in pdf.groupby(["tab", "code", "lo", "hi"], sort=False):
            if len(g) < 2:
                continue
            dims = g["unit"].map(len).to_numpy()
            for dim in np.unique(dims):
                h = g[dims == dim]
                side = {s: {"unit": np.stack(h["unit"][m].to_numpy()), "rep": h["rep"][m].to_numpy(),
                            "n": h["n"][m].to_numpy(),
                            "codes": np.stack(h["codes"][m].to_numpy()).reshape(int(m.sum()), -1, width)}
                        for s in {lo, hi} if (m := (h["own"] == s).to_numpy()).any()}
                if lo in side and hi in side:
                    got = cell_links(side[lo], side[hi], lo == hi, tab, code, width, similarity)
                    if got is not None:
                        found.append(got)
        rep, links, root = (np.concatenate(x) for x in zip(*found, strict=True)) if found else ([], [], [])
        return pd.DataFrame({"rep": rep, "links": links, "root": root}).astype("int64")

    return rows.groupBy("bin").applyInPandas(run, "rep long, links long, root long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                 similarity: float = SIMILARITY, probes: int = PROBES, miss: float = MISS,
                 block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: the id, n_links (other vectors with a
    cosine of ``similarity`` or more), component_id (smallest id that links
    reach), kept (id = component_id).

    The hashes per table grow with the logarithm of the number of classes, and
    the tables with them, so that buckets stay small and at most ``miss`` of
    the pairs just at the similarity are lost (closer ones far fewer).

    Defined cases: vectors that are null, empty, zero or hold null or
    non-finite components link with nothing and are kept; vectors of different
    lengths do not link; a row with a null id links with nothing, its
    component_id is null and it is kept; rows that share an id are one node for
    components and count as vectors of their own for links; an empty table
    gives an empty result; other columns are not read. Ids must be integers.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    every = store(directions(v))
    classes = store(every.where("id IS NOT NULL AND digest IS NOT NULL").groupBy("digest")
                    .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit")))
    about = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("unit")).alias("dim")).first()
    dim = about["dim"] or 1
    n_hashes = max(1, math.ceil(math.log(max(about["n"], 2)) / math.log(2 * max(2, dim))))
    tables, width = tables_needed(dim, n_hashes, similarity, probes, miss), 1 + probes
    index = store(coded(classes, tables, n_hashes, probes))
    slim = (index.select("rep", F.posexplode("codes").alias("pos", "code"))
            .select("rep", F.expr(f"pos div {width}").cast("int").alias("tab"), "code",
                    (F.col("pos") % width == 0).alias("main"))
            .groupBy("rep", "tab", "code").agg(F.max("main").alias("main")))
    full = (slim.groupBy("tab", "code").agg(F.count(F.lit(1)).alias("size"), F.max("main").alias("any_main"))
            .where("size > 1 AND any_main"))
    dealt = (slim.join(full, ["tab", "code"])
             .withColumn("blocks", F.ceil(F.col("size") / block))
             .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("rep", "tab", "code", "own", F.least("own", "other").alias("lo"),
                     F.greatest("own", "other").alias("hi")))
    dealt = store(dealt)
    bins = max(1, -(-dealt.count() // BIN_ROWS))
    rows = (dealt.join(index, "rep")
            .withColumn("bin", F.pmod(F.xxhash64("tab", "code", "lo", "hi"), F.lit(bins))))
    links = store(bucket_links(rows, width, similarity))
    comps = connected_components(links.select(F.col("rep").alias("src"), F.col("root").alias("dst"))
                                 .union(every.where("digest IS NOT NULL").join(classes.select("digest", "rep"), "digest")
                                        .where("id <> rep").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
                                        .where("a <> b").select("a", "b")))
    per_class = (classes.select("digest", "rep", "n")
                 .join(links.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
                 .join(comps.withColumnRenamed("node", "rep"), "rep", "left"))
    return (every.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest"))
            .join(per_class, "digest", "left")
            .select(F.col("id").alias(id_col),
                    (F.coalesce(F.col("n") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
                    F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))

"""Approximate nearest neighbours (operator 12): a forest of random-projection
trees searched through a shared priority queue, then exact reranking.

Level l of tree t projects on one pseudo-random direction; each node splits at
the median of its own rows in a bounded sample. All rows stand in one leaf of
each tree. A query walks the trees with one queue over all of them, ordered by
the squared distance to the splits on the far side of which a node lies, and
takes leaves until its budget is spent. The budget is measured: it is the
number of leaves after which a sample of queries has met the wanted share of
its true neighbours. Leaves are compared with their queries on Spark, by exact
cosines; equal directions are one row of the index with its ids.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlytics.llm.common import store
from churnlytics.llm.embeddings import unit_vectors

TREES = 4
LEAF = 128         # rows of a leaf in the mean, as far as the sample reaches
SAMPLE_BYTES = 32 << 20  # of the rows (as expected) that fit the splits
SAMPLE_LEAF = 8    # rows of the sample in a leaf, at least
QUERIES = 128      # queries (expected) that measure the budget
RECALL = 0.96      # share of their neighbours that the budget has to meet
SIBLINGS = 16      # neighbouring leaves that travel together
BLOCK = 4096       # rows or queries of one comparison
HASH = 1 << 40


class Forest:
    """Directions (trees x levels x dim) and splits (trees x nodes), in heap
    order: node i of a level has the children 2i and 2i + 1 of the next."""

    def __init__(self, sample: np.ndarray, n: int, trees: int = TREES, leaf: int = LEAF):
        self.trees, dim = trees, sample.shape[1]
        self.levels = max(0, min(math.ceil(math.log2(max(1.0, n / leaf))),
                                 int(math.log2(max(1, len(sample) // SAMPLE_LEAF)))))
        self.leaves = 1 << self.levels
        rng = np.random.default_rng(0)
        self.directions = rng.normal(size=(trees, self.levels, dim))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.splits = np.zeros((trees, self.leaves))  # node i of level l is at 2^l + i
        for t in range(trees):
            at = np.zeros(len(sample), np.int64)
            for l in range(self.levels):
                p = sample @ self.directions[t, l]
                order = np.lexsort((p, at))
                size = np.bincount(at, minlength=1 << l)
                middle = np.minimum(np.cumsum(size) - size + size // 2, len(sample) - 1)
                self.splits[t, 1 << l:2 << l] = np.where(size > 0, p[order][middle], 0.0)
                at = 2 * at + (p >= self.splits[t, (1 << l) + at])

    def place(self, unit: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree (rows x trees)."""
        out = np.zeros((len(unit), self.trees), np.int32)
        for t in range(self.trees):
            for l in range(self.levels):
                out[:, t] = 2 * out[:, t] + (unit @ self.directions[t, l] >= self.splits[t, (1 << l) + out[:, t]])
        return out

    def costs(self, unit: np.ndarray) -> np.ndarray:
        """Cost of every leaf (trees x leaves) for one query: the queue takes
        leaves in this order."""
        out = np.zeros((self.trees, self.leaves))
        for t in range(self.trees):
            cost = np.zeros(1)
            for l in range(self.levels):
                side = float(unit @ self.directions[t, l]) - self.splits[t, 1 << l:2 << l]
                cost = np.stack([cost + np.where(side >= 0, side ** 2, 0), cost + np.where(side < 0, side ** 2, 0)],
                                axis=1).ravel()
            out[t] = cost
        return out

    def search(self, unit: np.ndarray, budget: int) -> list[tuple[int, int]]:
        """The first ``budget`` (tree, leaf) that the shared queue gives out."""
        p = np.einsum("tld,d->tl", self.directions, unit).tolist()
        splits, levels = self.splits, self.levels
        queue = [(0.0, t, 0, 0) for t in range(self.trees)]  # cost, tree, level, node
        found = []
        while queue and len(found) < budget:
            cost, t, level, node = heapq.heappop(queue)
            while level < levels:  # down the near side; the far side waits
                side = p[t][level] - splits[t, (1 << level) + node]
                near = side >= 0
                heapq.heappush(queue, (cost + float(side) ** 2, t, level + 1, 2 * node + (not near)))
                node, level = 2 * node + near, level + 1
            found.append((t, node))
        return found


def row_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of unit vectors row by row; the order of the sums depends on the
    length alone, so a pair has one score wherever it is compared."""
    return np.clip((a * b).sum(axis=1), -1.0, 1.0)


def unit_rows(vectors) -> np.ndarray:
    """Unit vectors, in double precision, of an Arrow column or pandas series
    of vectors of one length, none of them zero."""
    x = np.stack(vectors.to_numpy(zero_copy_only=False) if isinstance(vectors, pa.Array) else vectors.to_numpy())
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kind_of(rows: DataFrame) -> str:
    return rows.schema["vec"].dataType.simpleString()


def directed(vectors: DataFrame) -> DataFrame:
    """``(id, vec, digest)`` of the rows of ``vectors(id, vec)`` that take part;
    rows with one digest have one direction."""

    def run(batches):
        for batch in batches:
            units, _ = unit_vectors(batch.column(1))
            digest = [None if u is None else hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in units]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digest, pa.binary())], names=["id", "vec", "digest"])

    return (vectors.where("id IS NOT NULL").mapInArrow(run, f"id long, vec {kind_of(vectors)}, digest binary")
            .where("digest IS NOT NULL"))


def share(n: int, wanted: int) -> int:
    """Bound on a hash below HASH that about ``wanted`` of n rows pass."""
    return HASH if n <= wanted else int(HASH * wanted / n)


def hashed(seed: int):
    return F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(HASH))


def placed(classes: DataFrame, forest: Forest) -> DataFrame:
    """``classes(rep, vec, query, least)`` with ``leaves array<int>``, one a tree."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at = forest.place(unit_rows(batch.column(1)))
                off = pa.array(np.arange(len(at) + 1) * forest.trees, pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(off, pa.array(at.ravel()))],
                                                 names=["rep", "vec", "query", "least", "leaves"])

    return classes.select("rep", "vec", "query", "least").mapInArrow(
        run, f"rep long, vec {kind_of(classes)}, query boolean, least long, leaves array<int>")


def best_rows(unit: np.ndarray, x: np.ndarray, least: np.ndarray, rough: np.ndarray, most: int):
    """(places, scores) of the ``most`` rows of ``x`` with the largest cosine,
    ties to the smaller ``least``; ``rough`` are the cosines but for rounding,
    -inf where a row is no candidate."""
    at = np.flatnonzero(rough > -np.inf)
    if len(at) > most:
        bound = np.partition(rough[at], len(at) - most)[len(at) - most] - 1e-9
        at = at[rough[at] >= bound]
    score = row_dot(x[at], unit[None, :])
    order = np.lexsort((least[at], -score))[:most]
    return at[order], score[order]


def true_neighbors(index: DataFrame, reps: np.ndarray, units: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Query rep -> leaves (rows x trees) of its ``most`` nearest other rows of
    the index, by comparing a bounded set of queries with every row."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, x = batch.column(0).to_numpy(), unit_rows(batch.column(1))
            s = units @ x.T
            s[reps[:, None] == own[None, :]] = -np.inf
            k = min(most, len(own))
            at = np.argpartition(-s, k - 1, axis=1)[:, :k]
            rows, cols = np.repeat(np.arange(len(reps)), k), at.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(reps[rows]), pa.array(s[rows, cols]), batch.column(4).take(pa.array(cols))],
                names=["rep", "score", "leaves"])

    near = index.mapInArrow(run, "rep long, score double, leaves array<int>").where("score >= -1")
    best = near.withColumn("no", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"))))
    out: dict[int, list] = {}
    for row in best.where(F.col("no") <= most).collect():  # QUERIES x most rows
        out.setdefault(row["rep"], []).append(row["leaves"])
    return {rep: np.array(x) for rep, x in out.items()}


def measured_budget(forest: Forest, index: DataFrame, n_queries: int, k: int,
                    queries: int = QUERIES, recall: float = RECALL) -> int:
    """Leaves that a query takes, so that ``recall`` of the neighbours of a
    sample of queries are met."""
    rows = index.where(F.col("query") & (hashed(1) < share(n_queries, queries))).select("rep", "vec").toArrow()
    if not rows.num_rows or forest.levels == 0:
        return forest.trees if forest.levels else 1
    reps, units = rows.column(0).to_numpy(), unit_rows(rows.column(1).combine_chunks())
    near = true_neighbors(index, reps, units, k)
    met = []
    for rep, unit in zip(reps.tolist(), units, strict=True):
        if rep in near:
            costs = forest.costs(unit)
            order = np.sort(costs.ravel())
            own = costs[np.arange(forest.trees)[None, :], near[rep]].min(axis=1)
            met += np.searchsorted(order, own, side="right").tolist()
    return max(forest.trees, int(np.quantile(met, recall, method="higher"))) if met else forest.trees


def wanted_leaves(queries: DataFrame, forest: Forest, budget: int) -> DataFrame:
    """``(tree, bin, mask, rep, vec)``: bit i of ``mask`` stands for leaf
    ``SIBLINGS * bin + i`` of the tree."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            units, at, found = unit_rows(batch.column(1)), [], []
            for i, unit in enumerate(units):
                masks: dict[tuple[int, int], int] = {}
                for t, leaf in forest.search(unit, budget):
                    key = (t, leaf // SIBLINGS)
                    masks[key] = masks.get(key, 0) | 1 << leaf % SIBLINGS
                at += [i] * len(masks)
                found += [(*key, m) for key, m in masks.items()]
                if len(at) > 20_000 or i == len(units) - 1:
                    tree, bin_, mask = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array(x, pa.int32()) for x in (tree, bin_, mask)],
                         batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))],
                        names=["tree", "bin", "mask", "rep", "vec"])
                    at, found = [], []

    return queries.select("rep", "vec").mapInArrow(
        run, f"tree int, bin int, mask int, rep long, vec {kind_of(queries)}")


def reranked(index: DataFrame, wanted: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """``(rep, near, least, score)``: for every query the best ``most`` rows of
    each group of leaves that it takes. Groups of more than ``block``
    rows or queries are compared block by block."""
    rows = index.select("rep", "least", "vec", F.posexplode("leaves").alias("tree", "leaf")).select(
        "tree", F.expr(f"leaf div {SIBLINGS}").cast("int").alias("bin"),
        (F.col("leaf") % SIBLINGS).alias("at"), "rep", "least", "vec")
    # A row for each group of leaves: bounded by the forest.
    sizes = (index.select(F.posexplode("leaves").alias("tree", "leaf"))
             .groupBy("tree", F.expr(f"leaf div {SIBLINGS}").cast("int").alias("bin"))
             .agg(F.ceil(F.count(F.lit(1)) / block).alias("rows")))
    asked = wanted.groupBy("tree", "bin").agg(F.ceil(F.count(F.lit(1)) / block).alias("asks"))
    blocks = F.broadcast(store(sizes.join(asked, ["tree", "bin"])))
    pieces = [F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)) for c in ("asks", "rows")]
    part = "pmod(xxhash64(rep), {})"
    rows = (rows.join(blocks, ["tree", "bin"]).withColumn("y", F.expr(part.format("rows"))).withColumn("x", pieces[0])
            .select("tree", "bin", "x", "y", "at", "rep", "least", "vec"))
    asks = (wanted.join(blocks, ["tree", "bin"]).withColumn("x", F.expr(part.format("asks"))).withColumn("y", pieces[1])
            .select("tree", "bin", "x", "y", "mask", "rep", "vec"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            q, x = unit_rows(left["vec"]), unit_rows(right["vec"])
            own, mask = left["rep"].to_numpy(), left["mask"].to_numpy()
            reps, least, at = (right[c].to_numpy() for c in ("rep", "least", "at"))
            for a in range(0, len(q), 256):
                s = q[a:a + 256] @ x.T
                s[(mask[a:a + 256, None] >> at[None, :]) & 1 == 0] = -np.inf
                s[own[a:a + 256, None] == reps[None, :]] = -np.inf
                for i, line in enumerate(s):
                    best, score = best_rows(q[a + i], x, least, line, most)
                    out.append((np.full(len(best), own[a + i]), reps[best], least[best], score))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 4
        return pd.DataFrame({name: np.asarray(c, kind) for name, c, kind in
                             zip(("rep", "near", "least", "score"), columns, ("int64", "int64", "int64", "float64"),
                                 strict=True)})

    key = ["tree", "bin", "x", "y"]
    return asks.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(run, "rep long, near long, least long, score double")


def nearest_classes(index: DataFrame, queries: DataFrame, forest: Forest, budget: int, most: int) -> DataFrame:
    """``(rep, near, score)``: the ``most`` best rows found for each query,
    ties to the row with the smaller least id."""
    found = reranked(index, store(wanted_leaves(queries, forest, budget)), most)
    found = found.groupBy("rep", "near", "least").agg(F.max("score").alias("score"))
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "least", "near")
    return found.withColumn("no", F.row_number().over(best)).where(F.col("no") <= most).select("rep", "near", "score")


def nearest_neighbors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
                      every_nth: int = 50, trees: int = TREES, leaf: int = LEAF, sample_bytes: int = SAMPLE_BYTES,
                      recall: float = RECALL) -> DataFrame:
    """``(query_id, rank, <id_col>, score)``: for every row whose id is
    divisible by ``every_nth`` its ``k`` nearest other rows by cosine, nearest
    first, ties to the smaller id.

    The index holds every row. Splits are fitted on rows of about
    ``sample_bytes`` (65,536 vectors of 64 numbers; beyond 128 rows for every
    8 of them leaves grow with the table) and the budget of a search on about 128 queries, so that about ``recall`` of
    the true neighbours are found, whatever the data; rows without near
    neighbours (independent directions) need a large share of all leaves for
    that. A query that finds fewer than ``k`` rows while there are more looks
    into all leaves of the forest.

    Defined cases: vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do rows with a null id; vectors of
    different lengths are no neighbours; rows that repeat an id and a direction
    count once; rows that share an id but not a direction are queries, or
    candidates, of their own;
    a table with one such row, or none, gives an empty result; other columns
    are not read. Ids must be integers.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    every = store(directed(v).withColumn("dim", F.size("vec")))
    asks = (F.col("id") % every_nth) == 0
    shapes = every.groupBy("dim").agg(F.max(asks).alias("asked")).where("asked").collect()  # a row for each length
    out = None
    for shape in shapes:
        found = _of_one_length(every.where(F.col("dim") == shape["dim"]), k, asks, trees, leaf, sample_bytes, recall)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    return out.withColumnRenamed("id", id_col)


def _of_one_length(every: DataFrame, k: int, asks, trees: int, leaf: int, sample_bytes: int, recall: float) -> DataFrame:
    ids = every.select("id", "digest").distinct()
    classes = store(every.groupBy("digest").agg(F.min("id").alias("least"), F.first("vec").alias("vec"),
                                                F.max(asks).alias("query")))
    # Two classes may have the same least id: rows get a number of their own.
    classes = store(classes.withColumn("rep", F.monotonically_increasing_id()))
    about = classes.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("query"), 1)).alias("queries")).first()
    dim = classes.select(F.size("vec")).first()[0]
    rows = classes.where(hashed(0) < share(about["n"], max(1, sample_bytes // (8 * dim)))).select("vec").toArrow()
    fit = unit_rows(rows.column(0).combine_chunks()) if rows.num_rows else np.zeros((0, dim))
    forest = Forest(fit, about["n"], trees, leaf)
    index = store(placed(classes, forest))
    queries = index.where("query")
    budget = measured_budget(forest, index, about["queries"], k, recall=recall)
    near = store(nearest_classes(index, queries, forest, budget, k))
    if about["n"] > k:
        short = (queries.join(near.groupBy("rep").agg(F.count(F.lit(1)).alias("found")), "rep", "left")
                 .where(F.coalesce("found", F.lit(0)) < k).select("rep", "vec"))
        short = store(short)
        if short.count():
            rest = nearest_classes(index, short, forest, trees * forest.leaves, k)
            near = near.join(short.select("rep"), "rep", "left_anti").unionByName(rest)
    # A query's own class comes first: its other rows have the same direction.
    near = near.unionByName(queries.select("rep", F.col("rep").alias("near"), F.lit(1.0).alias("score")))
    number = classes.select("digest", "rep")
    members = ids.join(number, "digest").select("rep", "id")
    least = Window.partitionBy("rep").orderBy("id")
    first = members.withColumn("no", F.row_number().over(least)).where(F.col("no") <= k + 1)
    of_class = near.join(first.select(F.col("rep").alias("near"), "id"), "near")
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "id")
    # k + 1 ids hold the k of every query of the class, without itself.
    of_class = store(of_class.withColumn("no", F.row_number().over(best)).where(F.col("no") <= k + 1).drop("no"))
    asked = members.where(asks).withColumnRenamed("id", "query_id")
    pairs = asked.join(of_class, "rep").where("id <> query_id OR near <> rep")
    rank = Window.partitionBy("query_id", "rep").orderBy(F.desc("score"), "id")
    return (pairs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"))

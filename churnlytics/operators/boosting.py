"""Second-order boosted trees on Spark (M4 level by level, M5 leaf by leaf).

The features are binned once: numbers by quantile edges, categories by their
vocabulary (a split takes one category against the rest, as on indicator
columns). Contracts with equal bins are one row with a count and a sum of
labels, so that a fit reads at most the distinct bins. Those rows lie in numpy
blocks that Spark keeps; one pass over the blocks adds up gradients, hessians
and counts for each (node, feature, bin) that a round asks for, and the driver,
which holds only such sums, chooses the splits. Of two children only the
smaller is summed; its sibling is the rest of the parent.

Several fits can share the binned rows and the passes (``boost`` takes a list
of parameters), which a search over parameters uses.
"""

from __future__ import annotations

import heapq
import json
import math
import pickle
from dataclasses import asdict, dataclass, field, replace
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlytics.operators.features import fit_vocabulary, stratified_folds
from churnlytics.operators.quantiles import quantiles_of_columns
from churnlytics.session import checkpoint_dir, cut_lineage

MAX_BINS = 64
BLOCK_ROWS = 16_384
CUT_EVERY = 10  # trees between two reliable checkpoints of the margins
MISSING = "missing"
TIE = 1e-10    # gains this close are equal but for rounding


@dataclass(frozen=True)
class Params:
    """Of one fit. ``leaves`` bounds a tree that grows by the best open leaf
    (M5); without it a tree fills up to ``depth`` (M4). ``features`` of a split:
    all, sqrt or log2 of their number, drawn for each node."""
    trees: int = 100
    rate: float = 0.1
    depth: int = 4
    leaves: int | None = None
    l2: float = 1.0
    min_hessian: float = 1.0
    min_rows: int = 1
    min_split: int = 2
    min_gain: float = 0.0
    subsample: float = 1.0
    features: str = "all"
    seed: int = 42


SECOND_ORDER = Params(trees=100, rate=0.1, depth=4, l2=1.0, min_hessian=1.0)
LEAF_WISE = Params(trees=100, rate=0.1, depth=5, leaves=31, l2=0.0, min_hessian=1e-3, min_rows=20)


@dataclass(frozen=True)
class Binning:
    """Bins of the features: edges of the numeric ones (bin = edges below the
    value), categories of the others (the bin after them: any other value)."""
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    medians: tuple[float, ...]
    vocabulary: tuple[tuple[str, ...], ...]

    @property
    def names(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    @property
    def sizes(self) -> list[int]:
        return [len(e) + 1 for e in self.edges] + [len(v) + 1 for v in self.vocabulary]

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)])

    def columns(self) -> list:
        """The inputs of ``bins``: doubles with the median for NULL, strings."""
        return ([F.coalesce(F.col(c).cast("double"), F.lit(m)).alias(c) for c, m in zip(self.numeric, self.medians, strict=True)]
                + [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in self.categorical])

    def bins(self, columns: Sequence) -> np.ndarray:
        """(rows x features) bins of numpy columns; NaN counts as largest."""
        out = np.empty((len(columns[0]), len(self.names)), np.int32)
        for k, e in enumerate(self.edges):
            out[:, k] = np.searchsorted(np.asarray(e, float), np.asarray(columns[k], float), side="left")
        for k, v in enumerate(self.vocabulary, len(self.edges)):
            at = {x: i for i, x in enumerate(v)}
            codes, values = pd.factorize(np.asarray(columns[k], object))
            known = np.array([at.get(x, len(v)) for x in values] + [len(v)], np.int32)
            out[:, k] = known[codes]
        return out


def fit_binning(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
                max_bins: int = MAX_BINS, max_categories: int = 1000) -> Binning:
    """Edges at the quantiles k / ``max_bins`` and medians of all numeric
    columns from one job chain; vocabularies sorted by name (``missing`` stands
    for NULL; more than ``max_categories`` raise)."""
    edges, medians = {c: set() for c in numeric}, dict.fromkeys(numeric, 0.0)
    qs = sorted({k / max_bins for k in range(1, max_bins)} | {0.5})
    if numeric:
        for row in quantiles_of_columns(train, numeric, qs).collect():  # columns x quantiles
            edges[row["column"]].add(row["value"])
            if row["q"] == 0.5:
                medians[row["column"]] = row["value"]
    filled = train.select(*[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in categorical])
    return Binning(tuple(numeric), tuple(categorical), tuple(tuple(sorted(edges[c])) for c in numeric),
                   tuple(medians[c] for c in numeric),
                   tuple(tuple(fit_vocabulary(filled, c, limit=max_categories)) for c in categorical))


@dataclass
class Block:
    """Distinct bins (flat: with the feature's offset), how many contracts have
    them, how many of these are positive, their fold, and each fit's margins."""
    no: int
    bins: np.ndarray
    n: np.ndarray
    positive: np.ndarray
    fold: np.ndarray
    margins: np.ndarray | None = None


def binned_blocks(train: DataFrame, binning: Binning, label: str = "event", fold: str | None = None):
    """(RDD of blocks, contracts, positives) of the rows with a label of 0 or 1."""
    names = [f"b{k}" for k in range(len(binning.names))]
    rows = train.where(F.col(label).isin(0, 1)).select(
        *binning.columns(), F.col(label).cast("int").alias("_label"),
        (F.col(fold).cast("int") if fold else F.lit(0)).alias("_fold"))
    rows = rows.toDF(*[f"c{k}" for k in range(len(names))], "label", "fold")

    def to_bins(batches):
        for batch in batches:
            flat = binning.bins([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-2]])
            yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in flat.T.copy()], *batch.columns[-2:]],
                                             names=[*names, "label", "fold"])

    schema = ", ".join(f"{c} int" for c in (*names, "label", "fold"))
    distinct = cut_lineage(rows.mapInArrow(to_bins, schema).groupBy(*names, "fold")
                           .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positive")))
    about = distinct.agg(F.count(F.lit(1)), F.sum("n"), F.sum("positive")).first()
    parts = max(1, -(-about[0] // BLOCK_ROWS))
    offsets = binning.offsets[:-1].astype(np.int32)

    def pack(batches):
        batches = list(batches)
        table = pa.Table.from_batches(batches) if batches else None
        if table is not None and table.num_rows:
            columns = [c.to_numpy() for c in table.columns]
            order = np.lexsort(columns[:len(names) + 1])  # the same block in any order of arrival
            columns = [c[order] for c in columns]
            block = Block(int(columns[0][0]) + len(order), np.asfortranarray(np.stack(columns[:len(names)], axis=1) + offsets),
                          columns[-2].astype(float), columns[-1].astype(float), columns[len(names)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

    blocks = distinct.repartition(parts, *names).mapInArrow(pack, "block binary")
    return blocks.rdd.map(lambda row: pickle.loads(row[0])), int(about[1] or 0), int(about[2] or 0)


@dataclass
class Tree:
    """Nodes in the order in which they came to be; the root is 0. A row goes
    left where its bin is at most ``cut`` (numbers) or is not ``cut``
    (categories). ``value`` is the leaf weight times the rate."""
    feature: list[int] = field(default_factory=list)  # -1: a leaf
    cut: list[int] = field(default_factory=list)      # flat bin
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    rows: list[float] = field(default_factory=list)

    def add(self, value: float, rows: float) -> int:
        for a, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, value),
                     (self.gain, 0.0), (self.rows, rows)):
            a.append(x)
        return len(self.feature) - 1

    def leaf(self, bins: np.ndarray, n_numeric: int) -> np.ndarray:
        """Leaf (so far) of every row of flat bins."""
        feature, cut, left, right = (np.array(a, np.int64) for a in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        moving = np.arange(len(bins)) if self.feature and feature[0] >= 0 else np.zeros(0, np.int64)
        while len(moving):
            node = at[moving]
            node = np.where(goes_left(bins[moving, feature[node]], cut[node], feature[node] < n_numeric), left[node], right[node])
            at[moving] = node
            moving = moving[feature[node] >= 0]
        return at


def goes_left(bins, cut, ordered):
    return np.where(ordered, bins <= cut, bins != cut)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def bag(block: Block, params: Params, tree: int, held: int | None):
    """(contracts, positives) of a block's rows in a tree's sample: without the
    held fold, thinned by the share that the tree sees."""
    keep = 1.0 if held is None else (block.fold != held).astype(float)
    n, positive = block.n * keep, block.positive * keep
    if params.subsample < 1:
        rng = np.random.default_rng([params.seed, tree, block.no])
        yes = rng.binomial(positive.astype(np.int64), params.subsample)
        no = rng.binomial((n - positive).astype(np.int64), params.subsample)
        n, positive = (yes + no).astype(float), yes.astype(float)
    return n, positive


def histograms(block: Block, fit: int, params: Params, number: int, held: int | None, tree: Tree,
               wanted: Sequence[tuple[int, int, int, bool]], n_numeric: int, total: int) -> np.ndarray:
    """(wanted x flat bins x 3) sums of gradient, hessian and contracts. A
    wanted part is (node, feature, cut, left): the side of a leaf's coming
    split, the whole leaf with feature -1."""
    n, positive = bag(block, params, number, held)
    p = sigmoid(block.margins[fit])
    sums = np.stack([n * p - positive, n * p * (1 - p), n])
    at = tree.leaf(block.bins, n_numeric)
    out = np.zeros((len(wanted), total, 3))
    for k, (node, feature, cut, left) in enumerate(wanted):
        rows = np.flatnonzero(at == node)
        if feature >= 0:
            rows = rows[goes_left(block.bins[rows, feature], cut, feature < n_numeric) == left]
        own = sums[:, rows]
        for f in range(block.bins.shape[1]):
            flat = block.bins[rows, f]
            for j in range(3):
                out[k, :, j] += np.bincount(flat, own[j], minlength=total)
    return out


class Splitter:
    """Best splits from the sums of a node's bins."""

    def __init__(self, binning: Binning, params: Params):
        self.p, self.offsets, self.n_numeric = params, binning.offsets, len(binning.numeric)
        self.total, self.n_features = int(self.offsets[-1]), len(binning.names)

    def weight(self, g: float, h: float) -> float:
        return -g / (h + self.p.l2) if h + self.p.l2 > 0 else 0.0

    def candidates(self, sums: np.ndarray, feature: int):
        """(flat cuts, left sums) of every split of one feature."""
        a, z = self.offsets[feature], self.offsets[feature + 1]
        if feature < self.n_numeric:
            return np.arange(a, z - 1), np.cumsum(sums[a:z], axis=0)[:-1]
        return np.arange(a, z - 1), sums[a:z].sum(axis=0) - sums[a:z - 1]

    def best(self, sums: np.ndarray, key: Sequence[int] = ()):
        """(gain, feature, cut, left sums, right sums), ties to the first
        feature and cut; None where no split gains."""
        p, chosen = self.p, range(self.n_features)
        if p.features != "all":
            most = max(1, int(math.sqrt(self.n_features) if p.features == "sqrt" else math.log2(self.n_features)))
            chosen = sorted(np.random.default_rng([p.seed, *key]).permutation(self.n_features)[:most].tolist())
        node = sums[self.offsets[0]:self.offsets[1]].sum(axis=0)
        if node[2] < p.min_split:
            return None
        found = None
        for f in chosen:
            cuts, left = self.candidates(sums, f)
            right = node - left
            ok = ((left[:, 1] >= p.min_hessian) & (right[:, 1] >= p.min_hessian)
                  & (left[:, 2] >= max(p.min_rows, 1)) & (right[:, 2] >= max(p.min_rows, 1)))
            if not ok.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = 0.5 * (left[:, 0] ** 2 / (left[:, 1] + p.l2) + right[:, 0] ** 2 / (right[:, 1] + p.l2)
                              - node[0] ** 2 / (node[1] + p.l2))
            gain = np.where(ok, gain, -np.inf)
            k = int((gain >= gain.max() * (1 - TIE)).argmax()) if gain.max() > 0 else int(gain.argmax())
            if gain[k] > p.min_gain + 1e-12 and (found is None or gain[k] > found[0] * (1 + TIE)):
                found = (float(gain[k]), f, int(cuts[k]), left[k], right[k])
        return found


class Grower:
    """One tree, grown by its best open leaf. ``wanted`` names the sums that it
    needs next; ``give`` takes them. Sums of the children of every leaf that may
    still be split are asked for together, so a tree takes a pass for each
    level, and the order of splits is that of one leaf at a time."""

    def __init__(self, splitter: Splitter, number: int):
        self.s, self.p, self.number = splitter, splitter.p, number
        self.most = self.p.leaves or 1 << self.p.depth
        self.tree, self.depth, self.done = Tree(), {}, False
        self.open: list = []       # heap of (-gain, node, split, sums)
        self.ahead: dict = {}      # node -> sums of its left and right child
        self.asked: list | None = None

    def wanted(self) -> list[tuple[int, int, int, bool]]:
        if not self.tree.feature:
            self.asked = [(-1, None, None)]
            return [(0, -1, 0, True)]
        left_over = self.most - (len(self.tree.feature) + 1) // 2
        self.asked, out = [], []
        for _, node, split, sums in heapq.nsmallest(left_over, self.open):
            if node not in self.ahead and self.depth[node] + 1 < self.p.depth:
                small_left = bool(split[3][2] <= split[4][2])
                self.asked.append((node, small_left, sums))
                out.append((node, split[1], split[2], small_left))
        return out

    def give(self, sums: np.ndarray) -> None:
        for (node, small_left, parent), got in zip(self.asked, sums, strict=True):
            if node < 0:
                g, h, n = got[self.s.offsets[0]:self.s.offsets[1]].sum(axis=0)
                self._open(self._leaf(g, h, n, 0), got)
            else:
                self.ahead[node] = (got, parent - got) if small_left else (parent - got, got)
        self._split()

    def _leaf(self, g: float, h: float, n: float, depth: int) -> int:
        node = self.tree.add(self.p.rate * self.s.weight(g, h), n)
        self.depth[node] = depth
        return node

    def _open(self, node: int, sums: np.ndarray) -> None:
        if self.depth[node] < self.p.depth:
            split = self.s.best(sums, (self.number, node))
            if split is not None:
                heapq.heappush(self.open, (-split[0], node, split, sums))

    def _split(self) -> None:
        waiting = []
        while self.open and (len(self.tree.feature) + 1) // 2 < self.most:
            node = self.open[0][1]
            last = self.depth[node] + 1 >= self.p.depth
            if not last and node not in self.ahead:
                if self.p.leaves:
                    return
                waiting.append(heapq.heappop(self.open))  # a full tree has no order of splits to keep
                continue
            _, node, (gain, feature, cut, left, right), _ = heapq.heappop(self.open)
            t = self.tree
            t.feature[node], t.cut[node], t.gain[node] = feature, cut, gain
            t.left[node] = self._leaf(*left, self.depth[node] + 1)
            t.right[node] = self._leaf(*right, self.depth[node] + 1)
            if not last:
                for child, sums in zip((t.left[node], t.right[node]), self.ahead.pop(node), strict=True):
                    self._open(child, sums)
        self.open = waiting or self.open
        self.done = not waiting


@dataclass
class BoostedModel:
    """A fitted model: margin = base + the leaf values of its trees."""
    binning: Binning
    params: Params
    base: float
    trees: list[Tree]

    def margins(self, bins: np.ndarray, upto: int | None = None) -> np.ndarray:
        """Margins of rows of flat bins, by all trees or the first ``upto``."""
        out = np.full(len(bins), self.base)
        for t in self.trees[:upto]:
            out += np.array(t.value)[t.leaf(bins, len(self.binning.numeric))]
        return out

    def transform(self, df: DataFrame, upto: int | None = None) -> DataFrame:
        """``df`` with ``score`` = P(label = 1) and ``predicted`` (score >= 0.5)."""
        offsets = self.binning.offsets[:-1]

        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                flat = self.binning.bins([c.to_numpy() for c in columns]) + offsets
                yield pd.Series(sigmoid(self.margins(flat, upto)))

        out = df.withColumn("score", F.pandas_udf(score, "double")(*self.binning.columns()))
        return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

    def importances(self) -> list[tuple[str, float]]:
        """O3: share of the gain by feature, largest first."""
        gain = dict.fromkeys(self.binning.names, 0.0)
        for t in self.trees:
            for f, x in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    gain[self.binning.names[f]] += x
        total = sum(gain.values()) or 1.0
        return sorted(((k, v / total) for k, v in gain.items()), key=lambda x: (-x[1], x[0]))

    def table(self, spark, tree: int = 0) -> DataFrame:
        """One tree as rows: node, feature, threshold or category, children,
        gain, contracts, leaf value."""
        b, t, rows = self.binning, self.trees[tree], []
        for k, f in enumerate(t.feature):
            at = int(t.cut[k] - b.offsets[f]) if f >= 0 else 0
            number = f >= 0 and f < len(b.numeric)
            rows.append((k, b.names[f] if f >= 0 else None, float(b.edges[f][at]) if number else None,
                         b.vocabulary[f - len(b.numeric)][at] if f >= len(b.numeric) else None,
                         t.left[k] if f >= 0 else None, t.right[k] if f >= 0 else None,
                         float(t.gain[k]), int(t.rows[k]), float(t.value[k])))
        return spark.createDataFrame(rows, "node int, feature string, threshold double, category string, "
                                           "left int, right int, gain double, n long, value double")

    def save(self, spark, path: str) -> None:
        """M8: one JSON row under ``path``."""
        text = json.dumps({"binning": asdict(self.binning), "params": asdict(self.params), "base": self.base,
                           "trees": [asdict(t) for t in self.trees]})
        spark.createDataFrame([(text,)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> BoostedModel:
        m = json.loads(spark.read.parquet(path).first()["model"])
        b = {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) for k, v in m["binning"].items()}
        return BoostedModel(Binning(**b), Params(**m["params"]), m["base"], [Tree(**t) for t in m["trees"]])


def boost(blocks, binning: Binning, fits: Sequence[Params], base: float, held: Sequence[int | None] | None = None) -> list[BoostedModel]:
    """Fit every ``Params`` on the same blocks, in the same passes. ``held``
    names a fold that a fit does not see."""
    held = list(held or [None] * len(fits))
    models = [BoostedModel(binning, p, base, []) for p in fits]
    splitters = [Splitter(binning, p) for p in fits]
    n_numeric, total = len(binning.numeric), int(binning.offsets[-1])
    checkpoint_dir(_session())

    def begin(block: Block) -> Block:
        block.margins = np.full((len(fits), len(block.n)), base)
        return block

    state, late = _kept(blocks.map(begin), None), []  # late: trees that the kept margins do not hold yet
    parts = state.getNumPartitions()
    for number in range(max((p.trees for p in fits), default=0)):
        growers = {k: Grower(splitters[k], number) for k, p in enumerate(fits) if number < p.trees}
        while any(not g.done for g in growers.values()):
            asks = [(k, fits[k], number, held[k], g.tree, w) for k, g in growers.items() if not g.done and (w := g.wanted())]
            sums, at = _summed(state, parts, late, asks, n_numeric, total), 0
            for k, *_, w in asks:
                growers[k].give(sums[at:at + len(w)])
                at += len(w)
        late = [*late, {k: g.tree for k, g in growers.items()}]
        for k, g in growers.items():
            models[k].trees.append(g.tree)
        if len(late) == CUT_EVERY:
            state, late = _kept(state.map(lambda b, late=late: moved(b, late, n_numeric)), state), []
    state.unpersist()
    return models


def _session():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def moved(block: Block, late: Sequence[dict[int, Tree]], n_numeric: int) -> Block:
    """The block with the trees' values added to the margins of their fits."""
    block.margins = block.margins.copy()
    for trees in late:
        for k, t in trees.items():
            block.margins[k] += np.array(t.value)[t.leaf(block.bins, n_numeric)]
    return block


def _kept(state, former):
    """``state`` kept by Spark and checkpointed, in place of ``former``."""
    state = state.persist(StorageLevel.MEMORY_AND_DISK)
    state.checkpoint()
    state.count()
    if former is not None:
        former.unpersist()
    return state


def _summed(state, parts: int, late, asks, n_numeric: int, total: int) -> np.ndarray:
    """The wanted sums of all fits, one pass over the blocks."""

    def of_part(blocks):
        out = None
        for b in blocks:
            b = moved(b, late, n_numeric)
            got = np.concatenate([histograms(b, k, p, no, held, t, w, n_numeric, total) for k, p, no, held, t, w in asks])
            out = got if out is None else out + got
        if out is not None:
            yield out

    found = state.mapPartitions(of_part)
    empty = np.zeros((sum(len(a[-1]) for a in asks), total, 3))
    if parts <= 32:  # so few that the driver adds them up
        return sum(found.collect(), empty)
    return found.treeAggregate(empty, np.add, np.add, depth=2)


def fit_boosted(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), params: Params = SECOND_ORDER,
                label: str = "event", max_bins: int = MAX_BINS) -> BoostedModel:
    """One model. The first margin is the log odds of the positive share; rows
    with a label other than 0 or 1 are not read; without both labels all
    scores are that share."""
    binning = fit_binning(train, numeric, categorical, max_bins)
    blocks, n, positive = binned_blocks(train, binning, label)
    base = log_odds(n, positive)
    return boost(blocks, binning, [params if 0 < positive < n else Params(trees=0)], base)[0]


def log_odds(n: int, positive: int) -> float:
    share = min(max(positive / n if n else 0.5, 1e-9), 1 - 1e-9)
    return math.log(share / (1 - share))


MARGIN, CELLS = 12.0, 2048  # margins beyond +-12 share the outer cells


def staged_auc(blocks, models: Sequence[BoostedModel], held: Sequence[int], stages: Sequence[int]) -> np.ndarray:
    """(models x stages) AUC on each model's held fold after so many trees: one
    fit gives every number of trees, by a running sum over its trees. Margins
    are counted in 2048 cells of 0.012 log odds; pairs within a cell count one
    half, so an AUC is off by at most half the share of such pairs."""

    def count(block: Block) -> np.ndarray:
        out = np.zeros((len(models), len(stages), 2, CELLS))
        for k, (m, fold) in enumerate(zip(models, held, strict=True)):
            rows = np.flatnonzero(block.fold == fold)
            bins, positive = block.bins[rows], block.positive[rows]
            negative, f, done = block.n[rows] - positive, np.full(len(rows), m.base), 0
            for s, upto in enumerate(stages):
                for t in m.trees[done:upto]:
                    f = f + np.array(t.value)[t.leaf(bins, len(m.binning.numeric))]
                done = max(done, min(upto, len(m.trees)))
                cell = np.clip(((f + MARGIN) * (CELLS / (2 * MARGIN))).astype(np.int64), 0, CELLS - 1)
                out[k, s, 0] = np.bincount(cell, negative, CELLS)
                out[k, s, 1] = np.bincount(cell, positive, CELLS)
        return out

    sums = blocks.map(count).treeReduce(np.add)
    negative, positive = sums[:, :, 0], sums[:, :, 1]
    below = np.cumsum(negative, axis=2) - negative
    with np.errstate(invalid="ignore"):
        return (positive * (below + 0.5 * negative)).sum(axis=2) / (positive.sum(axis=2) * negative.sum(axis=2))


def search(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], trials: Sequence[Params], folds: int = 5,
           stage: int = 10, together: int = 4, label: str = "event", id_col: str = "id", max_bins: int = MAX_BINS,
           seed: int = 0) -> tuple[BoostedModel, list[dict]]:
    """M7: k-fold search over parameters and numbers of trees.

    Folds are exact and balanced by class. The bins are made once; ``together``
    trials share every pass, each with one fit a fold that does not see its
    fold. Each fit is scored on that fold after every ``stage`` trees, so a
    trial's number of trees is an upper bound, and nothing is stopped by the
    rows that score it. The pair of trial and number of trees with the best
    mean AUC (the fewest trees, the first trial of equals) is fitted on all
    rows, with that number of trees. Returns that model and a row for each
    (trial, trees): ``{"trial", "trees", "auc"}``."""
    data = stratified_folds(train.where(F.col(label).isin(0, 1)), folds, label, id_col, seed, "_boost_fold")
    binning = fit_binning(train, numeric, categorical, max_bins)
    blocks, n, positive = binned_blocks(data, binning, label, "_boost_fold")
    if not 0 < positive < n or n < 2 * folds:
        raise ValueError("a search needs rows of both labels in every fold")
    checkpoint_dir(_session())
    blocks, base, rows = _kept(blocks, None), log_odds(n, positive), []
    for a in range(0, len(trials), together):
        chunk = list(trials[a:a + together])
        held = list(range(folds)) * len(chunk)
        models = boost(blocks, binning, [p for p in chunk for _ in range(folds)], base, held)
        for k, p in enumerate(chunk):
            stages = sorted({*range(stage, p.trees, stage), p.trees})
            auc = staged_auc(blocks, models[k * folds:(k + 1) * folds], range(folds), stages).mean(axis=0)
            rows += [{"trial": a + k, "trees": t, "auc": float(x)} for t, x in zip(stages, auc, strict=True)]
    best = max(rows, key=lambda r: (r["auc"], -r["trees"], -r["trial"]))
    model = boost(blocks, binning, [replace(trials[best["trial"]], trees=best["trees"])], base)[0]
    blocks.unpersist()
    return model, rows

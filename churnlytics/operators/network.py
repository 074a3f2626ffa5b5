"""Feed-forward network by mini-batch gradients on Spark (M6).

Hidden layers with ReLU, optional normalisation and dropout, one sigmoid output,
cross-entropy with class weights, Adam, a rate that falls on a plateau, and a
held-out share of the training rows that stops the fit and picks its weights.

The rows are dealt by the hash of their content into numbered blocks; a
mini-batch is a fixed set of blocks, and a shard, one Spark partition, holds the
blocks of up to max(16, the square root of their number) mini-batches. An epoch is
one job: every shard starts from the common weights, steps through its
mini-batches in the epoch's order, and the weights, moments and running means of
the shards, weighted by their rows, are averaged on the driver. So an epoch takes
one step a mini-batch as ever, but no job a step; 16 mini-batches or fewer are one
shard, whose steps are plain mini-batch descent. The driver gets one set of weights
a shard, whose number grows with the square root of the rows. Dropout masks are a
hash of (seed, epoch, layer, row, unit) and the shards depend on the rows alone: a
partition that Spark computes again gives the same weights. With
``normalise`` each block uses its own mean and variance, as data-parallel
trainers do, and the running means serve for scoring.
"""

from __future__ import annotations

import json
import math
import pickle
from dataclasses import asdict, dataclass, field
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 1_024
SHARD_BATCHES, HELD_BLOCKS = 16, 64           # the least mini-batches of a shard; blocks of a partition of held rows
MOMENTUM, EPSILON = 0.9, 1e-3                 # of the running means (steps are large); of the normalisation
ADAM_MEAN, ADAM_SQUARE, ADAM_LEAST = 0.9, 0.999, 1e-7
MASK_CELLS = 8_192                            # hashed at a time: they stay in a core's cache
_GOLDEN, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


@dataclass(frozen=True)
class Params:
    """Of one fit. ``dropout`` and ``l2`` hold one value a hidden layer. The fit
    ends when the held rows' loss has not fallen for ``stop_after`` epochs; the
    rate is multiplied by ``lower_by`` after ``lower_after`` such epochs."""
    hidden: tuple[int, ...] = (64, 32)
    dropout: tuple[float, ...] = (0.2, 0.2)
    l2: tuple[float, ...] = (0.0, 0.0)
    normalise: bool = False
    rate: float = 0.001
    epochs: int = 100
    batch_rows: int = 4_096
    held: float = 0.2
    stop_after: int = 10
    lower_after: int | None = None
    lower_by: float = 0.5
    least_rate: float = 1e-5
    weighted: bool = False
    seed: int = 42

    def __post_init__(self):
        if not len(self.hidden) == len(self.dropout) == len(self.l2):
            raise ValueError("hidden, dropout and l2 have one value a layer")
        if not 0 < self.held < 1 or any(not 0 <= d < 1 for d in self.dropout):
            raise ValueError("held lies between 0 and 1, dropout in [0, 1)")


# The two layouts.
SMALL = Params()
LARGE = Params(hidden=(128, 64, 32), dropout=(0.3, 0.3, 0.2), l2=(0.0, 0.0, 0.001), normalise=True, epochs=150,
               stop_after=15, lower_after=5, weighted=True)


@dataclass
class Block:
    """Rows of one partition in the order of their hashes."""
    x: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    row: np.ndarray  # uint64 hashes


class Room:
    """Arrays that are filled again for every block of a task. Fresh ones of a
    block's size are pages that the system clears first, which took as long as
    the arithmetic."""

    def __init__(self):
        self.kept: dict = {}

    def __call__(self, name, *shape: int, dtype=np.float64) -> np.ndarray:
        """The array of that name, with what was last written there."""
        n = math.prod(shape)
        own = self.kept.get(name)
        if own is None or own.size < n:
            own = self.kept[name] = np.empty(n + n // 8, dtype)
        return own[:n].reshape(shape)


def mixed(x: np.ndarray, shifted: np.ndarray | None = None) -> np.ndarray:
    """Well spread 64-bit hashes of 64-bit numbers; with ``shifted``, an array of
    that shape to work in, they replace the numbers."""
    if shifted is None:
        x, shifted = x.copy(), np.empty_like(x)
    x ^= np.right_shift(x, np.uint64(30), out=shifted)
    x *= _MIX1
    x ^= np.right_shift(x, np.uint64(27), out=shifted)
    x *= _MIX2
    x ^= np.right_shift(x, np.uint64(31), out=shifted)
    return x


def undropped(rows: np.ndarray, units: int, share: float, key: tuple[int, int, int], out: np.ndarray) -> np.ndarray:
    """``out`` (rows x units), true where a unit is not dropped; ``key`` is (seed,
    epoch, layer)."""
    with np.errstate(over="ignore"):
        salt = np.zeros(1, np.uint64)
        for k in key:
            salt = mixed(salt * _GOLDEN + np.uint64(k + 1))
        of_row, of_unit = mixed(rows ^ salt)[:, None], np.arange(1, units + 1, dtype=np.uint64) * _GOLDEN
    least = np.uint64(math.ceil(share * 2.0 ** 53) << 11)
    size = max(1, MASK_CELLS // units)
    cells, shifted = np.empty((2, size, units), np.uint64)
    for i in range(0, len(rows), size):
        part = out[i:i + size]
        own = np.add(of_row[i:i + size], of_unit, out=cells[:len(part)])
        np.greater_equal(mixed(own, shifted[:len(part)]), least, out=part)
    return out


def dropout_mask(rows: np.ndarray, units: int, share: float, key: tuple[int, int, int]) -> np.ndarray:
    """(rows x units) of 0 where dropped, else 1 / (1 - share), so that sums keep
    their size; ``key`` is (seed, epoch, layer)."""
    return undropped(rows, units, share, key, np.empty((len(rows), units), bool)) / (1.0 - share)


class Shape:
    """Where each layer's numbers lie in the flat weights."""

    def __init__(self, width: int, params: Params):
        self.width, self.p = width, params
        self.sizes = [width, *params.hidden, 1]
        self.slices, at = [], 0
        for k, (a, b) in enumerate(zip(self.sizes, self.sizes[1:])):
            hidden = k < len(params.hidden)
            parts = {"w": (a, b), "b": (b,)}
            if hidden and params.normalise:
                parts |= {"gamma": (b,), "beta": (b,)}
            places = {}
            for name, shape in parts.items():
                n = int(np.prod(shape))
                places[name] = (slice(at, at + n), shape)
                at += n
            self.slices.append(places)
        self.total = at

    def view(self, flat: np.ndarray, layer: int) -> dict[str, np.ndarray]:
        return {k: flat[s].reshape(shape) for k, (s, shape) in self.slices[layer].items()}

    def start(self) -> np.ndarray:
        """Uniform weights within sqrt(6 / (inputs + outputs)), the rest 0, scales 1."""
        rng, flat = np.random.default_rng(self.p.seed), np.zeros(self.total)
        for k, (a, b) in enumerate(zip(self.sizes, self.sizes[1:])):
            own = self.view(flat, k)
            most = np.sqrt(6.0 / (a + b))
            own["w"][:] = rng.uniform(-most, most, (a, b))
            if "gamma" in own:
                own["gamma"][:] = 1.0
        return flat

    def fresh_means(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.zeros(b), np.ones(b)) for b in self.p.hidden] if self.p.normalise else []


def scores(shape: Shape, flat: np.ndarray, means, x: np.ndarray, room: Room | None = None) -> np.ndarray:
    """Margins of rows, without dropout, normalised by the running means."""
    a, room = x, room or Room()
    for k, units in enumerate(shape.p.hidden):
        own = shape.view(flat, k)
        z = np.matmul(a, own["w"], out=room(("z", k), len(x), units))
        z += own["b"]
        if shape.p.normalise:
            z -= means[k][0]
            z *= own["gamma"]
            z /= np.sqrt(means[k][1] + EPSILON)
            z += own["beta"]
        a = np.maximum(z, 0.0, out=z)
    own = shape.view(flat, len(shape.p.hidden))
    return (a @ own["w"] + own["b"])[:, 0]


def losses(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, margin) - y * margin


def gradient(shape: Shape, flat: np.ndarray, block: Block, epoch: int, room: Room | None = None):
    """Sums over a block's rows: (gradient of the weighted loss, loss, rows, and
    the block's means and variances of the normalised layers). What is as long as
    the block lies in ``room``."""
    p, a, kept, stats = shape.p, block.x, [], []
    n, room = len(block.y), room or Room()
    for k, units in enumerate(p.hidden):
        own = shape.view(flat, k)
        z = np.matmul(a, own["w"], out=room(("z", k), n, units))
        z += own["b"]
        norm = None
        if p.normalise:
            mean = z.mean(axis=0)
            z -= mean
            var = np.multiply(z, z, out=room("work", n, units)).mean(axis=0)
            stats.append((mean, var))
            scale = 1.0 / np.sqrt(var + EPSILON)
            z *= scale
            norm = (z, scale)
            z = np.multiply(z, own["gamma"], out=room(("out", k), n, units))
            z += own["beta"]
        on = np.greater(z, 0.0, out=room("on", n, units, dtype=bool))
        if p.dropout[k]:
            on &= undropped(block.row, units, p.dropout[k], (p.seed, epoch, k), room("undropped", n, units, dtype=bool))
        live = np.multiply(on, 1.0 / (1.0 - p.dropout[k]), out=room(("live", k), n, units))
        z *= live
        kept.append((a, norm, live))
        a = z
    last = len(p.hidden)
    own, grad = shape.view(flat, last), np.zeros(shape.total)
    margin = (a @ own["w"] + own["b"])[:, 0]
    loss = float((block.weight * losses(margin, block.y)).sum())
    d = (block.weight * (1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500))) - block.y))[:, None]
    g = shape.view(grad, last)
    g["w"][:], g["b"][:] = a.T @ d, d.sum(axis=0)
    for k in reversed(range(last)):
        d = np.matmul(d, own["w"].T, out=room(("d", k), n, p.hidden[k]))
        before, norm, live = kept[k]
        own, g = shape.view(flat, k), shape.view(grad, k)
        d *= live
        if norm is not None:
            work = room("work", *d.shape)
            g["gamma"][:], g["beta"][:] = np.multiply(d, norm[0], out=work).sum(axis=0), d.sum(axis=0)
            d *= own["gamma"]
            along = np.multiply(d, norm[0], out=work).mean(axis=0)
            d -= d.mean(axis=0)
            d -= np.multiply(norm[0], along, out=work)
            d *= norm[1]
        np.matmul(before.T, d, out=g["w"])
        g["b"][:] = d.sum(axis=0)
    return grad, loss, n, stats


class Adam:
    def __init__(self, n: int):
        self.mean, self.square, self.step = np.zeros(n), np.zeros(n), 0

    def move(self, flat: np.ndarray, grad: np.ndarray, rate: float) -> np.ndarray:
        self.step += 1
        self.mean = ADAM_MEAN * self.mean + (1 - ADAM_MEAN) * grad
        self.square = ADAM_SQUARE * self.square + (1 - ADAM_SQUARE) * grad * grad
        up = rate * np.sqrt(1 - ADAM_SQUARE ** self.step) / (1 - ADAM_MEAN ** self.step)
        return flat - up * self.mean / (np.sqrt(self.square) + ADAM_LEAST)


@dataclass
class NetworkModel:
    """Fitted weights (bounded: the layers' sizes) and the course of the fit:
    (epoch, training loss, held loss, rate). ``best`` is the epoch whose weights
    the model has."""
    width: int
    params: Params
    flat: np.ndarray
    means: list
    history: list = field(default_factory=list)
    best: int = 0

    def transform(self, vectors: DataFrame, features: str = "features") -> DataFrame:
        """``vectors`` with ``score`` = P(event = 1) and ``predicted`` (score > 0.5)."""
        shape, flat, means = Shape(self.width, self.params), self.flat, self.means

        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            room = Room()
            for x in batches:
                m = scores(shape, flat, means, np.stack(x.to_numpy()), room) if len(x) else np.zeros(0)
                yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(m, -500, 500))))

        out = vectors.withColumn("score", F.pandas_udf(score, "double")(vector_to_array(features)))
        return out.withColumn("predicted", (F.col("score") > 0.5).cast("int"))

    def course(self, spark) -> DataFrame:
        """The learning curve as rows."""
        return spark.createDataFrame(self.history, "epoch int, loss double, held_loss double, rate double")

    def save(self, spark, path: str) -> None:
        """M8: one JSON row under ``path``."""
        text = json.dumps({"width": self.width, "params": asdict(self.params), "flat": self.flat.tolist(), "best": self.best,
                           "means": [[a.tolist() for a in m] for m in self.means], "history": self.history})
        spark.createDataFrame([(text,)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> NetworkModel:
        m = json.loads(spark.read.parquet(path).first()["model"])
        params = Params(**{k: tuple(v) if isinstance(v, list) else v for k, v in m["params"].items()})
        return NetworkModel(m["width"], params, np.array(m["flat"]), [tuple(map(np.array, x)) for x in m["means"]],
                            [tuple(h) for h in m["history"]], m["best"])


def _dealt(vectors: DataFrame, params: Params, label: str, features: str, weight: str | None):
    """The rows with the ``slot`` of their block, the number of mini-batches, the
    blocks of each, and the number of held blocks (the last slots). Equal rows lie
    in the same block."""
    n = vectors.count()
    if n == 0:
        raise ValueError("no rows to train on")
    of_batch = max(1, -(-params.batch_rows // BLOCK_ROWS))
    batches = max(1, round(n * (1 - params.held) / params.batch_rows))
    held = max(1, round(n * params.held / BLOCK_ROWS))
    x = vector_to_array(features)
    h = F.xxhash64(x, F.col(label), F.lit(params.seed), *[F.col(c) for c in vectors.columns if c == "id"])
    rows = vectors.select(h.alias("row"), F.col(label).cast("double").alias("y"),
                          (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"), x.alias("x"))
    dice = F.xxhash64("row", F.lit(1))
    slot = F.when(F.pmod(dice, F.lit(1_000_000)) < int(params.held * 1_000_000),
                  batches * of_batch + F.pmod(F.xxhash64("row", F.lit(2)), F.lit(held))) \
        .otherwise(F.pmod(F.xxhash64("row", F.lit(3)), F.lit(batches * of_batch)))
    return rows.withColumn("slot", slot.cast("int")), batches, of_batch, held


def _packed(rows: DataFrame, partitions: int, partition):
    """A persisted RDD of (slot, block); ``partition`` is the column that deals the slots."""
    def pack(arrived):
        arrived = [b for b in arrived if b.num_rows]
        if arrived:
            table = pa.Table.from_batches(arrived).combine_chunks()
            row = table["row"].to_numpy().astype(np.int64).view(np.uint64)
            values = table["x"].combine_chunks().flatten().to_numpy().reshape(len(row), -1)
            y, w, slot = table["y"].to_numpy(), table["weight"].to_numpy(), table["slot"].to_numpy()
            order = np.lexsort((w, y, row, slot))
            for own in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1):
                block = Block(np.ascontiguousarray(values[own]), y[own], w[own], row[own])
                yield pa.RecordBatch.from_arrays([pa.array([slot[own[0]]], pa.int32()), pa.array([pickle.dumps(block)], pa.binary())],
                                                 names=["slot", "block"])

    dealt = rows.withColumn("part", partition.cast("int")).repartitionById(partitions, "part").drop("part")
    return dealt.mapInArrow(pack, "slot int, block binary").rdd.map(lambda r: (r[0], pickle.loads(r[1]))) \
        .persist(StorageLevel.MEMORY_AND_DISK)


def dealt_blocks(vectors: DataFrame, params: Params, label: str, features: str, weight: str | None):
    """An RDD with one block a partition, the partitions of every mini-batch,
    and those of the held rows: the blocks that ``dealt_shards`` puts together."""
    rows, batches, of_batch, held = _dealt(vectors, params, label, features, weight)
    total = batches * of_batch + held
    blocks = _packed(rows, total, F.col("slot")).map(lambda b: b[1])
    return (blocks, [list(range(k * of_batch, (k + 1) * of_batch)) for k in range(batches)],
            list(range(batches * of_batch, total)))


def dealt_shards(vectors: DataFrame, params: Params, label: str, features: str, weight: str | None):
    """RDDs of (slot, block) of the training and of the held rows, and the blocks of
    a mini-batch. A partition of the first holds whole mini-batches, see ``shards_of``."""
    rows, batches, of_batch, held = _dealt(vectors, params, label, features, weight)
    first, shards, parts = batches * of_batch, shards_of(batches), -(-held // HELD_BLOCKS)
    batch = F.floor(F.col("slot") / of_batch)
    return (_packed(rows.where(F.col("slot") < first), shards, F.floor(batch * shards / batches)),
            _packed(rows.where(F.col("slot") >= first), parts, F.floor((F.col("slot") - first) * parts / held)), of_batch)


def shards_of(batches: int) -> int:
    """How many shards hold so many mini-batches."""
    return -(-batches // max(SHARD_BATCHES, math.isqrt(batches)))


def fit_network(vectors: DataFrame, params: Params = SMALL, label: str = "event", features: str = "features",
                weight: str | None = "weight") -> NetworkModel:
    """Fit on rows ``(label, features[, weight, id])``; cut their lineage before
    (``models.prepare`` does), the blocks are dealt from them once.

    ``weight`` balances the classes where ``params.weighted``; the held loss is
    without weights. Rows with a NULL label count for nothing and are left out;
    no rows, or none left to train on or to hold, raise ValueError. Vectors have
    one length."""
    vectors = vectors.where(F.col(label).isNotNull())
    train, held, of_batch = dealt_shards(vectors, params, label, features, weight if params.weighted else None)
    try:
        # One pass fills the blocks and gives their sizes.
        sizes = train.map(lambda b: (b[0] // of_batch, b[1].x.shape[1])).distinct().collect()
        if not sizes or held.isEmpty():
            raise ValueError("too few rows to train on and to hold some out")
        return _descend(train, held, sorted(k for k, _ in sizes), of_batch, Shape(sizes[0][1], params))
    finally:
        train.unpersist()
        held.unpersist()


def step(shape: Shape, blocks: list[Block], flat: np.ndarray, means, adam: Adam, rate: float, epoch: int,
         room: Room | None = None):
    """The weights and running means after one mini-batch, its loss and rows."""
    got = [gradient(shape, flat, b, epoch, room) for b in blocks]
    n = sum(g[2] for g in got)
    grad = sum(g[0] for g in got) / n
    for layer, l2 in enumerate(shape.p.l2):
        if l2:
            place, _ = shape.slices[layer]["w"]
            grad[place] += 2 * l2 * flat[place]
    flat = adam.move(flat, grad, rate)
    old = MOMENTUM if adam.step > 1 else 0.0
    means = [tuple(old * means[layer][j] + (1 - old) * (sum(g[3][layer][j] * g[2] for g in got) / n) for j in (0, 1))
             for layer in range(len(means))]
    return flat, means, sum(g[1] for g in got), n


def averaged(shards: list, adam: Adam):
    """Weights and running means of all shards, each counted by its rows; the
    moments move into ``adam``, whose steps are those of the longest shard."""
    rows = sum(s[-1] for s in shards)

    def mean(take):
        return sum(take(s) * (s[-1] / rows) for s in shards)
    adam.mean, adam.square, adam.step = mean(lambda s: s[2].mean), mean(lambda s: s[2].square), max(s[2].step for s in shards)
    means = [tuple(mean(lambda s, k=k, j=j: s[1][k][j]) for j in (0, 1)) for k in range(len(shards[0][1]))]
    return mean(lambda s: s[0]), means


def _descend(train, held, batches: list[int], of_batch: int, shape: Shape) -> NetworkModel:
    p = shape.p
    flat, means, adam, rate = shape.start(), shape.fresh_means(), Adam(shape.total), p.rate
    model = NetworkModel(shape.width, p, flat, means)
    least, plateau = np.inf, 0
    for epoch in range(p.epochs):
        order = [batches[k] for k in np.random.default_rng([p.seed, epoch]).permutation(len(batches))]

        def walk(part, flat=flat, means=means, adam=adam, rate=rate, epoch=epoch, order=order):
            blocks, loss, rows, room = {}, 0.0, 0, Room()
            for slot, block in sorted(part, key=lambda b: b[0]):
                blocks.setdefault(slot // of_batch, []).append(block)
            for k in order:
                if k in blocks:
                    flat, means, more, n = step(shape, blocks[k], flat, means, adam, rate, epoch, room)
                    loss, rows = loss + more, rows + n
            return [(flat, means, adam, loss, rows)] if rows else []

        shards = train.mapPartitions(walk).collect()
        flat, means = averaged(shards, adam)

        def lost(part, flat=flat, means=means):
            room = Room()
            return [tuple(map(sum, zip(*((float(losses(scores(shape, flat, means, b.x, room), b.y).sum()), len(b.y))
                                         for _, b in part))))]

        found = held.mapPartitions(lost).collect()
        found = [f for f in found if f]
        loss = sum(f[0] for f in found) / sum(f[1] for f in found)
        model.history.append((epoch, sum(s[3] for s in shards) / sum(s[4] for s in shards), loss, rate))
        if loss < least:
            least, plateau = loss, 0
            model.flat, model.means, model.best = flat, means, epoch
        else:
            plateau += 1
        if epoch - model.best >= p.stop_after:
            break
        if p.lower_after and plateau >= p.lower_after:
            rate, plateau = max(rate * p.lower_by, p.least_rate), 0
    return model

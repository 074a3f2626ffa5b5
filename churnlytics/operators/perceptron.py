"""Sigmoid networks with a softmax output, fitted by L-BFGS on Spark (M6).

Layers, loss, starting weights and steps are those of Spark ML's multilayer
perceptron: ten corrections, a line search for the strong Wolfe conditions, the
same stop. The rows come counted, equal ones once, and lie in numpy blocks that
Spark keeps; an evaluation is one job in which every task adds up loss and
gradient of its blocks by matrix products, and the driver holds sums and weights
alone. A block keeps 0/1 columns in a byte and is widened by a few hundred rows
at a time, which stay in a core's cache.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from typing import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlytics.operators.network import Room

STEP_ROWS = 512                              # widened at a time
CORRECTIONS, VALUES = 10, 20                 # pairs of the inverse Hessian; losses that the stop looks back on
SUFFICIENT, CURVATURE, TRIES = 1e-4, 0.9, 10  # of the line search
FEW_PARTS = 32                               # so few that the driver adds them up


@dataclass
class Block:
    """Rows of one partition: columns of any numbers, columns of 0 and 1, where
    each of them stands, the classes and how many rows are equal."""
    numbers: np.ndarray
    flags: np.ndarray
    at_numbers: np.ndarray
    at_flags: np.ndarray
    y: np.ndarray
    n: np.ndarray


def as_block(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> Block:
    flags = ((x == 0) | (x == 1)).all(axis=0)
    at, of = np.flatnonzero(~flags), np.flatnonzero(flags)
    return Block(np.ascontiguousarray(x[:, at]), x[:, of].astype(np.uint8), at, of, y.astype(np.int64), n.astype(float))


def kept_blocks(rows: DataFrame, parts: int, label: str, features: str, count: str):
    """A persisted RDD of blocks of ``rows``, dealt by their content."""
    plain = rows.select(F.col(label).cast("double").alias("y"), F.col(count).cast("double").alias("n"),
                        vector_to_array(features).alias("x"))

    def pack(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                y, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "n"))
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(as_block(x, y, n))], pa.binary())], names=["block"])

    dealt = plain.withColumn("h", F.xxhash64("x", "y")).repartition(parts, "h").sortWithinPartitions("h", "y").drop("h")
    return dealt.mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)


def layer_weights(layers: Sequence[int], flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of each layer's (inputs x units) weights and biases."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def add_sums(layers: Sequence[int], flat: np.ndarray, block: Block, grad: np.ndarray, room: Room) -> float:
    """The loss summed over a block's rows; ``grad`` gains its gradient."""
    weights, into, loss = layer_weights(layers, flat), layer_weights(layers, grad), 0.0
    for i in range(0, len(block.y), STEP_ROWS):
        y, n = block.y[i:i + STEP_ROWS], block.n[i:i + STEP_ROWS]
        m = len(y)
        x = room("x", m, layers[0])
        x[:, block.at_numbers], x[:, block.at_flags] = block.numbers[i:i + m], block.flags[i:i + m]
        out = [x]
        for k, (w, b) in enumerate(weights):
            z = np.matmul(out[k], w, out=room(("z", k), m, len(b)))
            z += b
            if k < len(weights) - 1:  # 1 / (1 + exp(-z))
                with np.errstate(over="ignore"):
                    np.exp(np.negative(z, out=z), out=z)
                z += 1.0
                np.reciprocal(z, out=z)
            out.append(z)
        d = out[-1]
        d -= d.max(axis=1, keepdims=True)
        own = d[np.arange(m), y]
        total = np.exp(d, out=d).sum(axis=1)
        loss += float(n @ (np.log(total) - own))
        d /= total[:, None]
        d[np.arange(m), y] -= 1.0
        d *= n[:, None]
        for k in reversed(range(len(weights))):
            a = out[k]
            into[k][0][:] += np.matmul(a.T, d, out=room(("g", k), *weights[k][0].shape))
            into[k][1][:] += d.sum(axis=0)
            if k:
                d = np.matmul(d, weights[k][0].T, out=room(("d", k), m, layers[k]))
                d *= a
                d *= np.subtract(1.0, a, out=a)
    return loss


def _summed(blocks, layers: Sequence[int], flat: np.ndarray, parts: int) -> tuple[float, np.ndarray]:
    """Loss and gradient summed over all blocks, one job."""
    def of_part(part):
        grad, loss, room = np.zeros(len(flat)), 0.0, Room()
        for b in part:
            loss += add_sums(layers, flat, b, grad, room)
        yield loss, grad

    found = blocks.mapPartitions(of_part)

    def both(a, b):
        return a[0] + b[0], a[1] + b[1]
    if parts > FEW_PARTS:
        return found.treeReduce(both)
    loss, grad = 0.0, np.zeros(len(flat))
    for own, g in found.collect():
        loss, grad = loss + own, grad + g
    return loss, grad


@dataclass
class Point:
    """``x + t * direction``: the loss, its slope along the direction, the gradient."""
    t: float
    value: float
    slope: float
    x: np.ndarray
    grad: np.ndarray


def between(low: Point, high: Point) -> float:
    """The least point of the cubic through two points, not too near to either."""
    a, b = sorted((low, high), key=lambda p: p.t)
    d1 = a.slope + b.slope - 3 * (a.value - b.value) / (a.t - b.t)
    square = d1 * d1 - a.slope * b.slope
    d2 = np.sqrt(square) if square >= 0 else np.nan
    bottom, wide = b.slope - a.slope + 2 * d2, b.t - a.t
    t = b.t - wide * (b.slope + d2 - d1) / bottom if bottom else np.nan
    return float(np.clip(t, a.t + 0.1 * wide, a.t + 0.9 * wide)) if np.isfinite(t) else a.t + 0.5 * wide


def line_search(phi: Callable[[float], Point], start: Point, t: float) -> Point | None:
    """A point that meets the strong Wolfe conditions, None where none is found."""
    def too_high(p: Point) -> bool:
        return p.value > start.value + SUFFICIENT * p.t * start.slope

    def zoom(low: Point, high: Point) -> Point | None:
        for _ in range(TRIES):
            p = phi(between(low, high))
            if too_high(p) or p.value >= low.value:
                high = p
                continue
            if abs(p.slope) <= CURVATURE * abs(start.slope):
                return p
            if p.slope * (high.t - low.t) >= 0:
                high = low
            low = p
        return None

    if start.slope > 0:
        return None
    low = start
    for k in range(TRIES):
        p = phi(t)
        if not np.isfinite(p.value):
            t /= 2
            continue
        if too_high(p) or (p.value >= low.value and k > 0):
            return zoom(low, p)
        if abs(p.slope) <= CURVATURE * abs(start.slope):
            return p
        if p.slope >= 0:
            return zoom(p, low)
        low, t = p, t * 1.5
    return None


def downhill(pairs: Sequence[tuple[np.ndarray, np.ndarray]], grad: np.ndarray) -> np.ndarray:
    """Minus the inverse Hessian of the (step, change of gradient) pairs, oldest
    first, times the gradient."""
    d, shares = grad.copy(), []
    for s, g in reversed(pairs):
        shares.append(s @ d / (s @ g))
        d -= shares[-1] * g
    if pairs:
        s, g = pairs[-1]
        d *= (s @ g) / (g @ g)
    for (s, g), share in zip(pairs, reversed(shares)):
        d += (share - g @ d / (s @ g)) * s
    return -d


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, iterations: int,
             tolerance: float) -> tuple[np.ndarray, list[float]]:
    """L-BFGS from ``x``: the last weights and the losses of all iterations. It
    ends where the loss has fallen by no more than ``tolerance`` of the first over
    the last iterations, where the gradient is as small, or where the search along
    the steepest descent fails."""
    value, grad = f(x)
    losses, recent, pairs, failed = [value], [np.inf], [], False
    while len(losses) <= iterations:
        if np.linalg.norm(grad) <= max(tolerance * value, 1e-8) \
                or (len(recent) > 1 and abs(value - max(recent)) <= tolerance * losses[0]):
            break
        d = downhill(pairs, grad)

        def phi(t, x=x, d=d):
            at = x + t * d
            v, g = f(at)
            return Point(t, v, float(g @ d), at, g)

        found = line_search(phi, Point(0.0, value, float(grad @ d), x, grad), 1.0 if len(losses) > 1 else 1.0 / np.linalg.norm(d))
        if found is None or found.t * np.linalg.norm(grad) < 1e-10:
            if failed:
                break
            pairs, failed = [], True  # once more, along the gradient
            continue
        failed = False
        pairs = [*pairs, (found.x - x, found.grad - grad)][-CORRECTIONS:]
        x, value, grad = found.x, found.value, found.grad
        losses.append(value)
        recent = [*recent, value][-VALUES:]
    return x, losses


def fit_perceptron(rows: DataFrame, layers: Sequence[int], start: np.ndarray, iterations: int, tolerance: float, parts: int,
                   label: str = "event", features: str = "features", count: str = "n") -> tuple[np.ndarray, list[float]]:
    """The weights that lower the mean loss over ``rows`` (label, features, count)
    from ``start``, and the losses on the way. Cut the lineage of ``rows`` before.
    A label that is no class raises ValueError."""
    total, known = rows.agg(F.sum(count), F.min(F.col(label).isin(*range(layers[-1])) & F.col(label).isNotNull())).first()
    if not total or not known:
        raise ValueError(f"labels are 0 to {layers[-1] - 1}, and there are rows")
    blocks = kept_blocks(rows, parts, label, features, count)
    try:
        def f(flat):
            loss, grad = _summed(blocks, layers, flat, parts)
            return loss / total, grad / total
        return minimise(f, start, iterations, tolerance)
    finally:
        blocks.unpersist()

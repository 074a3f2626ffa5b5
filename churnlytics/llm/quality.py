"""Quality classifier (operator 7): a linear-chain conditional random field
over the lines of a text.

Every line is good or bad, judged by features of itself and of the lines next
to it and by how labels follow each other. Documents' labels train it (each
line takes its document's). A document's score is the mean of its lines'
probabilities of being good (forward-backward marginals), weighted by length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlytics.llm import text as TX
from churnlytics.llm.common import filter_ids, neutral, store

MAX_DOCS = 6000     # labelled documents of the training sample, half of them bad if there are as many
MAX_LINES = 400     # lines of a training document; longer ones are not used for training
THRESHOLD = 0.3
FEATURES = 18


def line_features(hasher: TX.WordHasher, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes, first line of each text) of the lines of a string
    array; every text has a line at least. Shares of bytes by kind, word
    statistics, repetition within the line and within the text."""
    data, off, w_start, w_end, w_hash, _ = TX.doc_words(hasher, col)
    n_docs = len(col)
    nl = np.flatnonzero(data == 10)
    doc = np.concatenate([np.arange(n_docs), np.searchsorted(off, nl, side="right") - 1])
    pos = np.concatenate([off[:-1], nl + 1])
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    n = len(doc)
    span = np.diff(np.append(pos, len(data)))
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    # Bytes by kind; the line feed does not count.
    kind = np.zeros(256, np.int64)
    kind[:] = 7
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t",
                               b".,;:'\"-()", b"!?", b"|<>{}[]\\/=_")):
        kind[list(chars)] = k
    kind[128:] = 8
    kind[10] = 9
    line = np.repeat(np.arange(n), span)
    counts = np.bincount(line * 10 + kind[data], minlength=n * 10).reshape(n, 10).astype(np.float64)
    size = counts[:, :9].sum(axis=1)
    share = counts[:, :9] / np.maximum(size, 1)[:, None]
    # Words: number, length, short ones, repeats of the word before and in the line.
    at = np.searchsorted(pos, w_start, side="right") - 1
    length = (w_end - w_start).astype(np.float64)
    words = np.bincount(at, minlength=n).astype(np.float64)
    some = np.maximum(words, 1)
    mean = np.bincount(at, weights=length, minlength=n) / some
    short = np.bincount(at, weights=length <= 3, minlength=n) / some
    same = np.zeros(len(at))
    same[1:] = (w_hash[1:] == w_hash[:-1]) & (at[1:] == at[:-1])
    again = np.bincount(at, weights=same, minlength=n) / some
    order = np.lexsort((w_hash, at))
    new = np.ones(len(at))
    new[1:] = (w_hash[order][1:] != w_hash[order][:-1]) | (at[order][1:] != at[order][:-1])
    distinct = np.bincount(at[order], weights=new, minlength=n) / some
    # Lines whose words stand in the text more than once.
    with np.errstate(over="ignore"):
        code = np.zeros(n, np.uint64)
        np.add.at(code, at, w_hash * (np.arange(len(at), dtype=np.uint64) - np.searchsorted(at, at).astype(np.uint64)
                                      + np.uint64(1)))
    order = np.lexsort((code, doc))
    equal = (code[order][1:] == code[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(n, bool)
    twice[order[1:]] |= equal
    twice[order[:-1]] |= equal
    repeated = (twice & (words > 0)).astype(np.float64)
    f = np.column_stack([share, np.log1p(size), np.log1p(words), np.minimum(mean, 30) / 10, short, again, distinct,
                         repeated, words / np.maximum(size, 1), size == 0])
    return f, size, first


def with_neighbours(f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, the previous and the next line's, and whether there are any."""
    n = len(f)
    start, stop = np.zeros(n, bool), np.zeros(n, bool)
    start[first[:-1]] = True
    stop[first[1:] - 1] = True
    before, after = np.roll(f, 1, axis=0), np.roll(f, -1, axis=0)
    before[start] = 0
    after[stop] = 0
    return np.column_stack([f, before, after, start, stop])


def log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def forward_backward(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, weight: np.ndarray | None = None):
    """Marginals of the good state for every line, expected transition counts
    (2 x 2, each text counting by its weight) and the log partition per text.
    ``emit``: log score of good against bad; ``trans[a, b]``: log score of b
    after a. All texts step together, the longest first."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    weight = np.ones(len(order)) if weight is None else weight[order]
    n, steps = len(order), int(size.max(initial=0))
    live = np.searchsorted(-size, -np.arange(steps), side="left")  # texts with a line t
    alpha = np.zeros((len(emit), 2))
    beta = np.zeros((len(emit), 2))
    for t in range(steps):
        at = begin[:live[t]] + t
        e = np.column_stack([np.zeros(len(at)), emit[at]])
        if t:
            p = alpha[at - 1]
            e += np.column_stack([log_sum(p[:, 0] + trans[0, s], p[:, 1] + trans[1, s]) for s in (0, 1)])
        alpha[at] = e
    expected = np.zeros((2, 2))
    last = alpha[begin + size - 1] if n else np.zeros((0, 2))
    z = log_sum(last[:, 0], last[:, 1])
    for t in range(steps - 2, -1, -1):
        at = begin[:live[t + 1]] + t
        nxt = beta[at + 1] + np.column_stack([np.zeros(len(at)), emit[at + 1]])
        for a in (0, 1):
            beta[at, a] = log_sum(trans[a, 0] + nxt[:, 0], trans[a, 1] + nxt[:, 1])
            for b in (0, 1):
                p = np.exp(alpha[at, a] + trans[a, b] + nxt[:, b] - z[:live[t + 1]])
                expected[a, b] += (p * weight[:live[t + 1]]).sum()
    both = alpha + beta
    good = 1.0 / (1.0 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))
    out = np.zeros(n)
    out[order] = z
    return good, expected, out


@dataclass
class CrfModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # last: intercept
    trans: np.ndarray

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]

    def score(self, f: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, per text; lines without
        bytes count only where a text has no others."""
        good, _, _ = forward_backward(self.emissions(with_neighbours(f, first)), first, self.trans)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        total = np.bincount(doc, weights=size, minlength=len(first) - 1)
        weight = np.where(total[doc] > 0, size, 1.0)
        return np.clip(np.bincount(doc, weights=good * weight, minlength=len(first) - 1)
                       / np.maximum(np.bincount(doc, weights=weight, minlength=len(first) - 1), 1), 0.0, 1.0)


def fit_crf(f: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3,
            steps: int = 150, rate: float = 0.1) -> CrfModel:
    """Maximise the weighted conditional likelihood of the lines' labels (all
    of a text's lines have its label ``y``), less a ridge, by Adam on the whole
    sample. A text counts by ``weight``, whatever its number of lines."""
    x = with_neighbours(f, first)
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    scale = x.std(axis=0) if len(x) else np.ones(x.shape[1])
    scale = np.where(scale < 1e-9, 1.0, scale)
    x = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    size = np.diff(first)
    per_line = np.repeat(weight / np.maximum(size, 1), size)
    label = np.repeat(y, size).astype(np.float64)
    theta, m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    share = weight / np.maximum(size, 1)
    seen = np.diag([(share * (size - 1))[y == k].sum() for k in (0, 1)])
    for step in range(1, steps + 1 if len(y) else 1):
        good, expected, _ = forward_backward(x @ theta[:-4], first, theta[-4:].reshape(2, 2), share)
        g = np.concatenate([x.T @ (per_line * (good - label)), (expected - seen).ravel()])
        g = g / weight.sum() + penalty * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return CrfModel(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))


def train_crf(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> CrfModel:
    """Fit the field on labelled documents that are not held out.

    At most ``max_docs`` labelled rows are used, half of them bad if there are
    as many, picked by the hash of the id; weights restore the true shares.
    Sampled documents of more than ``max_lines`` lines are left out of the
    training. Rows with a null id or label are not used. Without labels the
    model is indifferent (0.5).
    """
    key = F.col(id_col).cast("long")
    lab = store(labels.where(key.isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
                .groupBy(key.alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y")))
    counts = {r[0]: r[1] for r in lab.groupBy("y").count().collect()}
    few = min(counts.get(0, 0), max_docs // 2)
    take = {0: few, 1: min(counts.get(1, 0), max_docs - few)}
    picked = [lab.where(F.col("y") == v).orderBy(F.xxhash64("id"), "id").limit(n) for v, n in take.items()]
    sample = store(picked[0].unionByName(picked[1]))
    text = filter_ids(docs.select(key.alias("id"), F.col(text_col).alias("text")), sample, "id")

    def run(batches):
        hasher = TX.WordHasher()
        for part in TX.slices(batches):
            f, size, first = line_features(hasher, part.column(1))
            keep = np.flatnonzero(np.diff(first) <= max_lines)
            values = [f[first[i]:first[i + 1]].ravel() for i in keep]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)),
                                              pa.array(values, pa.list_(pa.float64()))], names=["id", "f"])

    rows = text.mapInArrow(run, "id long, f array<double>").join(sample, "id").select("id", "y", "f").toPandas()
    rows = rows.sort_values(["id", "y"], kind="stable")
    if not len(rows):
        return CrfModel(np.zeros(3 * FEATURES + 2), np.ones(3 * FEATURES + 2), np.zeros(3 * FEATURES + 3),
                        np.zeros((2, 2)))
    f = np.concatenate(rows["f"].to_list()).reshape(-1, FEATURES)
    first = np.concatenate([[0], np.cumsum([len(x) // FEATURES for x in rows["f"]])])
    y = rows["y"].to_numpy()
    weight = np.where(y == 1, counts.get(1, 0) / max(take[1], 1), counts.get(0, 0) / max(take[0], 1))
    return fit_crf(f, first, y, weight)


def held_out(id_col):
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, model: CrfModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with its own columns and, last, the score (double, 0 to 1).

    Defined cases: a null or empty text is one empty line and has that line's
    probability; ids are not looked at, so null ids and repeated rows are
    scored each; an empty table gives an empty result; other columns go through
    untouched, whatever their names.
    """
    place, plain = docs.columns.index(text_col), neutral(docs)
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        hasher = TX.WordHasher()
        for part in TX.slices(batches, place):
            p = model.score(*line_features(hasher, part.column(place)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[f.name for f in schema.fields])

    return plain.mapInArrow(run, schema).toDF(*docs.columns, name)

"""Toxicity (operator 9): a chain of linear models over the words of a text
and the words' beginnings (their first 3 to 6 bytes, which catch inflections).

The categories come in order; each model sees the words and the probabilities
of the categories before it, in training those predicted out of fold. Models
are fitted on a bounded sample of the labelled documents; the vocabulary is
chosen from that sample by Spark, the regression itself has a few hundred
columns. Scoring is one Arrow pass over whole texts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlytics.llm import text as TX
from churnlytics.llm.common import filter_ids, neutral, store

# The chain over the columns of ``labels``; the middle one is the decision.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"), ("toxic_prose", "toxic = 1 AND quality = 1"))
DECISION = "toxic"
MAX_ROWS = 8000   # labelled documents that models are fitted on, half of them toxic if there are as many
VOCABULARY = 512
FOLDS = 4
PREFIXES = (3, 4, 5, 6)  # bytes
THRESHOLD = 0.3
LEAST_SPREAD = 3.0  # standard deviations by which a word's presence must differ to be a feature


@dataclass
class ChainModel:
    """Word hashes (sorted) and, per category, intercept, word weights and the
    weights of the categories before it."""
    names: list[str]
    words: np.ndarray
    bias: list[float] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    chained: list[np.ndarray] = field(default_factory=list)

    def predict(self, x) -> np.ndarray:
        """Probabilities (rows x categories) of a dense matrix, or of a
        function that multiplies the sparse words by a weight vector."""
        times = x if callable(x) else (lambda w: x @ w)
        out: list[np.ndarray] = []
        for b, w, c in zip(self.bias, self.weights, self.chained, strict=True):
            z = times(w) + b
            for p, k in zip(out, c, strict=True):
                z = z + k * p
            out.append(sigmoid(z))
        return np.column_stack(out)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.3,
                 steps: int = 12) -> tuple[float, np.ndarray]:
    """L2-penalised logistic regression by Newton steps, halved while they do
    not help (the intercept is free of penalty)."""
    total = weight.sum()
    if total <= 0 or not len(y):
        return -35.0, np.zeros(x.shape[1])
    rate = np.clip((weight * y).sum() / total, 1e-6, 1 - 1e-6)
    a = np.column_stack([np.ones(len(x), np.float32), x]).astype(np.float32)
    ridge = np.full(a.shape[1], penalty)
    ridge[0] = 1e-6
    b = np.zeros(a.shape[1])
    b[0] = np.log(rate / (1 - rate))

    def loss(b):
        z = (a @ b.astype(np.float32)).astype(np.float64)
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (ridge * b * b).sum(), sigmoid(z)

    now, p = loss(b)
    for _ in range(steps):
        g = a.T @ (weight * (p - y)) + ridge * b
        curve = (weight * p * (1 - p)).astype(np.float32)
        h = (a.T @ (a * curve[:, None])).astype(np.float64)
        h[np.diag_indices_from(h)] += ridge
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-3:
            new, q = loss(b - size * step)
            if new < now:
                break
            size /= 2
        else:
            break
        gain, now, b, p = now - new, new, b - size * step, q
        if gain < 1e-4 * max(1.0, abs(now)):
            break
    return float(b[0]), b[1:]


def fit_chain(names: list[str], words: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray,
              fold: np.ndarray, folds: int = FOLDS) -> ChainModel:
    """``x`` (rows x words), ``y`` (rows x categories): each category's final
    model is fitted on the words and the out-of-fold probabilities before it."""
    model, before = ChainModel(names, words), np.zeros((len(x), 0))
    for c in range(len(names)):
        full = np.column_stack([x, before])
        bias, w = fit_logistic(full, y[:, c], weight)
        model.bias.append(bias)
        model.weights.append(w[:x.shape[1]])
        model.chained.append(w[x.shape[1]:])
        out = np.zeros(len(x))
        for k in range(folds):
            held = fold == k
            if held.any():
                b, v = fit_logistic(full[~held], y[~held, c], weight[~held])
                out[held] = sigmoid(full[held] @ v + b)
        before = np.column_stack([before, out])
    return model


def features(hasher: TX.WordHasher, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text no., words of each text): a hash for every word and for each
    of its beginnings."""
    data, _, start, end, h, first = TX.doc_words(hasher, col)
    doc = np.repeat(np.arange(len(col)), np.diff(first))
    hashes, docs, code = [h], [doc], np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(max(PREFIXES)):
            long = start + j < end
            start, end, code, doc = start[long], end[long], code[long], doc[long]
            code = code | hasher.lower[data[start + j]].astype(np.uint64) << np.uint64(8 * j)
            if j + 1 in PREFIXES:
                hashes.append(TX.mix(code | np.uint64(j + 1) << np.uint64(56)))
                docs.append(doc)
    return np.concatenate(hashes), np.concatenate(docs), np.diff(first)


def _word_rows(docs: DataFrame) -> DataFrame:
    """``(id, fold, words array<long>)`` of ``docs(id, text)``: distinct
    features; copies of a text share a fold."""

    def run(batches):
        hasher = TX.WordHasher()
        for part in TX.slices(batches):
            h, doc, _ = features(hasher, part.column(1))
            h = h[np.argsort(doc, kind="stable")]
            first = np.searchsorted(np.sort(doc), np.arange(part.num_rows + 1))
            words = [np.unique(h[first[i]:first[i + 1]]).view(np.int64) for i in range(part.num_rows)]
            fold = [int.from_bytes(hashlib.blake2b(w.tobytes(), digest_size=4).digest(), "little") for w in words]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fold, pa.int64()),
                                              pa.array(words, pa.list_(pa.int64()))], names=["id", "fold", "words"])

    return docs.mapInArrow(run, "id long, fold long, words array<long>")


def train_chain(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                categories=CATEGORIES, decision: str = DECISION, max_rows: int = MAX_ROWS,
                vocabulary: int = VOCABULARY, folds: int = FOLDS) -> ChainModel:
    """Fit the chain on labelled documents.

    At most ``max_rows`` labelled rows are used, half with the decision's label
    if there are as many, picked by the hash of the id; weights restore the
    true shares. Of a text that occurs more than once, one counts for the
    vocabulary: the words whose presence differs most between the decision's
    classes, and between the first category's. Rows with a null id or a null
    label are not used. Without labels every probability is 0.
    """
    names = [n for n, _ in categories]
    lab = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
           .agg(*[F.max(F.expr(e).cast("int")).alias(f"y{k}") for k, (_, e) in enumerate(categories)]))
    lab = store(lab.dropna())
    d = names.index(decision)
    counts = {r[0]: r[1] for r in lab.groupBy(f"y{d}").count().collect()}
    few = min(counts.get(1, 0), max_rows // 2)
    take = {1: few, 0: min(counts.get(0, 0), max_rows - few)}
    picked = [lab.where(F.col(f"y{d}") == v).orderBy(F.xxhash64("id"), "id").limit(n) for v, n in take.items()]
    sample = store(picked[0].unionByName(picked[1]))
    text = filter_ids(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), sample, "id")
    rows = store(_word_rows(text).join(sample, "id"))
    once = rows.dropDuplicates(["fold"])
    # Presence of a word by class, as a signed root of the likelihood ratio.
    seen = once.select(F.explode("words").alias("word"), f"y{d}", "y0").groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.sum(f"y{d}").alias("a"), F.sum("y0").alias("b"))
    n, a, b = once.agg(F.count(F.lit(1)), F.sum(f"y{d}"), F.sum("y0")).first()
    n, a, b = float(n or 0), float(a or 0), float(b or 0)

    def spread(hit: str, of: float):
        expected = F.col("n") * (of / max(n, 1.0))
        return F.abs(F.col(hit) - expected) / F.sqrt(expected + 1.0)

    best = {r[0] for hit, of in (("a", a), ("b", b)) for r in
            seen.where("n >= 3").select("word", spread(hit, of).alias("s"))
            .where(F.col("s") >= LEAST_SPREAD).orderBy(F.desc("s"), "word").limit(vocabulary // 2).collect()}
    words = np.sort(np.array(sorted(best), np.int64).view(np.uint64))
    known = [int(w) for w in words.view(np.int64)]

    def pick(batches):
        table = np.array(known, np.int64).view(np.uint64)
        for batch in batches:
            hits = [_places(table, w.values.to_numpy().view(np.uint64)) if w.is_valid else [] for w in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in (0, *range(2, batch.num_columns))],
                                              pa.array(hits, pa.list_(pa.int32()))],
                                             names=["fold", *[f"y{k}" for k in range(len(names))], "hits"])

    ys = [f"y{k}" for k in range(len(names))]
    got = rows.select("fold", "words", *ys).mapInArrow(
        pick, "fold long, " + ", ".join(f"{y} int" for y in ys) + ", hits array<int>").toPandas()
    got = got.sort_values(["fold", *ys], kind="stable")
    x, y = np.zeros((len(got), len(words)), np.float32), got[ys].to_numpy(np.float64)
    for i, hit in enumerate(got["hits"]):
        x[i, hit] = 1.0
    weight = np.where(y[:, d] == 1, counts.get(1, 0) / max(take[1], 1), counts.get(0, 0) / max(take[0], 1))
    return fit_chain(names, words, x, y, weight / max(weight.mean(), 1e-9) if len(weight) else weight,
                     got["fold"].to_numpy() % folds, folds)


def _places(table: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places in the sorted ``table`` of the ``words`` that it holds."""
    if not len(table):
        return np.zeros(0, np.int32)
    at = np.minimum(np.searchsorted(table, words), len(table) - 1)
    return at[table[at] == words].astype(np.int32)


def score_toxicity(docs: DataFrame, model: ChainModel, text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """``docs`` with its own columns and ``p_<category>`` (double) for each of
    the chain.

    Defined cases: a null, empty or wordless text has the probability 0 in each
    category; ids are not looked at, so null ids and repeated rows are scored
    each; the new columns stand last, whatever the others' names; an empty
    table gives an empty result.
    """
    names = [prefix + n for n in model.names]
    place, plain = docs.columns.index(text_col), neutral(docs)
    schema = T.StructType([*plain.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches):
        hasher = TX.WordHasher()
        for part in TX.slices(batches, place):
            h, doc, n_words = features(hasher, part.column(place))
            if len(model.words) and len(h):
                at = np.minimum(np.searchsorted(model.words, h), len(model.words) - 1)
                hit = np.flatnonzero(model.words[at] == h)
                pair = np.unique(doc[hit] * len(model.words) + at[hit])
            else:
                pair = np.zeros(0, np.int64)
            row, word = np.divmod(pair, max(len(model.words), 1))
            p = model.predict(lambda w: np.bincount(row, weights=w[word] if len(w) else None, minlength=part.num_rows))
            p[n_words == 0] = 0.0
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(p[:, k]) for k in range(len(names))]],
                                             names=[f.name for f in schema.fields])

    return plain.mapInArrow(run, schema).toDF(*docs.columns, *names)


def drop_toxic(docs: DataFrame, model: ChainModel, text_col: str = "text", decision: str = DECISION,
               threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with its own columns, without the texts whose probability of
    ``decision`` is ``threshold`` or more."""
    plain = neutral(docs)
    scored = score_toxicity(plain, model, plain.columns[docs.columns.index(text_col)])
    return scored.where(F.col(f"p_{decision}") < threshold).select(*plain.columns).toDF(*docs.columns)

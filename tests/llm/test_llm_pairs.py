"""Near-duplicates of texts and vectors against all pairs."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlytics.llm import embeddings as V
from churnlytics.llm import minhash as M

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def components(nodes, links):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def plain_near(rows, least=0.8):
    bags = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        if i is not None and w:
            bags[i] = collections.Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))
    ids, links = sorted(bags), []
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            o = sum((bags[a] & bags[b]).values())
            if o >= least * (sum(bags[a].values()) + sum(bags[b].values()) - o) - 1e-9:
                links.append((a, b))
    return components([i for i, _ in rows if i is not None], links)


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    a = {int(k): int(c) for k, c in zip(rng.integers(1, 2 ** 63, 120), rng.integers(1, 12, 120), strict=True)}
    b = {k: max(1, c + int(rng.integers(-4, 5))) for k, c in list(a.items())[:90]} | {5: 3, 6: 40}
    both = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
    j = both / (sum(a.values()) + sum(b.values()) - both)
    sig = M.bag_minhash(np.array([*a, *b], np.uint64), np.array([0] * len(a) + [1] * len(b)),
                        np.array([*a.values(), *b.values()]), 2, 8000)
    assert abs((sig[0] == sig[1]).mean() - j) < 0.025


def edits(rng, words, n):
    w = list(words)
    for k in rng.choice(len(w), n, replace=False):
        w[k] = f"new{rng.integers(10 ** 6)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [2048, 3])
def test_near_duplicates_match_all_pairs(spark, block):
    rng = np.random.default_rng(4)
    rows, at = [], 1
    for _ in range(6):
        base = [f"w{rng.integers(10 ** 6)}" for _ in range(150)]
        for k in range(12):  # a chain: each text is an edit of the last
            base = edits(rng, base, int(rng.integers(1, 5))).split()
            rows.append((at, " ".join(base)))
            at += 1
    rows += [(100, rows[0][1].upper()), (101, rows[0][1] + "!"), (102, None), (103, ""), (104, "one two"), (105, "One, two"),
             (106, "..."), (None, rows[0][1]), (1, rows[0][1]), (107, "a " * 40), (108, "a " * 44), (109, "a " * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("n", F.lit(1))
    got = M.near_duplicates(docs, block=block).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == plain_near(rows)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    kept = M.drop_near_duplicates(docs, block=block)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {None, 1, 102, 103, 104, 106}
    assert 105 not in {r["doc_id"] for r in kept.collect()}


def test_pairs_of_one_band_are_verified_whatever_their_signatures(spark, monkeypatch):
    real = M.signatures

    def one_band(docs, k, m):  # all texts agree in the first band and nowhere else
        sig = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda c: F.when(c < M.ROWS, 7).otherwise(F.hash("id", c)))
        return real(docs, k, m).withColumn("sig", F.when(F.col("digest").isNotNull(), sig))
    monkeypatch.setattr(M, "signatures", one_band)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(150)]
    rows = [(1, " ".join(f"hub{i}" for i in range(150)))]  # the smallest class is near none of the others
    rows += [(2, " ".join(base)), (3, edits(rng, base, 3)), (4, edits(rng, base, 3)), (5, edits(rng, base, 60))]
    for block in (2048, 2):
        got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
        want = plain_near(rows)
        assert {r["doc_id"]: r["component_id"] for r in got} == want and want[3] == want[4] == 2


def test_a_hot_bucket_is_compared_in_bounded_calls(spark):
    rest = spark.range(3000).select(F.lit(0).alias("no"), F.lit(5).cast("long").alias("band"),
                                    F.lit(30).cast("long").alias("blocks"), F.col("id").alias("rep"))
    rows = M.block_rows(rest, 90000, bin_rows=200).toPandas()
    assert len(rows) == 90000 and (rows["lo"] <= rows["hi"]).all()
    pairs = rows.groupby(["lo", "hi"])
    assert len(pairs) == 30 * 31 // 2 and (pairs["bin"].nunique() == 1).all()
    # 465 pairs of about 200 rows in 450 bins: 16 calls would get 5,600 rows each
    assert rows["bin"].nunique() > 200 and rows.groupby("bin").size().max() < 2500


def test_near_duplicates_empty(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert M.near_duplicates(only).first()["component_id"] == 1


@pytest.mark.parametrize("block", [1024, 7])
def test_vectors_match_all_pairs(spark, block):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 16))
    hot = x[0] + 0.02 * rng.normal(size=(40, 16))
    v = np.concatenate([x, hot, x[:10] + 0.05 * rng.normal(size=(10, 16)), x[:5], 2 * x[:3]]).astype(np.float32)
    rows = [(i + 1, [float(c) for c in r]) for i, r in enumerate(v)]
    odd = [(500, None), (501, [0.0] * 16), (502, [float("nan")] + [1.0] * 15), (503, [None] + [1.0] * 15), (504, []),
           (505, [float("inf")] * 16), (506, [1.0, 2.0]), (507, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("links", F.lit("x"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in V.near_vectors(df, block=block).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.95
    links = [(int(a) + 1, int(b) + 1) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    comp = components([i for i, _ in rows], links)
    for i, _ in rows:
        assert got[i] == (int(near[i - 1].sum()) - 1, comp[i], comp[i] == i), i
    for i in range(500, 506):
        assert got[i] == (0, i, True)
    assert got[506] == (1, 506, True) and got[507] == (1, 506, False) and got[None] == (0, None, True)
    assert V.near_vectors(df.limit(0)).count() == 0


def test_fast_transform_is_hadamard():
    x = np.random.default_rng(0).normal(size=(3, 8))
    h = np.array([[1]])
    while len(h) < 8:
        h = np.block([[h, h], [h, -h]])
    np.testing.assert_allclose(V.hadamard(x), x @ h.T)

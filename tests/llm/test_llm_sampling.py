"""Resampling, nearest neighbours and the filter audit against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from churnlytics.llm import audit as A
from churnlytics.llm import neighbors as N
from churnlytics.llm import resample as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def texts(n, seed=0):
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma", "déjà", "x1", "the", "of", "MIT", "straße", "語"]
    return [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(n)]


# --- 11: resampling -------------------------------------------------------

def plain_resample(rows, target, percent=25, least=20, buckets=R.BUCKETS):
    def feats(t):
        w = words(t)
        return [zlib.crc32(f.encode()) % buckets for f in w + [a + " " + b for a, b in itertools.pairwise(w)]]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, x in rows:
        for f in feats(x):
            s[f] += 1
    for x in target:
        for f in feats(x):
            t[f] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, x in rows:
        f = feats(x)
        w = math.floor(sum(gain[k] for k in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("ways", [2, 16])
def test_resample_matches_plain_ranking(spark, ways):
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts(300))]
    rows += [(None, "null id " * 15), (5000, None), (5001, ""), (5002, "... !!"), (5003, "Word " * 30_000 + "é" * 5000)]
    target = ["the MIT of alpha beta", None, "gamma gamma straße"]
    docs = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows],
                                 "doc_id long, text string, id string, row int, score int")
    got = R.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), ways=ways)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_resample(rows, target)


def test_resample_ties_and_repeated_rows(spark):
    # One id and one text, many times: all tie, and as many as wanted are drawn.
    rows = [(3, "same words here " * 8)] * 40 + [(9, "other words there " * 8)] * 10
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = R.resample(docs, docs.limit(0)).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert len(got) == 50 and ranks == list(range(1, 13))
    first = max(plain_resample(rows, []), key=lambda r: r[3])[0]
    assert {r["doc_id"] for r in got if r["rank"]} == ({3} if first == 3 else {3, 9})


def test_resample_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.resample(none, none).count() == 0
    short = spark.createDataFrame([(1, "too short"), (2, None)], "doc_id long, text string")
    assert [r["rank"] for r in R.resample(short, none).collect()] == [None, None]


def test_bisected_counts(spark):
    values = [random.Random(1).randint(-50, 50) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "low long")
    for least in (1, 17, 250, 500):
        cut, below = R.bisected(rows, "low", least, ways=3)
        assert cut == sorted(values)[least - 1] and below == sum(v < cut for v in values)


# --- 12: nearest neighbours -------------------------------------------------

def plain_neighbors(rows, k=5, nth=50):
    unit = []
    for i, v in dict.fromkeys((i, None if v is None else tuple(v)) for i, v in rows):
        if i is None or not v or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            continue
        x = np.array(v, float)
        x = x / np.abs(x).max()
        unit.append((i, x / np.linalg.norm(x) + 0.0))
    out = []
    for a, (i, x) in enumerate(unit):
        if i % nth == 0:
            near = sorted((-min(1.0, max(-1.0, float((x * y).sum()))) if (x != y).any() else -1.0, j)
                          for b, (j, y) in enumerate(unit) if a != b and len(x) == len(y))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near[:k])]
    return sorted(out)


EDGE = [(50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0]), (4, [1.0, 1.0]), (7, [1.0, -1.0]),
        (100, [0.0, 0.0]), (150, None), (200, [1.0, None]), (250, [float("nan"), 1.0]), (300, [float("inf"), 1.0]),
        (350, []), (None, [1.0, 0.5]), (400, [1.0, 0.0, 0.0]), (5, [1.0, 2.0, 3.0]), (0, [-1.0, 0.0]), (450, [1e300, 1e300])]


def test_neighbors_edge_cases(spark):
    rows = spark.createDataFrame([(i, v, "x", 1.0) for i, v in EDGE], "vec_id long, embedding array<double>, rep string, unit double")
    got = N.nearest_neighbors(rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    got, want = sorted(map(tuple, got.collect())), plain_neighbors(EDGE)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-15)


def test_neighbors_empty(spark):
    rows = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert N.nearest_neighbors(rows).count() == 0
    one = spark.createDataFrame([(50, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert N.nearest_neighbors(one).count() == 0


def vectors(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(20, dim))
    x = centers[rng.integers(20, size=n)] + 0.5 * rng.normal(size=(n, dim))
    x[n // 2:n // 2 + n // 3] = x[7]  # a third of the rows are one vector
    return x


def test_neighbors_recall_and_exact_scores(spark):
    x = vectors(3000, 16)
    rows = [(k, x[k].tolist()) for k in range(len(x))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = {}
    for r in N.nearest_neighbors(df, leaf=32, sample_bytes=64 << 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    for q, r, j, s in plain_neighbors(rows):
        want.setdefault(q, []).append((r, j, s))
    assert set(got) == set(want) and all([r for r, _, _ in sorted(v)] == [1, 2, 3, 4, 5] for v in got.values())
    hit = sum(len({j for _, j, _ in got[q]} & {j for _, j, _ in want[q]}) for q in want) / (5 * len(want))
    assert hit >= 0.9
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for q, found in got.items():
        for _, j, s in found:
            assert abs(s - float(unit[q] @ unit[j])) < 1e-12
    # Copies: the smallest ids of the one vector, whatever leaf they are in.
    q = next(k for k in want if 1500 <= k < 2500)
    assert [j for _, j, _ in sorted(got[q])] == [j for _, j, _ in sorted(want[q])]


def test_forest_queue_takes_leaves_by_cost():
    x = np.random.default_rng(3).normal(size=(600, 12))
    forest = N.Forest(x, 600, trees=3, leaf=20)
    at = forest.place(x)
    assert np.bincount(at[:, 0]).max() <= 2 * 600 / forest.leaves
    for q in x[:5]:
        costs = forest.costs(q)
        found = forest.search(q, 10_000)
        assert len(found) == len(set(found)) == 3 * forest.leaves  # every leaf, once
        in_order = [costs[t, n] for t, n in found]
        assert np.allclose(in_order, np.sort(costs.ravel()))
        assert all(costs[t, forest.place(q[None, :])[0, t]] == 0 for t in range(3))


def test_rerank_in_blocks_is_the_same(spark):
    x = vectors(400, 8, 5)
    df = spark.createDataFrame([(k, int(k), v.tolist(), k % 50 == 0) for k, v in enumerate(x / np.linalg.norm(x, axis=1)[:, None])],
                               "rep long, least long, vec array<double>, query boolean")
    forest = N.Forest(x, 400, trees=2, leaf=16)
    index = N.placed(df, forest)
    wanted = N.wanted_leaves(index.where("query"), forest, 12)
    big, small = ({(r["rep"], r["near"], r["score"]) for r in N.reranked(index, wanted, 400, block).collect()} for block in (4096, 7))
    assert big == small


# --- 13: filter audit -------------------------------------------------------

def plain_audit(rows, labels):
    def fails(k):
        i, t, _ = rows[k]
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {c for c, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            bool(re.search(r"[#$%&*|]", t)),
            i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows))) if bad}
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    f = [fails(k) for k in range(len(rows))]
    out = {}
    for part in {r[2] or "" for r in rows}:
        here = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            for s, c in enumerate(order):
                before = set(order[:s])
                gone = [k for k in here if c in f[k] and not f[k] & before]
                out[part, "".join(order), s + 1] = [
                    sum(not f[k] & (before | {c}) for k in here), len(gone), sum(c in f[k] and bool(f[k] & before) for k in here),
                    sum(f[k] == {c} for k in here), sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)]
    total = {}
    for (part, order, s), v in out.items():
        total[part, order[s - 1]] = total.get((part, order[s - 1]), 0) + v[1]
    return sorted((p, o, s, *v, total[p, o[s - 1]]) for (p, o, s), v in out.items())


def audit_rows():
    rng = random.Random(4)
    rows = []
    for k in range(120):
        w = [rng.choice(["a", "B", "c$", "dé", "Ünder", "SHOUT", "e f"]) + str(rng.randint(0, rng.choice([3, 400])))
             for _ in range(rng.choice([0, 5, 199, 200, 260]))]
        rows.append((rng.randint(0, 90), rng.choice([" ", "\t", "\n\v"]).join(w), rng.choice(["en", "de", "", None])))
    rows += [(i, rows[3][1], "en") for i in (0, 500, 500, None)] + [(600, None, "fr"), (601, "", "fr"), (602, " \n", None)]
    rows += [(700, "word " * 50_000, "en"), (701, "word " * 50_000, "de")]
    return rows


def test_audit_matches_plain_steps(spark):
    rows = audit_rows()
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 95)] + [(4, None, None), (4, 1, 1), (None, 1, 1), (700, 1, 0)]
    docs = spark.createDataFrame([(*r, 1, b"x", "p") for r in rows],
                                 "doc_id long, text string, lang string, mask int, digest binary, part string")
    got = A.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", *A.COUNTERS, "shapley"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)


def test_audit_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.filter_audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "en")], docs.schema)
    assert A.filter_audit(one, labels).count() == 600


def test_packed_fields_do_not_overflow():
    layout = A.Layout("ABCDE", 5)
    total = 15 * layout.packed(0b11111, True, True) + 16 * layout.packed(0, False, False)
    for order, step, kept, removed, redundant, unique, good, toxic, _ in layout.rows(total):
        assert (kept, removed, redundant, unique) == (16, 15 * (step == 1), 15 * (step > 1), 0)
        assert good == toxic == removed
    assert layout.rows(0)[0][2:] == (0,) * 7


def test_packed_sums_merge_in_branches(spark, monkeypatch):
    monkeypatch.setattr(A, "MOST_PARTS", 2)
    rows = spark.range(1000).selectExpr("cast(id % 3 as string) part", "cast(id % 32 as int) mask", "id % 2 = 0 good",
                                        "id % 5 = 0 toxic").repartition(9)
    layout = A.Layout("ABCDE", 12)
    sums = {r["part"]: int.from_bytes(r["total"], "little") for r in A.packed_sums(rows, layout).collect()}
    for p in "012":
        assert sums[p] == sum(layout.packed(i % 32, i % 2 == 0, i % 5 == 0) for i in range(1000) if i % 3 == int(p))

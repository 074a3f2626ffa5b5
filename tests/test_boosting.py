"""Second-order boosting against a plain numpy version, one leaf at a time."""

import math

import numpy as np
import pytest

from churnlytics.operators import boosting as B
from churnlytics.operators.features import stratified_folds
from churnlytics.operators.quantiles import quantiles, quantiles_of_columns


def rows(n=400, seed=2):
    rng = np.random.default_rng(seed)
    x, z = rng.integers(0, 12, n) * 1.5, rng.normal(size=n).round(1)
    c = rng.choice(["a", "b", "c", "d"], n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.3 * x - 2 + z * (c == "b") + 2 * (c == "d"))))).astype(int)
    return [(int(k), float(x[k]), None if k % 37 == 0 else float(z[k]), None if k % 41 == 0 else str(c[k]), int(y[k]))
            for k in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "id long, x double, z double, c string, event int").repartition(3)


def plain_fit(data, binning, p, base):
    """Trees by recursion over rows; splits of open leaves one at a time."""
    z_median = binning.medians[1]
    cols = [np.array([r[1] for r in data]), np.array([z_median if r[2] is None else r[2] for r in data]),
            np.array([r[3] or B.MISSING for r in data], object)]
    y = np.array([r[4] for r in data], float)
    f, trees = np.full(len(data), base), []
    for _ in range(p.trees):
        q = 1 / (1 + np.exp(-f))
        g, h = q - y, q * (1 - q)

        def score(m):
            return g[m].sum() ** 2 / (h[m].sum() + p.l2)

        def best(m):
            found = None
            for k in range(3):
                options = binning.edges[k] if k < 2 else binning.vocabulary[0]
                for o in options:
                    left = m & ((cols[k] <= o) if k < 2 else (cols[k] != o))
                    right = m & ~left
                    if (min(left.sum(), right.sum()) < max(1, p.min_rows)
                            or min(h[left].sum(), h[right].sum()) < p.min_hessian):
                        continue
                    gain = 0.5 * (score(left) + score(right) - score(m))
                    if gain > 1e-12 and (found is None or gain > found[0] + 1e-10):
                        found = (gain, k, o, left, right)
            return found

        leaves, order = [(np.ones(len(data), bool), 0)], []
        while len(leaves) < (p.leaves or 1 << p.depth):
            options = [(b[0], i, b) for i, (m, d) in enumerate(leaves) if d < p.depth and (b := best(m))]
            if not options:
                break
            gain, i, b = max(options, key=lambda o: o[0])
            order.append((binning.names[b[1]], b[2], round(gain, 6)))
            d = leaves[i][1]
            leaves[i:i + 1] = [(b[3], d + 1), (b[4], d + 1)]
        for m, _ in leaves:
            f = f + np.where(m, -p.rate * g[m].sum() / (h[m].sum() + p.l2), 0.0)
        trees.append(order)
    return f, trees


def splits(model, tree):
    t, b, out = model.trees[tree], model.binning, []
    for k, f in enumerate(t.feature):
        if f >= 0:
            at = t.cut[k] - b.offsets[f]
            out.append((t.left[k], (b.names[f], b.edges[f][at] if f < 2 else b.vocabulary[f - 2][at], round(t.gain[k], 6))))
    return [x for _, x in sorted(out)]  # children are numbered in the order of the splits


@pytest.mark.parametrize("p", [B.Params(trees=3, depth=3), B.Params(trees=3, depth=6, leaves=7, l2=0.0, min_hessian=1e-3, min_rows=5)])
def test_trees_match_plain_numpy(spark, p):
    data = rows()
    model = B.fit_boosted(frame(spark, data), ["x", "z"], ["c"], p, max_bins=16)
    n, pos = len(data), sum(r[4] for r in data)
    assert model.base == pytest.approx(math.log(pos / (n - pos)))
    f, trees = plain_fit(data, model.binning, p, model.base)
    for k, want in enumerate(trees):
        got = splits(model, k)
        assert (got == want) if p.leaves else (sorted(got) == sorted(want)), (k, got, want)
    scored = {r["id"]: r["score"] for r in model.transform(frame(spark, data)).collect()}
    assert np.allclose([scored[r[0]] for r in data], 1 / (1 + np.exp(-f)), atol=1e-9)


def test_several_fits_share_the_passes(spark):
    data = frame(spark, rows())
    binning = B.fit_binning(data, ["x", "z"], ["c"], 16)
    blocks, n, pos = B.binned_blocks(data, binning)
    fits = [B.Params(trees=2, depth=2), B.Params(trees=3, depth=4, leaves=5, subsample=0.7, features="sqrt")]
    both = B.boost(blocks, binning, fits, B.log_odds(n, pos))
    for p, m in zip(fits, both, strict=True):
        assert B.boost(blocks, binning, [p], B.log_odds(n, pos))[0].trees == m.trees
    assert sum(x for _, x in both[0].importances()) == pytest.approx(1)


def test_edge_tables(spark, tmp_path):
    none = frame(spark, rows()).limit(0)
    assert [r["score"] for r in B.fit_boosted(none, ["x", "z"], ["c"]).transform(frame(spark, rows(3))).collect()] == [0.5] * 3
    ones = frame(spark, [(1, None, None, None, 1), (2, float("nan"), 1.0, "q", 1), (3, 1.0, 2.0, "q", None)])
    model = B.fit_boosted(ones, ["x", "z"], ["c"])
    assert all(r["score"] > 0.99 for r in model.transform(ones).collect())
    fitted = B.fit_boosted(frame(spark, rows()), ["x", "z"], ["c"], B.Params(trees=2))
    fitted.save(spark, str(tmp_path / "m"))
    again = B.BoostedModel.load(spark, str(tmp_path / "m"))
    assert again == fitted


def test_quantiles_of_columns_equal_each_column(spark):
    df = frame(spark, rows()).selectExpr("x", "z", "cast(null as double) as nothing", "cast(event as int) as event")
    got = {(r["column"], r["q"]): r["value"] for r in quantiles_of_columns(df, df.columns, [0.1, 0.5, 0.9]).collect()}
    want = {(c, r["q"]): r["value"] for c in df.columns for r in quantiles(df, c, [0.1, 0.5, 0.9]).collect()}
    assert got.keys() == want.keys() and len(got) == 9
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_search_scores_unseen_folds_and_refits_the_winner(spark):
    data = frame(spark, rows(600, 9))
    trials = [B.Params(trees=12, depth=2, rate=0.3), B.Params(trees=7, depth=4, rate=0.05, min_split=30)]
    model, table = B.search(data, ["x", "z"], ["c"], trials, folds=3, stage=5, together=2, max_bins=16)
    assert [(r["trial"], r["trees"]) for r in table] == [(0, 5), (0, 10), (0, 12), (1, 5), (1, 7)]
    best = max(table, key=lambda r: r["auc"])
    assert len(model.trees) == best["trees"] and model.params.depth == trials[best["trial"]].depth
    # The mean AUC of one pair, from fits on the other folds' rows alone.
    folded = stratified_folds(data, 3).cache()
    binning, aucs = model.binning, []
    for k in range(3):
        blocks, *_ = B.binned_blocks(folded.where(f"fold <> {k}"), binning)
        one = B.boost(blocks, binning, [B.Params(trees=10, depth=2, rate=0.3)], model.base)[0]
        held = one.transform(folded.where(f"fold = {k}")).select("event", "score").toPandas()
        pos, neg = held.score[held.event == 1].to_numpy(), held.score[held.event == 0].to_numpy()
        aucs.append(((pos[:, None] > neg).mean() + 0.5 * (np.abs(pos[:, None] - neg) < 1e-12).mean()))
    assert table[1]["auc"] == pytest.approx(np.mean(aucs), abs=0.004)


def test_search_needs_both_labels(spark):
    with pytest.raises(ValueError, match="both labels"):
        B.search(frame(spark, rows(50)).where("event = 1"), ["x"], [], [B.Params(trees=1)])

"""Kaplan-Meier fixture (FIXTURES §3), invariants, and Cox vs a numpy reference."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlytics.operators import survival as KM
from churnlytics.operators.cox import fit_cox


@pytest.fixture
def km_fixture(spark):
    return spark.createDataFrame(list(zip([1, 2, 2, 3, 4, 5], [1, 1, 0, 1, 0, 1])), "duration int, event int")


def test_km_golden(spark, km_fixture):
    rows = {r["t"]: r for r in KM.km_curve(km_fixture).collect()}
    expected = {0: (6, 0, 1.0), 1: (6, 1, 0.833333), 2: (5, 1, 0.666667), 3: (3, 1, 0.444444),
                4: (2, 0, 0.444444), 5: (1, 1, 0.0)}
    assert set(rows) == set(expected)
    for t, (n, d, s) in expected.items():
        assert rows[t]["at_risk"] == n and rows[t]["events"] == d
        assert rows[t]["survival"] == pytest.approx(s, abs=1e-6)


def test_km_lookups(spark, km_fixture):
    curve = KM.km_curve(km_fixture)
    step = KM.survival_at(curve, [4]).first()
    assert step["survival"] == pytest.approx(0.444444, abs=1e-6)
    near = KM.survival_at(curve, [4], nearest=True).first()
    assert near["t"] == 4


def test_km_invariants(spark, sf_small):
    from churnlytics.plans.common import AS_OF, contracts
    s = KM.survival_frame(contracts(spark, sf_small, region=True), AS_OF)
    curve = KM.km_stratified(s, ["campaign", "amount"], min_size=30).toPandas()
    for _, g in curve.groupby(["variable", "stratum"]):
        g = g.sort_values("t")
        assert (g["survival"].diff().dropna() <= 1e-12).all()
        assert g["survival"].between(0, 1).all()


def _numpy_breslow(X, t, e, pen, iters=50):
    n, p = X.shape
    b = np.zeros(p)
    for _ in range(iters):
        w = np.exp(X @ b)
        g = np.zeros(p)
        H = np.zeros((p, p))
        for ti in np.unique(t[e == 1]):
            risk = t >= ti
            ev = (t == ti) & (e == 1)
            d = ev.sum()
            s0 = w[risk].sum()
            s1 = (w[risk, None] * X[risk]).sum(0)
            s2 = (w[risk, None, None] * X[risk, :, None] * X[risk, None, :]).sum(0)
            g += X[ev].sum(0) - d * s1 / s0
            H -= d * (s2 / s0 - np.outer(s1 / s0, s1 / s0))
        g = g / n - pen * b
        H = H / n - pen * np.eye(p)
        step = np.linalg.solve(-H, g)
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    return b


def test_cox_matches_numpy_newton(spark):
    rng = np.random.default_rng(7)
    n = 300
    X = rng.normal(size=(n, 2))
    t = np.ceil(rng.exponential(scale=np.exp(-(0.8 * X[:, 0] - 0.5 * X[:, 1])) * 50)).astype(int)
    e = (rng.random(n) < 0.8).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c), int(d)) for (a, b), c, d in zip(X, t, e)],
                               "x1 double, x2 double, duration int, event int")
    m = fit_cox(df, ["x1", "x2"], penalizer=0.1, ties="breslow")
    ref = _numpy_breslow(X, t, e, 0.1)
    assert m.converged
    np.testing.assert_allclose(m.coef, ref, atol=1e-6)
    assert m.coef[0] > 0 > m.coef[1]
    summ = m.summary(spark).collect()
    assert {r["feature"] for r in summ} == {"x1", "x2"}


def test_cox_efron_equals_breslow_without_ties(spark):
    rows = [(float(i % 7) / 7.0, i + 1, int(i % 3 != 0)) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, duration int, event int")
    a = fit_cox(df, ["x"], penalizer=0.1, ties="breslow").coef
    b = fit_cox(df, ["x"], penalizer=0.1, ties="efron").coef
    np.testing.assert_allclose(a, b, atol=1e-9)


def test_efron_closed_form_equals_explicit():
    from churnlytics.operators.cox import tie_sums
    rng = np.random.default_rng(3)
    d = rng.integers(0, 400, 200).astype(float)
    D0 = d * rng.uniform(0.5, 2.0, 200)
    R0 = D0 + rng.uniform(0.0, 500.0, 200) + 1e-3
    a, b = tie_sums(d, R0, D0, "efron", explicit=10 ** 9), tie_sums(d, R0, D0, "efron", explicit=0)
    for k in a:
        np.testing.assert_allclose(a[k], b[k], rtol=1e-7, atol=1e-9)


def test_cox_lasso_sets_noise_to_zero_and_robust_errors(spark):
    rng = np.random.default_rng(5)
    n = 400
    x = rng.normal(size=(n, 2))
    t = np.ceil(rng.exponential(scale=np.exp(-1.0 * x[:, 0]) * 40)).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c), 1) for (a, b), c in zip(x, t)],
                               "x1 double, x2 double, duration int, event int")
    m = fit_cox(df, ["x1", "x2"], penalizer=0.3, l1_ratio=1.0, robust=True)
    assert m.converged and m.coef[0] > 0.1 and m.coef[1] == 0.0
    plain = fit_cox(df, ["x1", "x2"], penalizer=0.0)
    robust = fit_cox(df, ["x1", "x2"], penalizer=0.0, robust=True)
    np.testing.assert_allclose(plain.se, robust.se, rtol=0.35)  # a well specified model


def test_quartile_strata_match_pandas_qcut(spark):
    import pandas as pd
    rng = np.random.default_rng(9)
    vals = rng.integers(0, 40, 500).astype(float)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    rule = KM.fit_strata_all(df, ["x"])["x"]
    assert rule["kind"] == "quartile"
    got = [int(r["s"]) for r in df.select(KM.stratum_expr("x", rule).alias("s")).collect()]
    want = pd.qcut(pd.Series(vals), q=4, duplicates="drop", labels=False).astype(int).tolist()
    assert got == want


def test_cox_continuous_times(spark):
    rows = [(float(i % 7) / 7.0, i + 0.25 * (i % 3), int(i % 3 != 0)) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, duration double, event int")
    m = fit_cox(df, ["x"], penalizer=0.1)
    arr = np.array(rows)
    ref = _numpy_breslow(arr[:, :1], arr[:, 1], arr[:, 2], 0.1)
    np.testing.assert_allclose(m.coef, ref, atol=1e-6)


def test_null_deletion_type_counts_as_active(spark):
    df = spark.createDataFrame([(1, None, "2001-01-01"), (2, 3, "2001-01-01")], "id long, deletion_type int, d string") \
        .withColumn("start_insurance", F.to_date("d"))
    s = KM.survival_frame(df, "2001-02-01")
    assert [r["event"] for r in s.orderBy("id").collect()] == [0, 1]


def test_null_takes_no_place_among_top_values(spark):
    from churnlytics.operators.features import fit_vocabulary
    from churnlytics.operators.rates import top_n
    df = spark.createDataFrame([(None,)] * 5 + [("x",)] * 3 + [("y",)] * 2, "k string")
    assert KM.top_values(df, "k", 2) == ["x", "y"]
    assert fit_vocabulary(df, "k", 2) == ["x", "y"]
    assert [r["k"] for r in top_n(df, "k", 2).collect()] == ["x", "y"]
    assert KM.fit_strata_all(df, ["k"])["k"]["values"] == ["x", "y"]

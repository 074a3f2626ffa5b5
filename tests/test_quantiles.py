"""Exact quantiles (value-count and bucketed paths) against pandas."""

import numpy as np
import pandas as pd
import pytest

from churnlytics.operators.quantiles import quantiles

QS = [0.0, 0.1, 0.33, 0.5, 0.66, 0.9, 1.0]


@pytest.mark.parametrize("buckets", [1, 16, None])
def test_quantiles_match_pandas(spark, buckets):
    rng = np.random.default_rng(11)
    n = 20_000
    pdf = pd.DataFrame({"g": rng.integers(0, 3, n), "x": np.round(rng.normal(size=n), 4)})
    df = spark.createDataFrame(pdf)
    got = quantiles(df, "x", QS, ["g"], buckets=buckets).toPandas()
    for (g, q), v in got.set_index(["g", "q"])["value"].items():
        assert v == pytest.approx(pdf.loc[pdf.g == g, "x"].quantile(q), abs=1e-9)
    flat = quantiles(df, "x", QS, buckets=buckets).toPandas().set_index("q")["value"]
    for q, v in flat.items():
        assert v == pytest.approx(pdf["x"].quantile(q), abs=1e-9)


def test_quantiles_discrete_golden(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "x int")
    got = quantiles(df, "x", [0.33]).first()["value"]
    assert got == pytest.approx(1.99)


@pytest.mark.parametrize("buckets", [1, 16])
def test_null_group_is_a_group(spark, buckets):
    df = spark.createDataFrame([(None, float(i)) for i in range(5)] + [("a", float(i)) for i in range(3)],
                               "g string, x double")
    got = {r["g"]: r["value"] for r in quantiles(df, "x", [0.5], ["g"], buckets=buckets).collect()}
    assert got == {None: 2.0, "a": 1.0}


def test_describe_by_null_group(spark):
    from churnlytics.operators.rates import describe_by
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, x double")
    assert {r["g"]: r["median"] for r in describe_by(df, "x", "g").collect()} == {None: 2.0, "a": 5.0}

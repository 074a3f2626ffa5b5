"""Quantile sketches of months, stored and merged, against exact ranks."""

import numpy as np
import pandas as pd
import pytest

from churnlytics.operators import sketches as S

QS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def frame(n=40_000, seed=3):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"month": rng.choice([202401, 202402, 202403, 202404], n, p=[0.7, 0.1, 0.1, 0.1]),
                         "g": rng.choice(["a", "b"], n), "x": np.round(rng.gamma(2, 50, n), 2)})


def test_merged_months_keep_the_stated_rank_error(spark):
    pdf = frame()
    df = spark.createDataFrame(pdf).repartition(6)
    windows = {"all": (202401, 202404), "late": (202403, 202404), "one": (202402, 202402), "none": (209901, 209912)}
    made = S.sketches(df, "x", ["month", "g"])
    got = S.window_quantiles(made, "month", windows, QS, ["g"])
    rows = S.rank_errors(S.in_windows(df, "month", windows), got, "x", ["window", "g"]).collect()
    assert len(rows) == 3 * 2 * len(QS)
    assert max(r["rank_error"] for r in rows) <= 2 * S.rank_error()
    for r in got.collect():
        a, z = windows[r["window"]]
        own = np.sort(pdf[(pdf.g == r["g"]) & pdf.month.between(a, z)]["x"].to_numpy())
        assert r["n"] == len(own) and r["value"] in own
        lt, le = np.searchsorted(own, r["value"], "left") / len(own), np.searchsorted(own, r["value"], "right") / len(own)
        assert max(0, r["q"] - le, lt - r["q"]) <= 2 * S.rank_error()
        if r["q"] in (0.0, 1.0):
            assert r["value"] == own[0 if r["q"] == 0 else -1]


def test_few_rows_are_exact_and_ties_nulls_nan_are_defined(spark):
    df = spark.createDataFrame([("a", float(i % 7)) for i in range(100)] + [("a", None), ("a", float("nan")), ("b", None),
                               (None, 5.0), (None, 5.0)], "g string, x double")
    got = {(r["g"], r["q"]): (r["n"], r["value"]) for r in S.quantiles_of(S.sketches(df, "x", ["g"]), [0.0, 0.5, 1.0]).collect()}
    assert got == {("a", 0.0): (100, 0.0), ("a", 0.5): (100, 3.0), ("a", 1.0): (100, 6.0),
                   (None, 0.0): (2, 5.0), (None, 0.5): (2, 5.0), (None, 1.0): (2, 5.0)}
    assert S.quantiles_of(S.merged(S.sketches(df.where("false"), "x", ["g"])), [0.5]).count() == 0


def test_a_delivery_counts_once(spark, tmp_path):
    path, df = str(tmp_path / "sk"), spark.createDataFrame(frame(3000))
    assert S.stored_sketches(spark, path) is None
    for month in (202401, 202402, 202401):
        S.store_sketches(S.sketches(df.where(f"month = {month}"), "x", ["month", "g"]), path, str(month))
    total = S.merged(S.stored_sketches(spark, path)).first()["n"]
    assert total == df.where("month <= 202402").count()
    with pytest.raises(ValueError):
        S.store_sketches(df, path, "a/b")


def test_the_error_falls_with_k(spark):
    assert S.rank_error(200) == pytest.approx(0.0133, abs=1e-4) and S.rank_error(1600) < S.rank_error(200) / 7

"""Smoothed densities against the direct sum of kernels."""

import numpy as np
import pytest

from churnlytics.operators.density import smoothed_density


def test_density_is_the_direct_sum(spark):
    rng = np.random.default_rng(1)
    rows = [(int(c), float(x)) for c in (0, 1) for x in rng.normal(c, 1 + c, 300)] + [(None, 2.0), (0, None), (1, float("nan"))]
    df = spark.createDataFrame(rows, "c int, v double").repartition(4)
    out = smoothed_density(df, "v", ["c"], grid=513).toPandas()
    for c in (0.0, 1.0):
        x = np.array([v for k, v in rows if k == c and v is not None and v == v])
        h = x.std() * len(x) ** -0.2
        part = out[out.c == c].sort_values("x")
        want = np.exp(-((part.x.to_numpy()[:, None] - x) / h) ** 2 / 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
        assert np.abs(part.density.to_numpy() - want).max() < 2e-3 * want.max()
        assert np.trapezoid(part.density, part.x) == pytest.approx(1, abs=1e-3)
    assert len(out[out.c.isna()]) == 513


def test_density_on_grid_points_is_exact(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (2.0,), (9.0,)], "v double")
    out = {r["x"]: r["density"] for r in smoothed_density(df, "v", grid=5, bandwidth=1.5, low=0, high=8).collect()}
    for x in out:
        want = sum(np.exp(-((x - v) / 1.5) ** 2 / 2) for v in (0, 2, 2, 8)) / (4 * 1.5 * np.sqrt(2 * np.pi))
        assert out[x] == pytest.approx(want)
    assert smoothed_density(df.limit(0), "v").count() == 0

"""Loss, gradient and steps of the perceptrons against plain numpy."""

import numpy as np
import pytest

from churnlytics.operators import perceptron as P


def _rows(n=700, seed=3):
    rng = np.random.default_rng(seed)
    x = np.zeros((n, 7))
    x[:, :2] = rng.normal(size=(n, 2))
    x[np.arange(n), 2 + rng.integers(0, 3, n)] = 1
    x[:, 5] = rng.integers(0, 2, n)
    return x, rng.integers(0, 2, n).astype(float), rng.integers(1, 4, n).astype(float)


def _loss(layers, flat, x, y, n):
    a = x
    for k, (w, b) in enumerate(P.layer_weights(layers, flat)):
        z = a @ w + b
        a = 1 / (1 + np.exp(-z)) if k < len(layers) - 2 else z
    return float(n @ (np.log(np.exp(a).sum(axis=1)) - a[np.arange(len(y)), y.astype(int)]))


def test_gradient_is_that_of_the_loss(monkeypatch):
    monkeypatch.setattr(P, "STEP_ROWS", 64)
    layers, (x, y, n) = [7, 6, 4, 2], _rows()
    total = sum(a * b + b for a, b in zip(layers, layers[1:]))
    flat = np.random.default_rng(0).normal(size=total)
    block, grad = P.as_block(x, y, n), np.zeros(total)
    assert block.flags.shape[1] == 5 and block.n.sum() == n.sum()  # the column of zeros is one of flags
    assert abs(P.add_sums(layers, flat, block, grad, P.Room()) - _loss(layers, flat, x, y, n)) < 1e-8
    for k in range(0, total, 5):
        e = np.zeros(total)
        e[k] = 1e-6
        slope = (_loss(layers, flat + e, x, y, n) - _loss(layers, flat - e, x, y, n)) / 2e-6
        assert abs(slope - grad[k]) < 1e-3


def test_large_margins_stay_finite():
    layers, (x, y, n) = [7, 3, 2], _rows(50)
    flat = np.full(7 * 3 + 3 + 3 * 2 + 2, -400.0)
    grad = np.zeros(len(flat))
    assert np.isfinite(P.add_sums(layers, flat, P.as_block(x, y, n), grad, P.Room())) and np.isfinite(grad).all()


def test_minimise_finds_the_bottom_of_a_valley():
    def f(x):
        return (float(100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2),
                np.array([-400 * x[0] * (x[1] - x[0] ** 2) - 2 * (1 - x[0]), 200 * (x[1] - x[0] ** 2)]))
    x, losses = P.minimise(f, np.array([-1.2, 1.0]), 200, 1e-12)
    assert np.abs(x - 1).max() < 1e-4 and losses == sorted(losses, reverse=True) and len(losses) < 60
    assert len(P.minimise(f, np.array([-1.2, 1.0]), 5, 1e-12)[1]) == 6


def test_labels_have_to_be_classes(spark):
    from pyspark.ml.linalg import Vectors
    rows = spark.createDataFrame([(2, 1, Vectors.dense([1.0]))], ["event", "n", "features"])
    with pytest.raises(ValueError):
        P.fit_perceptron(rows, [1, 2, 2], np.zeros(10), 1, 1e-6, 1)


def test_parts_are_added_up_alike(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors
    x, y, n = _rows(300)
    rows = spark.createDataFrame([(float(b), int(c), Vectors.dense(a)) for a, b, c in zip(x, y, n)], ["event", "n", "features"])
    start = np.random.default_rng(1).normal(size=7 * 4 + 4 + 4 * 2 + 2)
    one, losses = P.fit_perceptron(rows, [7, 4, 2], start, 6, 1e-6, 1)
    monkeypatch.setattr(P, "FEW_PARTS", 1)
    three, _ = P.fit_perceptron(rows, [7, 4, 2], start, 6, 1e-6, 3)
    assert np.abs(one - three).max() < 1e-9 and losses[-1] < losses[0]
    assert abs(losses[0] - _loss([7, 4, 2], start, x, y, n) / n.sum()) < 1e-9

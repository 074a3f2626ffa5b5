"""The feed-forward network: gradients against finite differences, a step
against plain numpy, stopping, and fits that do not depend on partitions."""

import tracemalloc

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from churnlytics.operators import network as N


def block(n=40, width=5, seed=0):
    rng = np.random.default_rng(seed)
    return N.Block(rng.normal(size=(n, width)), (rng.random(n) < 0.4).astype(float), rng.uniform(0.5, 2, n),
                   rng.integers(0, 2**63, n).astype(np.uint64))


@pytest.mark.parametrize("normalise,dropout", [(False, (0.0, 0.0)), (False, (0.3, 0.2)), (True, (0.3, 0.2))])
def test_gradient_equals_finite_differences(normalise, dropout):
    p = N.Params(hidden=(6, 4), dropout=dropout, normalise=normalise)
    shape, b = N.Shape(5, p), block()
    flat = shape.start() + np.random.default_rng(1).normal(size=shape.total) * 0.1
    grad, _, rows, stats = N.gradient(shape, flat, b, 3)
    assert rows == 40 and len(stats) == (2 if normalise else 0)
    for i in range(shape.total):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (N.gradient(shape, up, b, 3)[1] - N.gradient(shape, down, b, 3)[1]) / 2e-6
        assert grad[i] == pytest.approx(slope, abs=2e-4)


def test_masks_drop_the_share_and_repeat():
    rows = np.arange(5000, dtype=np.uint64)
    m = N.dropout_mask(rows, 20, 0.3, (42, 0, 0))
    assert abs((m == 0).mean() - 0.3) < 0.01 and abs(m.mean() - 1) < 0.01
    assert (m[100:200] == N.dropout_mask(rows[100:200], 20, 0.3, (42, 0, 0))).all()
    assert (m != N.dropout_mask(rows, 20, 0.3, (42, 1, 0))).any()
    # units and rows are independent of each other
    off = (m == 0).astype(float)
    assert abs(np.corrcoef(off[:, 0], off[:, 1])[0, 1]) < 0.05 and abs(np.corrcoef(off[:-1, 0], off[1:, 0])[0, 1]) < 0.05


def frame(spark, n, width=4, signal=True, seed=5, parts=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1]))) if signal else np.full(n, 0.5)
    y = (rng.random(n) < p).astype(int)
    rows = [(i, int(y[i]), Vectors.dense(x[i])) for i in range(n)]
    return spark.createDataFrame(rows, ["id", "event", "features"]) \
        .repartition(parts), x, y


def test_one_step_equals_numpy(spark):
    df, x, _ = frame(spark, 300)
    p = N.Params(hidden=(5,), dropout=(0.25,), l2=(0.01,), epochs=1, batch_rows=10_000)
    got = N.fit_network(df, p, weight=None)
    # the same rows, hashes and split, taken from the dealt blocks themselves
    blocks, batches, held = N.dealt_blocks(df, p, "event", "features", None)
    parts = {i: b for i, bs in enumerate(blocks.glom().collect()) for b in bs}
    train = [parts[i] for k in batches for i in k if i in parts]
    assert len(batches) == 1 and sum(len(b.y) for b in parts.values()) == 300
    X, y = np.concatenate([b.x for b in train]), np.concatenate([b.y for b in train])
    rows = np.concatenate([b.row for b in train])
    w0, b0 = N.Shape(4, p).start()[:20].reshape(4, 5), np.zeros(5)
    w1 = N.Shape(4, p).start()[25:30].reshape(5, 1)
    mask = N.dropout_mask(rows, 5, 0.25, (42, 0, 0))
    z = X @ w0 + b0
    a = np.maximum(z, 0) * mask
    d = (1 / (1 + np.exp(-(a @ w1)[:, 0])) - y)[:, None] / len(y)
    da = (d @ w1.T) * mask * (z > 0)
    grad = np.concatenate([(X.T @ da + 0.02 * w0).ravel(), da.sum(0), (a.T @ d).ravel(), d.sum(0)])
    step = 0.001 * np.sqrt(1 - 0.999) / (1 - 0.9) * 0.1 * grad / (np.sqrt(0.001) * np.abs(grad) + 1e-7)
    assert np.allclose(got.flat, N.Shape(4, p).start() - step, atol=1e-9)
    m = np.maximum(np.concatenate([parts[i].x for i in held if i in parts]) @ got.flat[:20].reshape(4, 5) + got.flat[20:25], 0)
    m = m @ got.flat[25:30] + got.flat[30]
    yh = np.concatenate([parts[i].y for i in held if i in parts])
    prob = 1 / (1 + np.exp(-m))
    assert got.history[0][2] == pytest.approx(-(yh * np.log(prob) + (1 - yh) * np.log(1 - prob)).mean())
    blocks.unpersist()


def test_fit_learns_and_does_not_depend_on_partitions(spark, tmp_path):
    p = N.Params(hidden=(8, 4), dropout=(0.1, 0.0), l2=(0.0, 0.0), rate=0.02, epochs=12, batch_rows=500)
    df, _, y = frame(spark, 1500)
    one = N.fit_network(df, p, weight=None)
    two = N.fit_network(df.repartition(7, "id"), p, weight=None)
    assert np.allclose(one.flat, two.flat, atol=1e-12) and one.history[-1][2] < one.history[0][2]
    scored = {r["id"]: r["score"] for r in one.transform(df).collect()}
    s = np.array([scored[i] for i in range(len(y))])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1][:200] for b in s[y == 0][:200]])
    assert auc > 0.85
    one.save(spark, str(tmp_path / "net"))
    again = N.NetworkModel.load(spark, str(tmp_path / "net"))
    assert np.allclose(again.flat, one.flat) and again.params == p and again.best == one.best


def test_stops_on_a_planted_overfit_and_keeps_the_best_weights(spark):
    df, _, _ = frame(spark, 240, width=30, signal=False)  # labels are noise: held loss only rises
    p = N.Params(hidden=(32,), dropout=(0.0,), l2=(0.0,), rate=0.02, epochs=200, batch_rows=100, stop_after=6, lower_after=2)
    m = N.fit_network(df, p, weight=None)
    loss = [h[2] for h in m.history]
    assert len(loss) < 60 and m.best == int(np.argmin(loss)) and len(loss) == m.best + 7
    assert m.history[-1][1] < m.history[m.best][1]  # the training loss went on falling
    assert m.history[-1][3] < 0.02                  # the rate fell on the plateau


def test_normalised_layers_and_weights(spark):
    df, _, _ = frame(spark, 1200)
    df = df.selectExpr("*", "IF(event = 1, 2.0D, 0.5D) AS weight")
    p = N.Params(hidden=(8, 4), dropout=(0.1, 0.0), l2=(0.0, 0.001), normalise=True, rate=0.02, epochs=40, batch_rows=400,
                 weighted=True, stop_after=40)
    m = N.fit_network(df, p)
    assert min(h[2] for h in m.history) < m.history[0][2] and len(m.means) == 2


def test_refuses_what_cannot_be_fitted(spark):
    df, _, _ = frame(spark, 3)
    with pytest.raises(ValueError):
        N.fit_network(df.where("id < 0"), N.SMALL, weight=None)
    with pytest.raises(ValueError):
        N.fit_network(df.selectExpr("id", "CAST(NULL AS INT) AS event", "features"), N.SMALL, weight=None)
    with pytest.raises(ValueError):
        N.Params(hidden=(3,), dropout=(0.1, 0.1), l2=(0.0,))
    with pytest.raises(ValueError):
        N.Params(held=0.0)


def test_an_epoch_is_a_few_jobs_however_many_batches(spark):
    df, _, _ = frame(spark, 2400)
    df = df.cache()
    jobs, epochs = [], 4
    for rows in (2400, 60):  # 1 and 32 mini-batches, the latter in two shards
        p = N.Params(hidden=(6,), dropout=(0.1,), l2=(0.0,), normalise=True, rate=0.01, epochs=epochs, batch_rows=rows)
        group = f"epochs of {rows}"
        spark.sparkContext.setJobGroup(group, group)
        model = N.fit_network(df, p, weight=None)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        assert len(model.history) == epochs and model.history[-1][1] < model.history[0][1]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert N.shards_of(32) == 2 and jobs[1] <= jobs[0] + epochs


def test_shards_step_from_the_common_weights_and_are_averaged_by_rows(spark):
    df, _, _ = frame(spark, 2400)
    p = N.Params(hidden=(6,), dropout=(0.1,), l2=(0.01,), rate=0.01, epochs=1, batch_rows=60)
    got = N.fit_network(df, p, weight=None)
    train, held, of_batch = N.dealt_shards(df, p, "event", "features", None)
    shards, shape = train.glom().collect(), N.Shape(4, p)
    order = np.random.default_rng([42, 0]).permutation(len({b[0] for s in shards for b in s}))
    flats, rows = [], []
    assert len(shards) == 2 and of_batch == 1
    for s in shards:
        blocks, flat, adam = dict(s), shape.start(), N.Adam(shape.total)
        for k in order:
            if k in blocks:
                grad, _, n, _ = N.gradient(shape, flat, blocks[k], 0)
                grad = grad / n
                grad[:24] += 0.02 * flat[:24]
                flat = adam.move(flat, grad, 0.01)
        flats.append(flat)
        rows.append(sum(len(b.y) for b in blocks.values()))
    assert np.allclose(got.flat, np.average(flats, axis=0, weights=rows), atol=1e-12)
    assert sum(rows) + sum(len(b.y) for _, b in held.collect()) == 2400
    train.unpersist()
    held.unpersist()


@pytest.mark.parametrize("params", [N.SMALL, N.LARGE])
def test_blocks_of_a_task_share_their_arrays(params):
    shape, room, big = N.Shape(5, params), N.Room(), block(4000, seed=1)
    flat, means = shape.start(), shape.fresh_means()
    for b in (big, block(700, seed=2), block(3900, seed=3)):  # what a larger block left there changes nothing
        fresh, again = N.gradient(shape, flat, b, 2), N.gradient(shape, flat, b, 2, room)
        assert (fresh[0] == again[0]).all() and fresh[1:3] == again[1:3]
        assert all((x == y).all() for s, t in zip(fresh[3], again[3]) for x, y in zip(s, t))
        assert (N.scores(shape, flat, means, b.x) == N.scores(shape, flat, means, b.x, room)).all()
    tracemalloc.start()
    N.gradient(shape, flat, big, 3, room)
    N.scores(shape, flat, means, big.x, room)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4000 * min(params.hidden) * 8  # no array of rows x units is made anew

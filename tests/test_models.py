"""Model pipeline on a planted-signal fixture, and the Cox -> KM -> constant fallback."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from churnlytics.operators import cox as COX
from churnlytics.operators import evaluate as E
from churnlytics.operators import models as M


def _fixture(spark, n=1500, seed=1):
    rng = np.random.default_rng(seed)
    amount = rng.choice([9.9, 14.9, 19.9, 24.9, 29.9], n)
    term = rng.choice([365.0, 730.0, 1095.0], n)
    days = rng.integers(0, 2500, n).astype(float)
    camp = rng.choice(["FO-SCL", "JD-ITM", "M3-OTM"], n)
    logit = -2.0 + 0.12 * amount + (camp == "JD-ITM") * 1.0
    event = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "amount": amount, "term_days": term, "days_from_start": days,
                        "product_code": rng.choice(["3402", "3783"], n), "campaign": camp,
                        "region_code": rng.choice(["A", "B"], n), "event": event})
    return spark.createDataFrame(pdf)


def test_logistic_regression_learns_signal(spark):
    df = _fixture(spark)
    train, test = df.where(F.col("id") % 5 != 0), df.where(F.col("id") % 5 == 0)
    m = M.fit_model(train, "logistic_regression")
    r = E.evaluate(M.predict(m, test), "event", "predicted", "score").first()
    assert r["roc_auc"] > 0.6


def test_every_kind_learns_and_is_compared(spark):
    df = _fixture(spark)
    train, test = df.where(F.col("id") % 5 != 0), df.where(F.col("id") % 5 == 0)
    models, table = M.train_all(train, test, ("gbt", "random_forest", "logistic_regression", "mlp", "mlp_128"))
    rows = {r["model"]: r for r in table.collect()}
    assert set(rows) == set(models) and sum(r["best"] for r in rows.values()) == 1
    assert all(r["roc_auc"] > 0.6 for r in rows.values())


def test_tuning_picks_a_trial(spark):
    df = _fixture(spark, n=500)
    trials = [{"maxIter": 5, "maxDepth": 2, "stepSize": 0.1}, {"maxIter": 5, "maxDepth": 3, "stepSize": 0.2,
                                                             "featureSubsetStrategy": "sqrt"}]
    m = M.tune_gbt(df, folds=2, trials=trials)
    assert E.evaluate(M.predict(m, df), "event", "predicted", "score").first()["roc_auc"] > 0.6
    assert len(M.gbt_trials(50)) == 50


def test_feature_sets(spark):
    df = spark.createDataFrame([(1, None, None, 9.9, 3402, None), (2, "2001-01-01", "2002-01-01", 9.9, 3783, "1980-05-01")],
                               "id long, s string, e string, amount double, product_code int, b string")
    df = df.select("id", "amount", "product_code", F.lit(None).cast("int").alias("deletion_type"),
                   *[F.to_date(a).alias(n) for a, n in (("s", "start_insurance"), ("e", "end_insurance"), ("b", "birthday"))])
    got = {v: M.build_features(df, "2002-01-01", v).orderBy("id").collect() for v in M.FEATURE_SETS}
    assert (got["survival"][0]["term_days"], got["survival"][0]["days_from_start"]) == (365.0, 180.0)
    assert (got["classifier"][0]["term_days"], got["classifier"][0]["days_from_start"]) == (0.0, 0.0)
    assert got["tuned"][1]["birth_month"] == "5" and 21 < got["tuned"][1]["age"] < 22
    assert got["tuned"][0]["birth_month"] == "-1" and got["classifier"][0]["event"] == 0


def test_fallback_chain(spark):
    df = spark.createDataFrame([(1.0, 5, 1), (1.0, 6, 1)], "x double, duration int, event int")
    kind, pred = COX.predict_with_fallback(df, df, ["x"], km_fallback=lambda: df.withColumn(
        "churn_probability", F.lit(0.3)), penalizers=(0.1,), max_iter=0)
    assert kind == "kaplan_meier"
    kind, pred = COX.predict_with_fallback(df, df, ["x"], km_fallback=None, penalizers=(0.1,), max_iter=0)
    assert kind == "constant" and pred.first()["churn_probability"] == 0.5


def test_importances_and_registry(spark):
    import tempfile
    df = _fixture(spark, n=600)
    m = M.fit_model(df, "random_forest")
    top = M.feature_importances(m, df, 5)
    assert len(top) == 5 and top[0][1] >= top[-1][1]
    assert any(name.startswith("campaign") or name.startswith("amount") or "num" in name for name, _ in top)
    path = tempfile.mkdtemp(prefix="churnlytics-models-")
    M.save_models({"rf": m}, path)
    back = M.load_models(["rf"], path)["rf"]
    assert back.transform(M.fill_categories(df)).count() == 600


def test_models_compared_takes_every_kind(spark, monkeypatch):
    from churnlytics.plans import q_models as Q
    default = M.train_all.__defaults__[0]
    taken = []

    def fits(train, test, kinds=default, variant="classifier"):
        taken.extend(kinds)
        return {}, spark.createDataFrame([(k, 0.5) for k in kinds], "model string, auc double")
    monkeypatch.setattr(Q, "model_split", lambda *a, **k: (None, None))
    monkeypatch.setattr(Q.M, "train_all", fits)
    got = Q.q_models_compared(spark, "").collect()
    assert sorted(taken) == sorted(M.KINDS) and {r["model"] for r in got} == set(M.KINDS)


def test_network_with_dropout_stops_and_scores(spark):
    from churnlytics.operators import network as N
    df = _fixture(spark)
    train, test = df.where(F.col("id") % 5 != 0), df.where(F.col("id") % 5 == 0)
    fitted = M.fit_network(train, N.Params(rate=0.01, epochs=25, batch_rows=500, stop_after=5))
    scored = M.predict_network(fitted, test)
    r = E.evaluate(scored, "event", "predicted", "score").first()
    assert r["roc_auc"] > 0.6 and r["tn"] + r["fp"] + r["fn"] + r["tp"] == test.count()


def test_preprocessor_scales_by_the_population_deviation(spark):
    df = _fixture(spark, n=40)
    _, vectors = M.prepare(df, keep=["amount"])
    got = {r["amount"]: r["features"][0] for r in vectors.collect()}
    a = df.toPandas()["amount"]
    for value, z in got.items():
        assert abs(z - (value - a.mean()) / a.std(ddof=0)) < 1e-9


def test_evaluate_with_scores_equals_its_parts(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"event": rng.integers(0, 2, 400), "predicted": rng.integers(0, 2, 400),
                        "score": np.round(rng.random(400), 2)})
    df = spark.createDataFrame(pdf).selectExpr("event", "predicted", "nullif(score, 0.5D) AS score")
    r = E.evaluate(df, "event", "predicted", "score").first()
    m = E.metrics_from_confusion(E.confusion(df)).first()
    c = E.curve_summary(E.score_cumulative(df)).first()
    assert all(r[k] == m[k] for k in m.asDict()) and r["roc_auc"] == c["roc_auc"]
    assert abs(r["average_precision"] - c["average_precision"]) < 1e-12
    none = E.evaluate(df.where("false"), "event", "predicted", "score").first()
    assert none["tp"] == 0 and none["accuracy"] == 0


def test_training_vectors_are_dealt_evenly(spark, monkeypatch):
    df = _fixture(spark, n=4000).coalesce(1)
    assert M.prepare(df)[1].rdd.getNumPartitions() == 1  # few rows stay where they are
    monkeypatch.setattr(M, "PART_ROWS", 1000)
    _, vectors = M.prepare(df, keep=["id"])
    sizes = [n for n in vectors.rdd.glom().map(len).collect() if n]
    assert sum(sizes) == 4000 and len(sizes) == min(4, spark.sparkContext.defaultParallelism)
    assert max(sizes) <= 1.1 * min(sizes) and vectors.select("id").distinct().count() == 4000
    monkeypatch.undo()
    assert [M.partitions_of(n, 12) for n in (0, 16_384, 40_000, 720_000, 7_200_000, 43_200_000)] == [1, 1, 3, 12, 12, 48]


def test_boosted_trees_keep_no_node_ids(spark):
    df = _fixture(spark, n=400)
    assert not M.gbt(42, maxIter=5).getCacheNodeIds() and not M.make_estimator("gbt_depth5").getCacheNodeIds()
    _, vectors = M.prepare(df)
    with_ids, without = (M.gbt(42, maxIter=5, maxDepth=4).setCacheNodeIds(c).fit(vectors) for c in (True, False))
    assert with_ids.toDebugString.splitlines()[1:] == without.toDebugString.splitlines()[1:]


def test_kinds_are_fitted_side_by_side_and_come_in_their_order(spark, monkeypatch):
    import threading
    met = threading.Barrier(2)

    def fits(prep, vectors, kind):
        met.wait(30)  # two fits have to be under way at once
        return kind
    monkeypatch.setattr(M, "prepare", lambda train, variant: (None, None))
    monkeypatch.setattr(M, "fit_prepared", fits)
    monkeypatch.setattr(M, "predict", lambda model, test: model)
    monkeypatch.setattr(M, "evaluate", lambda scored, *a: f"of {scored}")
    monkeypatch.setattr(M, "model_comparison", lambda results: results)
    kinds = ("mlp", "gbt")
    assert M.train_all(None, None, kinds, parallelism=2) == ({"mlp": "mlp", "gbt": "gbt"}, {"mlp": "of mlp", "gbt": "of gbt"})


def _prepared(spark, monkeypatch, n=3000):
    """A fixture of equal and unequal rows, more than are fitted uncounted."""
    monkeypatch.setattr(M, "COUNTED_ROWS", 500)
    df = _fixture(spark, n=n).withColumn("days_from_start", F.floor(F.col("days_from_start") / 125).cast("double"))
    return (df, *M.prepare(df))


def test_trees_of_counted_bins_are_those_of_all_rows(spark, monkeypatch):
    df, prep, vectors = _prepared(spark, monkeypatch)
    read = []
    counted = M.counted
    monkeypatch.setattr(M, "counted", lambda *a: read.append(counted(*a)) or read[-1])
    for kind in M.GBT_DEPTHS:
        est = M.gbt(42, maxIter=6, maxDepth=M.GBT_DEPTHS[kind])
        monkeypatch.setattr(M, "make_estimator", lambda *a, est=est: est)
        model = M.fit_prepared(prep, vectors, kind)
        n, total = read.pop().agg(F.count("n"), F.sum("n")).first()
        assert n < 3000 and total == 3000  # fewer rows are read, none is lost
        plain = {r["id"]: r["score"] for r in M.predict(M.PipelineModel(stages=[*prep.stages, est.fit(vectors)]), df).collect()}
        own = {r["id"]: r["score"] for r in M.predict(model, df).collect()}
        assert own.keys() == plain.keys() and max(abs(own[k] - plain[k]) for k in own) < 1e-9
        names = M.feature_importances(model, df, 3)
        assert [x for x, _ in names] == [x for x, _ in M.feature_importances(M.PipelineModel(stages=[*prep.stages, est.fit(vectors)]), df, 3)]


def test_tree_cuts_of_few_and_of_many_values(spark):
    rows = [(float(i % 3), float(i), 7.0, float("nan") if i % 2 else 1.0) for i in range(640)]
    df = spark.createDataFrame(rows, "few double, many double, one double, odd double")
    few, many, one, odd = M.tree_cuts(df, df.columns, 32)
    assert few == [0.5, 1.5] and one == [7.0] and odd == [1.0]
    sizes = np.bincount(np.searchsorted(many, np.arange(640.0), side="right"))
    assert len(many) == 31 and set(sizes) == {20}


def test_perceptron_on_counted_rows_takes_the_steps_of_spark(spark, monkeypatch):
    df, prep, vectors = _prepared(spark, monkeypatch)
    est = M.MultilayerPerceptronClassifier(labelCol="event", layers=[len(vectors.first()["features"]), 8, 4, 2], seed=42,
                                           maxIter=12, blockSize=4000)
    monkeypatch.setattr(M, "make_estimator", lambda *a: est)
    want = est.fit(vectors.coalesce(1))  # one block: its mean loss is that of all rows
    model = M.fit_prepared(prep, vectors, "mlp")
    got = model.stages[-1]
    assert np.abs(got.weights.toArray() - want.weights.toArray()).max() < 1e-8
    assert got.getMaxIter() == 12 and M.predict(model, df).where("score BETWEEN 0 AND 1").count() == 3000
    assert M.counted(vectors, M.values_of(prep)).agg(F.sum("n")).first()[0] == 3000


def test_few_rows_are_fitted_by_the_estimator_itself(spark, monkeypatch):
    df = _fixture(spark, n=300)
    prep, vectors = M.prepare(df)
    monkeypatch.setattr(M, "counted", None)
    est = M.gbt(42, maxIter=2)
    monkeypatch.setattr(M, "make_estimator", lambda *a: est)
    assert len(M.fit_prepared(prep, vectors, "gbt").stages) == len(prep.stages) + 1

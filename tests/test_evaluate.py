"""Evaluation fixtures (FIXTURES §3) and the distributed prefix sum vs brute force."""

import numpy as np
import pandas as pd
import pytest

from churnlytics.operators import evaluate as E


def test_ap_auc_golden(spark):
    df = spark.createDataFrame(list(zip([.9, .8, .7, .6, .6], [1, 0, 1, 0, 1])), "score double, event int")
    r = E.curve_summary(E.score_cumulative(df, "score")).first()
    assert r["average_precision"] == pytest.approx(0.755556, abs=1e-6)
    assert r["roc_auc"] == pytest.approx(0.583333, abs=1e-6)


def test_prefix_sum_many_buckets(spark):
    rng = np.random.default_rng(3)
    n = 5000
    s = np.round(rng.random(n), 3)
    y = (rng.random(n) < s).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"score": s, "event": y}))
    got = E.score_cumulative(df, "score", buckets=16).toPandas().sort_values("score", ascending=False)
    g = pd.DataFrame({"score": s, "event": y}).groupby("score")["event"].agg(["sum", "count"]).sort_index(ascending=False)
    np.testing.assert_array_equal(got["cum_pos"].to_numpy(), g["sum"].cumsum().to_numpy())
    np.testing.assert_array_equal(got["cum_neg"].to_numpy(), (g["count"] - g["sum"]).cumsum().to_numpy())
    # AUC equals the Mann-Whitney statistic.
    auc = E.curve_summary(E.score_cumulative(df, "score")).first()["roc_auc"]
    pos, neg = s[y == 1], s[y == 0]
    mw = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert auc == pytest.approx(mw, abs=1e-9)


def test_confusion_and_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (1, 1)], "event int, predicted int")
    cm = E.confusion(df).first()
    assert (cm["tn"], cm["fp"], cm["fn"], cm["tp"]) == (1, 1, 1, 2)
    m = E.metrics_from_confusion(E.confusion(df)).first()
    assert m["precision"] == pytest.approx(2 / 3) and m["recall"] == pytest.approx(2 / 3)
    rep = {r["class"]: r for r in E.classification_report(df).collect()}
    assert rep["1"]["support"] == 3 and rep["weighted avg"]["support"] == 5


def test_threshold_sweep_first_best_wins(spark):
    df = spark.createDataFrame([(0.9, 1), (0.1, 0)], "score double, event int")
    r = E.threshold_sweep(df, [0.2, 0.3, 0.95], "score").orderBy("idx").collect()
    assert [x["best_f1"] for x in r] == [True, False, False]


def test_auc_matches_spark_ml_exact(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    rng = np.random.default_rng(5)
    n = 4000
    s = np.round(rng.random(n), 2)
    y = (rng.random(n) < s).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"score": s, "event": y}))
    ours = E.curve_summary(E.score_cumulative(df, "score")).first()["roc_auc"]
    ml = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="event", metricName="areaUnderROC",
                                       numBins=0).evaluate(df)
    assert ours == pytest.approx(ml, abs=1e-9)


def test_threshold_is_exclusive(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.6, 1)], "score double, event int")
    r = E.threshold_sweep(df, [0.5], "score").first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (1, 0, 1, 1)

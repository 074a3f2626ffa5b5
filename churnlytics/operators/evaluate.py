"""Evaluation of churn predictions.

Counting metrics are one-pass ``count_if`` aggregations. Curve metrics (ROC,
PR, average precision, AUC) need cumulative counts over the scores sorted
descending; a window without ``partitionBy`` would move every distinct score
into one task, so ``score_cumulative`` runs a distributed prefix sum:

1. positives/negatives per distinct score (partial aggregation);
2. range buckets from approximate quantiles of the distinct scores (the
   bucket count grows with the number of distinct scores; cut points are
   computed once and applied as literals, so a recomputed task lands every
   score in the same bucket);
3. per-bucket totals (one row per bucket) -> offsets by a running sum over
   that small table, broadcast back;
4. running sums inside each bucket (``partitionBy(bucket)``) plus the offset.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlytics.operators.buckets import bucket_count, cut_points, running_sums, with_range_bucket
from churnlytics.session import cut_lineage


def _safe(num: Column, den: Column) -> Column:
    """Ratio with 0 when the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), F.nullif(den.cast("double"), F.lit(0.0))), F.lit(0.0))


# --- E1 - E3 -----------------------------------------------------------------------
def confusion(df: DataFrame, label: str = "event", pred: str = "predicted") -> DataFrame:
    """One row ``tn, fp, fn, tp``."""
    y, p = F.col(label), F.col(pred)
    return df.agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def metrics_from_confusion(cm: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, specificity, balanced accuracy (0 on 0/0)."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision = _safe(tp, tp + fp)
    recall = _safe(tp, tp + fn)
    spec = _safe(tn, tn + fp)
    return cm.select("*", _safe(tp + tn, tn + fp + fn + tp).alias("accuracy"), precision.alias("precision"),
                     recall.alias("recall"), _safe(2 * precision * recall, precision + recall).alias("f1"),
                     spec.alias("specificity"), ((recall + spec) / 2).alias("balanced_accuracy"))


def normalized_confusion(df: DataFrame, label: str = "event", pred: str = "predicted") -> DataFrame:
    """Row-normalised matrix (share of each prediction per true class) and
    the 'perfect' counts (class totals on the diagonal)."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(pred) == 0).alias("_p0"),
                              F.count_if(F.col(pred) == 1).alias("_p1"))
    return g.select(label, "n", _safe(F.col("_p0"), F.col("n")).alias("share_pred_0"),
                    _safe(F.col("_p1"), F.col("n")).alias("share_pred_1"),
                    F.when(F.col(label) == 0, F.col("n")).otherwise(0).alias("perfect_pred_0"),
                    F.when(F.col(label) == 1, F.col("n")).otherwise(0).alias("perfect_pred_1"))


def classification_report(df: DataFrame, label: str = "event", pred: str = "predicted") -> DataFrame:
    """Per-class precision/recall/F1/support plus macro and weighted averages."""
    cm = confusion(df, label, pred)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def cls(name, t, f_p, f_n, support):
        p = _safe(t, t + f_p)
        r = _safe(t, t + f_n)
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        _safe(2 * p * r, p + r).alias("f1"), support.cast("long").alias("support"))
    rows = cm.select(F.array(cls("0", tn, fn, fp, tn + fp), cls("1", tp, fp, fn, tp + fn)).alias("a"))
    per = rows.select(F.explode("a").alias("r")).select("r.*")
    total = F.sum("support")
    avg = per.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                  F.avg("f1").alias("f1"), total.alias("support"))
    wavg = per.agg(F.lit("weighted avg").alias("class"),
                   _safe(F.sum(F.col("precision") * F.col("support")), total).alias("precision"),
                   _safe(F.sum(F.col("recall") * F.col("support")), total).alias("recall"),
                   _safe(F.sum(F.col("f1") * F.col("support")), total).alias("f1"), total.alias("support"))
    return per.unionByName(avg).unionByName(wavg)


# --- E4 - E6 distributed prefix sum ---------------------------------------------------
def score_cumulative(df: DataFrame, score: str = "score", label: str = "event", buckets: int | None = None) -> DataFrame:
    """Per distinct score (descending): ``pos, neg, cum_pos, cum_neg`` where the
    cumulative counts include every score >= this one. ``buckets`` defaults to
    a count sized to the number of distinct scores (``operators.buckets``)."""
    g = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        (F.count(F.lit(1)) - F.sum(F.col(label).cast("long"))).alias("neg"))
    # the counts are read four times: cut the lineage once
    return cumulate(cut_lineage(g), buckets)


def cumulate(g: DataFrame, buckets: int | None = None) -> DataFrame:
    """``score_cumulative`` from the table ``(score, pos, neg)`` of distinct scores."""
    if buckets is None:
        buckets = bucket_count(g.count())
    g = with_range_bucket(g, "score", cut_points(g, "score", buckets), "bucket")
    g = g.select("score", "pos", "neg", F.col("pos").alias("cum_pos"), F.col("neg").alias("cum_neg"), "bucket")
    return running_sums(g, "score", ["cum_pos", "cum_neg"], descending=True).drop("bucket")


def class_totals(cum: DataFrame) -> tuple[int, int]:
    """Positives and negatives (two scalars)."""
    r = cum.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    return int(r["P"] or 0), int(r["N"] or 0)


def roc_points(cum: DataFrame) -> DataFrame:
    """``(threshold, fpr, tpr)`` at every distinct score (predict 1 if score >= threshold)."""
    P, N = class_totals(cum)
    return cum.select(F.col("score").alias("threshold"), _safe(F.col("cum_neg"), F.lit(N)).alias("fpr"),
                      _safe(F.col("cum_pos"), F.lit(P)).alias("tpr"))


def pr_points(cum: DataFrame) -> DataFrame:
    """``(threshold, precision, recall)`` at every distinct score."""
    P, _ = class_totals(cum)
    return cum.select(F.col("score").alias("threshold"),
                      _safe(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
                      _safe(F.col("cum_pos"), F.lit(P)).alias("recall"))


def curve_summary(cum: DataFrame) -> DataFrame:
    """ROC AUC (ties count one half) and average precision (step sum
    ``sum(delta recall x precision)``), one aggregation over distinct scores."""
    s = cum.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                F.sum(F.col("pos") * (F.col("cum_neg") * -1.0 + F.col("neg") * 0.5)).alias("_a"),
                F.sum(F.col("pos") * _safe(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))).alias("_ap"))
    # sum_s pos_s * (N - cum_neg_s + neg_s/2) = P*N + _a
    return s.select(_safe(F.col("P") * F.col("N") + F.col("_a"), F.col("P") * F.col("N")).alias("roc_auc"),
                    _safe(F.col("_ap"), F.col("P")).alias("average_precision"), "P", "N")


# --- E7 threshold sweep --------------------------------------------------------------
def threshold_sweep(df: DataFrame, thresholds: Sequence[float], score: str = "score", label: str = "event") -> DataFrame:
    """Confusion counts and metrics per threshold (predict 1 if score > t),
    all thresholds in one scan; ``best_f1`` / ``best_balanced`` flag the first best."""
    y, s = F.col(label), F.col(score)
    aggs = []
    for i, t in enumerate(thresholds):
        aggs += [F.count_if((y == 0) & (s <= t)).alias(f"tn{i}"), F.count_if((y == 0) & (s > t)).alias(f"fp{i}"),
                 F.count_if((y == 1) & (s <= t)).alias(f"fn{i}"), F.count_if((y == 1) & (s > t)).alias(f"tp{i}")]
    row = df.agg(*aggs)
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("idx"), F.lit(float(t)).alias("threshold"), F.col(f"tn{i}").alias("tn"),
                 F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn"), F.col(f"tp{i}").alias("tp"))
        for i, t in enumerate(thresholds)])).alias("r")).select("r.*")
    m = metrics_from_confusion(long)
    w = Window.partitionBy()
    best_f1 = F.min_by("idx", F.struct(-F.col("f1"), F.col("idx"))).over(w)
    best_ba = F.min_by("idx", F.struct(-F.col("balanced_accuracy"), F.col("idx"))).over(w)
    return m.withColumn("best_f1", F.col("idx") == best_f1).withColumn("best_balanced", F.col("idx") == best_ba)


def percentile_thresholds(df: DataFrame, score: str, percentiles: Sequence[float]) -> list[float]:
    """E7 variant: thresholds at score percentiles (few scalars)."""
    from churnlytics.operators.quantiles import quantiles
    rows = quantiles(df, score, [p / 100.0 for p in percentiles], approx=False).orderBy("q").collect()
    return [float(r["value"]) for r in rows]


# --- E11 / E12 / E10 / E13 --------------------------------------------------------------
def prediction_summary(df: DataFrame, prob: str = "churn_probability", pred: str = "predicted") -> DataFrame:
    """Min / median / max / mean probability and share predicted positive."""
    from churnlytics.operators.quantiles import median
    basic = df.agg(F.min(prob).alias("min"), F.max(prob).alias("max"), F.avg(prob).alias("mean"),
                   F.avg(F.col(pred).cast("double")).alias("share_predicted"), F.count(F.lit(1)).alias("n"))
    return _attach_scalar(basic, median(df, prob), "median")


def _attach_scalar(row: DataFrame, scalar: DataFrame, name: str) -> DataFrame:
    """Attach the single value of a one-row frame (collected: one scalar)."""
    v = scalar.first()
    return row.withColumn(name, F.lit(None if v is None else v[0]).cast("double"))


def split_summary(df: DataFrame, split: str = "split", label: str = "event") -> DataFrame:
    """Size, share and event rate per split."""
    g = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("event_rate"))
    return g.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def evaluate(df: DataFrame, label: str = "event", pred: str = "predicted", score: str | None = None) -> DataFrame:
    """One row of E1 + E3 (+ E5/E6 when a score is given)."""
    if score is None:
        return metrics_from_confusion(confusion(df, label, pred))
    # One pass over the rows: matrix and curve both come from the counts.
    counts = cut_lineage(df.groupBy(F.col(score).cast("double").alias("score"), F.col(pred).alias("pred"),
                                    F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")))

    def cell(y, p):
        return F.coalesce(F.sum(F.when((F.col("label") == y) & (F.col("pred") == p), F.col("n"))), F.lit(0))

    m = metrics_from_confusion(counts.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"),
                                          cell(1, 1).alias("tp")))
    pos = F.sum(F.col("label").cast("long") * F.col("n"))
    by_score = cut_lineage(counts.where("score IS NOT NULL").groupBy("score").agg(pos.alias("pos"),
                                                                                  (F.sum("n") - pos).alias("neg")))
    c = curve_summary(cumulate(by_score)).select("roc_auc", "average_precision").first()
    return m.withColumn("roc_auc", F.lit(c["roc_auc"])).withColumn("average_precision", F.lit(c["average_precision"]))


def model_comparison(results: dict[str, DataFrame]) -> DataFrame:
    """One row per model (from ``evaluate``), sorted by accuracy; ``best`` marks the first."""
    parts = [r.select(F.lit(name).alias("model"), "*") for name, r in results.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy()
    first_best = F.min_by("model", F.struct((-F.col("accuracy")).alias("a"), F.col("model").alias("m"))).over(w)
    return u.withColumn("best", F.col("model") == first_best)

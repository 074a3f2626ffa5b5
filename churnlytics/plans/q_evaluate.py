"""Evaluation queries (E1-E13) over the KM predictions of the test split."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlytics.operators import evaluate as E
from churnlytics.operators.rates import density_histogram
from churnlytics.operators.features import stratified_split
from churnlytics.plans.catalog import register
from churnlytics.plans.common import rounded
from churnlytics.plans.oracle import oracle
from churnlytics.plans.q_survival import adjusted_predictions, predict_ctes, survival_base

THRESHOLDS = [0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6]
PRED = predict_ctes()


def _pred(spark, sf_dir):
    return adjusted_predictions(spark, sf_dir).withColumn("score", F.col("adjusted_probability"))


def _safe(num, den):
    return f"coalesce(({num})::DOUBLE / nullif(({den})::DOUBLE, 0), 0.0)"


CM = """cm AS (SELECT count(*) FILTER (WHERE event = 0 AND predicted = 0) AS tn,
                  count(*) FILTER (WHERE event = 0 AND predicted = 1) AS fp,
                  count(*) FILTER (WHERE event = 1 AND predicted = 0) AS fn,
                  count(*) FILTER (WHERE event = 1 AND predicted = 1) AS tp FROM pred)"""


def metrics_sql(src: str) -> str:
    p, r, sp = _safe("tp", "tp + fp"), _safe("tp", "tp + fn"), _safe("tn", "tn + fp")
    return f"""SELECT *, round({_safe('tp + tn', 'tn + fp + fn + tp')}, 6) AS accuracy, round({p}, 6) AS precision,
       round({r}, 6) AS recall, round({_safe(f'2 * {p} * {r}', f'{p} + {r}')}, 6) AS f1,
       round({sp}, 6) AS specificity, round(({r} + {sp}) / 2, 6) AS balanced_accuracy FROM {src}"""


@register("confusion_matrix")
def q_cm(spark, sf_dir):
    return E.confusion(_pred(spark, sf_dir))


oracle("confusion_matrix", "SELECT * FROM cm", extra_ctes=f"{PRED},\n{CM}")


@register("classification_metrics")
def q_metrics(spark, sf_dir):
    return rounded(E.metrics_from_confusion(E.confusion(_pred(spark, sf_dir))))


oracle("classification_metrics", metrics_sql("cm"), extra_ctes=f"{PRED},\n{CM}")


@register("normalized_confusion")
def q_norm_cm(spark, sf_dir):
    return rounded(E.normalized_confusion(_pred(spark, sf_dir)))


oracle("normalized_confusion", f"""
SELECT event, count(*) AS n, round({_safe('count(*) FILTER (WHERE predicted = 0)', 'count(*)')}, 6) AS share_pred_0,
       round({_safe('count(*) FILTER (WHERE predicted = 1)', 'count(*)')}, 6) AS share_pred_1,
       CASE WHEN event = 0 THEN count(*) ELSE 0 END AS perfect_pred_0,
       CASE WHEN event = 1 THEN count(*) ELSE 0 END AS perfect_pred_1
FROM pred GROUP BY event
""", extra_ctes=PRED)


@register("classification_report")
def q_report(spark, sf_dir):
    return rounded(E.classification_report(_pred(spark, sf_dir)))


_P0, _R0 = _safe("tn", "tn + fn"), _safe("tn", "tn + fp")
_P1, _R1 = _safe("tp", "tp + fp"), _safe("tp", "tp + fn")
oracle("classification_report", f"""
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
  SELECT * FROM per
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM per
  UNION ALL SELECT 'weighted avg', {_safe('sum(precision * support)', 'sum(support)')},
                   {_safe('sum(recall * support)', 'sum(support)')}, {_safe('sum(f1 * support)', 'sum(support)')},
                   sum(support)::BIGINT FROM per)
""", extra_ctes=f"""{PRED},
{CM},
per AS (SELECT '0' AS class, {_P0} AS precision, {_R0} AS recall, {_safe(f'2 * {_P0} * {_R0}', f'{_P0} + {_R0}')} AS f1,
               (tn + fp)::BIGINT AS support FROM cm
        UNION ALL
        SELECT '1', {_P1}, {_R1}, {_safe(f'2 * {_P1} * {_R1}', f'{_P1} + {_R1}')}, (tp + fn)::BIGINT FROM cm)""")


CUM = """g AS (SELECT adjusted_probability AS score, sum(event)::BIGINT AS pos, (count(*) - sum(event))::BIGINT AS neg
       FROM pred GROUP BY adjusted_probability),
cu AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
              sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_neg,
              sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM g)"""


@register("roc_points")
def q_roc(spark, sf_dir):
    return rounded(E.roc_points(E.score_cumulative(_pred(spark, sf_dir), "score")))


oracle("roc_points", f"SELECT round(score, 6) AS threshold, round({_safe('cum_neg', 'N')}, 6) AS fpr, "
       f"round({_safe('cum_pos', 'P')}, 6) AS tpr FROM cu", extra_ctes=f"{PRED},\n{CUM}")


@register("pr_points")
def q_pr(spark, sf_dir):
    return rounded(E.pr_points(E.score_cumulative(_pred(spark, sf_dir), "score")))


oracle("pr_points", f"SELECT round(score, 6) AS threshold, round({_safe('cum_pos', 'cum_pos + cum_neg')}, 6) AS precision, "
       f"round({_safe('cum_pos', 'P')}, 6) AS recall FROM cu", extra_ctes=f"{PRED},\n{CUM}")


@register("roc_auc")
def q_auc(spark, sf_dir):
    return rounded(E.curve_summary(E.score_cumulative(_pred(spark, sf_dir), "score")).select("roc_auc"))


oracle("roc_auc", f"SELECT round({_safe('sum(pos * (N - cum_neg + 0.5 * neg))', 'max(P) * max(N)')}, 6) AS roc_auc FROM cu",
       extra_ctes=f"{PRED},\n{CUM}")


@register("average_precision")
def q_ap(spark, sf_dir):
    return rounded(E.curve_summary(E.score_cumulative(_pred(spark, sf_dir), "score")).select("average_precision"))


_PREC = _safe("cum_pos", "cum_pos + cum_neg")
oracle("average_precision", f"SELECT round({_safe(f'sum(pos * {_PREC})', 'max(P)')}, 6) AS average_precision FROM cu",
       extra_ctes=f"{PRED},\n{CUM}")


@register("threshold_sweep")
def q_sweep(spark, sf_dir):
    return rounded(E.threshold_sweep(_pred(spark, sf_dir), THRESHOLDS, "score"))


def _sweep_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT {i} AS idx, {t}::DOUBLE AS threshold, count(*) FILTER (WHERE event = 0 AND adjusted_probability <= {t}) AS tn, "
        f"count(*) FILTER (WHERE event = 0 AND adjusted_probability > {t}) AS fp, "
        f"count(*) FILTER (WHERE event = 1 AND adjusted_probability <= {t}) AS fn, "
        f"count(*) FILTER (WHERE event = 1 AND adjusted_probability > {t}) AS tp FROM pred"
        for i, t in enumerate(THRESHOLDS))
    return rows


oracle("threshold_sweep", """
SELECT *, idx = first_value(idx) OVER (ORDER BY f1 DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best_f1,
       idx = first_value(idx) OVER (ORDER BY balanced_accuracy DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
         AS best_balanced
FROM (""" + metrics_sql("sw") + ")", extra_ctes=f"{PRED},\nsw AS ({_sweep_sql()})")


@register("score_histogram")
def q_score_hist(spark, sf_dir):
    return rounded(density_histogram(_pred(spark, sf_dir), "score", "event", 0.0, 1.0, 20))


oracle("score_histogram", """
SELECT event, bin, round(0.0 + bin * 0.05, 6) AS lower, n, round(n / (sum(n) OVER (PARTITION BY event) * 0.05), 6) AS density
FROM (SELECT event, least(greatest(floor((adjusted_probability - 0.0) / 0.05), 0), 19)::INTEGER AS bin, count(*) AS n
      FROM pred GROUP BY 1, 2)
""", extra_ctes=PRED)


@register("model_comparison")
def q_compare(spark, sf_dir):
    p = _pred(spark, sf_dir)
    adj = p.withColumn("predicted", (F.col("adjusted_probability") > 0.15).cast("int"))
    return rounded(E.model_comparison({"kaplan_meier": E.metrics_from_confusion(E.confusion(p)),
                                       "kaplan_meier_adjusted": E.metrics_from_confusion(E.confusion(adj))}))


oracle("model_comparison", """
SELECT model, tn, fp, fn, tp, accuracy, precision, recall, f1, specificity, balanced_accuracy,
       model = first_value(model) OVER (ORDER BY accuracy DESC, model ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best
FROM (SELECT 'kaplan_meier' AS model, * FROM (""" + metrics_sql("cm") + """)
      UNION ALL SELECT 'kaplan_meier_adjusted' AS model, * FROM (""" + metrics_sql("cm2") + "))",
       extra_ctes=f"""{PRED},
{CM},
cm2 AS (SELECT count(*) FILTER (WHERE event = 0 AND adjusted_probability <= 0.15) AS tn,
               count(*) FILTER (WHERE event = 0 AND adjusted_probability > 0.15) AS fp,
               count(*) FILTER (WHERE event = 1 AND adjusted_probability <= 0.15) AS fn,
               count(*) FILTER (WHERE event = 1 AND adjusted_probability > 0.15) AS tp FROM pred)""")


@register("prediction_summary")
def q_pred_summary(spark, sf_dir):
    return rounded(E.prediction_summary(_pred(spark, sf_dir)))


oracle("prediction_summary", """
SELECT round(min(churn_probability), 6) AS min, round(max(churn_probability), 6) AS max,
       round(avg(churn_probability), 6) AS mean, round(avg(predicted::DOUBLE), 6) AS share_predicted, count(*) AS n,
       round(quantile_cont(churn_probability, 0.5), 6) AS median FROM pred
""", extra_ctes=PRED)


@register("split_summary")
def q_split_summary(spark, sf_dir):
    return rounded(E.split_summary(stratified_split(survival_base(spark, sf_dir))))


oracle("split_summary", """
SELECT split, count(*) AS n, round(avg(event::DOUBLE), 6) AS event_rate, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM sp GROUP BY split
""", extra_ctes=PRED.split(",\ntr AS")[0])


PERCENTILES = [50, 60, 70, 75, 80, 90]


@register("threshold_sweep_percentiles")
def q_sweep_pct(spark, sf_dir):
    """E7 variant: thresholds at percentiles of the scores, best by F1."""
    p = _pred(spark, sf_dir)
    return rounded(E.threshold_sweep(p, E.percentile_thresholds(p, "score", PERCENTILES), "score"))


def _sweep_pct_sql() -> str:
    qs = [x / 100 for x in PERCENTILES]
    rows = " UNION ALL ".join(
        f"SELECT {i} AS idx, t AS threshold, count(*) FILTER (WHERE event = 0 AND adjusted_probability <= t) AS tn, "
        f"count(*) FILTER (WHERE event = 0 AND adjusted_probability > t) AS fp, "
        f"count(*) FILTER (WHERE event = 1 AND adjusted_probability <= t) AS fn, "
        f"count(*) FILTER (WHERE event = 1 AND adjusted_probability > t) AS tp "
        f"FROM pred, (SELECT quantile_cont(adjusted_probability, {q}) AS t FROM pred) GROUP BY t"
        for i, q in enumerate(qs))
    return rows


oracle("threshold_sweep_percentiles", """
SELECT idx, round(threshold, 6) AS threshold, tn, fp, fn, tp, accuracy, precision, recall, f1, specificity,
       balanced_accuracy,
       idx = first_value(idx) OVER (ORDER BY f1 DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best_f1,
       idx = first_value(idx) OVER (ORDER BY balanced_accuracy DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
         AS best_balanced
FROM (""" + metrics_sql("sw") + ")", extra_ctes=f"{PRED},\nsw AS ({_sweep_pct_sql()})")

"""Feature-preparation queries (X1-X12) and their oracle SQL.

Fitted state comes from the training split only and is applied to the test split.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlytics.operators import features as X
from churnlytics.operators import models as M
from churnlytics.operators.quantiles import quantiles_of_columns
from churnlytics.operators.rates import fold_rare
from churnlytics.plans.catalog import register
from churnlytics.plans.common import AS_OF, CAMPAIGN_KEYS, EV, SURV, contracts, rounded
from churnlytics.plans.oracle import oracle
from churnlytics.plans.q_survival import SPLIT_SQL, survival_base
from churnlytics.session import cut_lineage

NUMERIC = ["amount", "duration", "product_code"]


def _split(spark, sf_dir, region=False, due_dates=False):
    # train and test both come from the split: cut the lineage once
    sp = cut_lineage(X.stratified_split(survival_base(spark, sf_dir, region=region, due_dates=due_dates)))
    return sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")


SP = SPLIT_SQL + ",\ntr AS (SELECT * FROM sp WHERE split = 'train'),\nte AS (SELECT * FROM sp WHERE split = 'test')"


@register("standardize")
def q_standardize(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    stats = X.fit_standardizer(train, ["amount", "duration"])
    return rounded(X.standardize(test, stats, "_z").select("id", "amount_z", "duration_z"))


oracle("standardize", """
SELECT id, round(CASE WHEN sa > 0 THEN (amount - ma) / sa ELSE 0.0 END, 6) AS amount_z,
       round(CASE WHEN sd > 0 THEN (duration - md) / sd ELSE 0.0 END, 6) AS duration_z
FROM te, (SELECT avg(amount) AS ma, stddev_pop(amount) AS sa, avg(duration) AS md, stddev_pop(duration) AS sd FROM tr)
""", extra_ctes=SP)


@register("one_hot")
def q_one_hot(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    vocab = X.fit_vocabulary(train, "campaign")
    return X.one_hot(test, "campaign", vocab).select("id", *[f"campaign_{v}" for v in vocab])


oracle("one_hot", "SELECT id, " + ", ".join(
    f"(campaign = '{k}')::INTEGER AS \"campaign_{k}\"" for k in CAMPAIGN_KEYS) + " FROM te", extra_ctes=SP)


@register("variance_filter")
def q_variance(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    return rounded(X.variance_filter(train, NUMERIC, 0.01))


oracle("variance_filter", "SELECT feature, round(variance, 6) AS variance, variance > 0.01 AS kept FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, var_pop({c}::DOUBLE) AS variance FROM tr" for c in NUMERIC) + ")", extra_ctes=SP)


@register("class_weights")
def q_class_weights(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    return rounded(X.class_weights(train))


oracle("class_weights", """
SELECT event, count(*) AS n_class, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
FROM tr GROUP BY event
""", extra_ctes=SP)


@register("median_impute")
def q_median_impute(spark, sf_dir):
    train, test = _split(spark, sf_dir, due_dates=True)
    med = X.fit_medians(train, ["del_month"])
    filled = X.impute(test.withColumn("del_month", F.col("del_month").cast("double")), med)
    return rounded(filled.agg(F.lit(med["del_month"]).cast("double").alias("median"),
                              F.sum("del_month").alias("sum_after"), F.count(F.lit(1)).alias("n")))


oracle("median_impute", """
SELECT round((SELECT quantile_cont(del_month, 0.5) FROM tr), 6) AS median,
       round(sum(coalesce(del_month::DOUBLE, (SELECT quantile_cont(del_month, 0.5) FROM tr))), 6) AS sum_after,
       count(*) AS n
FROM te
""", extra_ctes=SP)


@register("rare_fold")
def q_rare_fold(spark, sf_dir):
    train, _ = _split(spark, sf_dir, region=True)
    return fold_rare(train, "region_code", 10).groupBy("region_code").agg(F.count(F.lit(1)).alias("n"))


oracle("rare_fold", """
SELECT CASE WHEN region_code IN (SELECT region_code FROM tr GROUP BY region_code ORDER BY count(*) DESC, region_code LIMIT 10)
            THEN region_code ELSE 'Other' END AS region_code, count(*) AS n
FROM tr GROUP BY 1
""", extra_ctes=SP)


CORR_FEATURES = ["amount", "term_days", "days_from_start", "start_month", "duration"]


@register("correlation_filter")
def q_corr_filter(spark, sf_dir):
    """Feature pairs with |r| > 0.95 on the training split (the later one is dropped)."""
    from churnlytics.operators.rates import correlation_matrix
    train, _ = _split(spark, sf_dir)
    feats = train.withColumns({
        "term_days": F.datediff("end_insurance", "start_insurance").cast("double"),
        "days_from_start": F.datediff(F.to_date(F.lit(AS_OF)), "start_insurance").cast("double"),
        "start_month": F.month("start_insurance").cast("double")})
    return rounded(X.correlated_pairs(correlation_matrix(feats, CORR_FEATURES), 0.95))


_CF_SQL = {"amount": "amount", "term_days": "(end_insurance - start_insurance)::DOUBLE",
           "days_from_start": f"(DATE '{AS_OF}' - start_insurance)::DOUBLE",
           "start_month": "month(start_insurance)::DOUBLE", "duration": "duration::DOUBLE"}
oracle("correlation_filter", "SELECT feature_a, feature_b, round(corr, 6) AS corr FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({_CF_SQL[a]}, {_CF_SQL[b]}) AS corr FROM tr"
    for i, a in enumerate(CORR_FEATURES) for b in CORR_FEATURES[i:]) + ") WHERE feature_a <> feature_b AND abs(corr) > 0.95",
    extra_ctes=SP)


MANY = ["amount", "duration", "product_code", "del_month"]


@register("quantiles_of_columns")
def q_quantiles_of_columns(spark, sf_dir):
    """Quartiles and deciles of several columns in one job chain."""
    df = survival_base(spark, sf_dir, due_dates=True)
    return rounded(quantiles_of_columns(df, MANY, [0.1, 0.25, 0.5, 0.75, 0.9]))


oracle("quantiles_of_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {q}::DOUBLE AS q, round(quantile_cont({c}::DOUBLE, {q}), 6) AS value FROM {{src}}"
    for c in MANY for q in (0.1, 0.25, 0.5, 0.75, 0.9)).replace("{src}", SURV))


@register("stratified_folds")
def q_stratified_folds(spark, sf_dir):
    """Five class-balanced folds of all contracts."""
    df = X.stratified_folds(survival_base(spark, sf_dir).select("id", "event"), 5)
    return df.groupBy("event", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


oracle("stratified_folds", f"""
SELECT event, fold, count(*) AS n, sum(id)::BIGINT AS id_sum
FROM (SELECT id, event, ((row_number() OVER (PARTITION BY event ORDER BY ('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT, id)
                          - 1) % 5)::INTEGER AS fold FROM {SURV})
GROUP BY event, fold
""")


@register("model_features")
def q_model_features(spark, sf_dir):
    """The numbers and filled categories of the classifier's and the
    survival set; every eighth due date is missing as a start or an end."""
    c = contracts(spark, sf_dir, due_dates=False, region=True).withColumns({
        "start_insurance": F.when(F.col("id") % 8 != 0, F.col("start_insurance")),
        "end_insurance": F.when(F.col("id") % 8 != 1, F.col("end_insurance")),
        "region_code": F.when(F.col("id") % 8 != 2, F.col("region_code"))})
    out = None
    for variant in ("classifier", "survival"):
        part = M.fill_categories(M.build_features(c, AS_OF, variant)).select(
            F.lit(variant).alias("variant"), "id", "event", "term_days", "days_from_start", "amount", "product_code",
            "region_code", "campaign")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


oracle("model_features", f"""
SELECT v AS variant, id, {EV} AS event,
  (CASE WHEN s IS NULL OR e IS NULL THEN if(v = 'survival', 365, 0)
        ELSE greatest(e - s, if(v = 'survival', 1, 0)) END)::DOUBLE AS term_days,
  (CASE WHEN s IS NULL THEN if(v = 'survival', 180, 0) ELSE greatest(DATE '{AS_OF}' - s, 0) END)::DOUBLE AS days_from_start,
  amount, product_code::VARCHAR AS product_code, CASE WHEN id % 8 = 2 THEN 'missing' ELSE coalesce(region_code, 'missing') END AS region_code,
  campaign
FROM (SELECT *, CASE WHEN id % 8 <> 0 THEN start_insurance END AS s, CASE WHEN id % 8 <> 1 THEN end_insurance END AS e
      FROM contracts), (VALUES ('classifier'), ('survival')) x(v)
""")

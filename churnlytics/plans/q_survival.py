"""Survival queries (K1-K11, X10) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlytics.operators import survival as KM
from churnlytics.operators.enrich import drop_leakage
from churnlytics.operators.features import stratified_split
from churnlytics.operators.quantiles import median
from churnlytics.plans.catalog import register
from churnlytics.session import cut_lineage
from churnlytics.plans.common import AS_OF, K7, SURV, contracts, rounded
from churnlytics.plans.oracle import oracle

STRATA = ["region_code", "product_code", "amount", "campaign"]
HORIZONS = [30, 90, 180, 365]
NEAREST = [250, 1000]



def survival_base(spark, sf_dir, region=False, due_dates=False):
    """K6 survival set; the line-item join (due dates) only when a caller needs it."""
    return KM.survival_frame(contracts(spark, sf_dir, due_dates=due_dates, region=region), AS_OF)


def km_sql(src: str, strata=(), min_size: int = 0, conf: bool = False, prefix: str = "k") -> tuple[str, str]:
    """CTEs computing a KM table from ``src`` (columns duration, event, strata);
    returns (ctes, final_cte_name)."""
    sc = ", ".join(strata)
    sc_ = sc + ", " if strata else ""
    part = f"PARTITION BY {sc}" if strata else ""
    ctes = f"""{prefix}_g AS (
  SELECT {sc_}duration::INTEGER AS t, sum(event)::BIGINT AS events, count(*)::BIGINT AS n_rows
  FROM {src} WHERE duration IS NOT NULL GROUP BY {sc_}duration::INTEGER
  UNION ALL SELECT DISTINCT {sc_}0, 0::BIGINT, 0::BIGINT FROM {src} WHERE duration IS NOT NULL),
{prefix}_g2 AS (SELECT {sc_}t, sum(events)::BIGINT AS events, sum(n_rows)::BIGINT AS n_rows FROM {prefix}_g GROUP BY {sc_}t),
{prefix}_r AS (SELECT *, sum(n_rows) OVER ({part} ORDER BY t DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS at_risk
  FROM {prefix}_g2),
{prefix}_f AS (SELECT * FROM (SELECT *, max(at_risk) OVER ({part}) AS mx FROM {prefix}_r) WHERE mx > {min_size}),
{prefix} AS (SELECT {sc_}t, at_risk, events,
  product(1.0 - events / at_risk) OVER ({part} ORDER BY t ROWS UNBOUNDED PRECEDING) AS survival,
  sum(CASE WHEN at_risk > events THEN events / (at_risk * (at_risk - events)) END)
      OVER ({part} ORDER BY t ROWS UNBOUNDED PRECEDING) AS v
  FROM {prefix}_f)"""
    return ctes, prefix


def _ci(side: str) -> str:
    op = "+" if side == "lower" else "-"
    return (f"round(CASE WHEN survival >= 1.0 THEN 1.0 WHEN survival <= 0.0 THEN 0.0 ELSE "
            f"exp(-exp(ln(-ln(survival)) {op} 1.959963984540054 * sqrt(v) / ln(survival))) END, 6)")


def strata_sql(src: str, fit_src: str) -> str:
    """Long (variable, stratum, duration, event) rows of ``src`` with strata fitted on ``fit_src``."""
    parts = []
    for c in STRATA:
        top = f"(SELECT {c} FROM {fit_src} GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 5)"
        parts.append(f"SELECT '{c}' AS variable, CASE WHEN {c} IN {top} THEN {c}::VARCHAR ELSE 'Other' END AS stratum, "
                     f"duration, event FROM {src}")
    return " UNION ALL ".join(parts)


# --- K1 / K2 -----------------------------------------------------------------------
@register("km_overall")
def q_km_overall(spark, sf_dir):
    return rounded(KM.km_curve(survival_base(spark, sf_dir)))


_c, _n = km_sql(SURV)
oracle("km_overall", f"SELECT t, at_risk, events, round(survival, 6) AS survival FROM {_n}", extra_ctes=_c)


@register("km_confidence")
def q_km_conf(spark, sf_dir):
    return rounded(KM.km_curve(survival_base(spark, sf_dir), confidence=True))


oracle("km_confidence", f"SELECT t, at_risk, events, round(survival, 6) AS survival, {_ci('lower')} AS ci_lower, "
       f"{_ci('upper')} AS ci_upper FROM {_n}", extra_ctes=_c)


# --- K5 ---------------------------------------------------------------------------------
@register("km_stratified")
def q_km_strat(spark, sf_dir):
    return rounded(KM.km_stratified(survival_base(spark, sf_dir, region=True), STRATA, min_size=30))


_c, _n = km_sql("st", ["variable", "stratum"], min_size=30)
oracle("km_stratified", f"SELECT variable, stratum, t, at_risk, events, round(survival, 6) AS survival FROM {_n}",
       extra_ctes=f"s AS {SURV},\nst AS ({strata_sql('s', 's')}),\n{_c}")


# --- K3 / K4 --------------------------------------------------------------------------
@register("km_at_horizons")
def q_km_h(spark, sf_dir):
    return rounded(KM.survival_at(KM.km_curve(survival_base(spark, sf_dir)), HORIZONS))


_c, _n = km_sql(SURV)
oracle("km_at_horizons", f"""
SELECT h AS horizon, round(arg_max(survival, t), 6) AS survival
FROM {_n}, (SELECT unnest({HORIZONS}) AS h) WHERE t <= h GROUP BY h
""", extra_ctes=_c)


@register("km_nearest")
def q_km_near(spark, sf_dir):
    return rounded(KM.survival_at(KM.km_curve(survival_base(spark, sf_dir)), NEAREST, nearest=True))


oracle("km_nearest", f"""
SELECT h AS horizon, arg_min(t, (abs(t - h), t)) AS t, round(arg_min(survival, (abs(t - h), t)), 6) AS survival
FROM {_n}, (SELECT unnest({NEAREST}) AS h) GROUP BY h
""", extra_ctes=_c)


# --- K7 / K8 / K9 ---------------------------------------------------------------------
@register("km_capped")
def q_km_capped(spark, sf_dir):
    s = KM.survival_frame(contracts(spark, sf_dir), rule="k7", censor_to_cap=True)
    return rounded(KM.km_curve(s))


_CAP = (f"(SELECT (deletion_type > 0)::INTEGER AS event, "
        f"CASE WHEN deletion_type > 0 THEN {K7} ELSE 1200 END AS duration FROM contracts)")
_c, _n = km_sql(_CAP)
oracle("km_capped", f"SELECT t, at_risk, events, round(survival, 6) AS survival FROM {_n}", extra_ctes=_c)


@register("km_check_times")
def q_km_check(spark, sf_dir):
    return KM.check_times(KM.survival_frame(contracts(spark, sf_dir), rule="k7"))


oracle("km_check_times", f"""
SELECT h AS time, count(*) FILTER (WHERE event = 1 AND duration <= h) AS events,
       count(*) FILTER (WHERE duration >= h) AS at_risk
FROM (SELECT (deletion_type > 0)::INTEGER AS event, {K7} AS duration FROM contracts),
     (SELECT unnest([90, 180, 365, 730]) AS h) GROUP BY h
""")


# --- X10 split --------------------------------------------------------------------------
@register("stratified_split")
def q_split(spark, sf_dir):
    sp = stratified_split(survival_base(spark, sf_dir))
    return sp.groupBy("split", "event").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


SPLIT_SQL = f"""sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY event ORDER BY h, id)
                          <= floor(0.8 * count(*) OVER (PARTITION BY event)) THEN 'train' ELSE 'test' END AS split
       FROM (SELECT *, ('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT AS h FROM {SURV}))"""
oracle("stratified_split", "SELECT split, event, count(*) AS n, sum(id)::BIGINT AS id_sum FROM sp GROUP BY split, event",
       extra_ctes=SPLIT_SQL)


# --- K10 / K11 ---------------------------------------------------------------------------
def km_predictions(spark, sf_dir):
    # the split feeds several fit jobs: cut the lineage once (reliable checkpoint)
    sp = cut_lineage(stratified_split(survival_base(spark, sf_dir, region=True)))
    train = sp.where(F.col("split") == "train")
    # Deletion-derived columns never reach the prediction step
    test = drop_leakage(sp.where(F.col("split") == "test"))
    return train, test, KM.km_predict(train, test, STRATA, horizon=1000, threshold=0.15)


@register("km_predict")
def q_km_predict(spark, sf_dir):
    _, _, p = km_predictions(spark, sf_dir)
    return rounded(p.select("id", "event", "duration", "churn_probability", "predicted"))


def predict_ctes() -> str:
    """CTEs ending in ``pred`` (test rows with churn_probability, predicted, adjusted_probability)."""
    oc, on = km_sql("tr", prefix="ko")
    sc, sn = km_sql("st", ["variable", "stratum"], min_size=30, prefix="ks")
    look = []
    for i, c in enumerate(STRATA):
        top = f"(SELECT {c} FROM tr GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 5)"
        look.append(f"LEFT JOIN at_t a{i} ON a{i}.variable = '{c}' AND "
                    f"a{i}.stratum = CASE WHEN te.{c} IN {top} THEN te.{c}::VARCHAR ELSE 'Other' END")
    coalesce = ", ".join(f"a{i}.survival" for i in reversed(range(len(STRATA))))
    return f"""{SPLIT_SQL},
tr AS (SELECT * FROM sp WHERE split = 'train'),
te AS (SELECT * FROM sp WHERE split = 'test'),
{oc},
st AS ({strata_sql('tr', 'tr')}),
{sc},
near AS (SELECT arg_min(t, (abs(t - 1000), t)) AS t_star, arg_min(survival, (abs(t - 1000), t)) AS s_overall FROM {on}),
at_t AS (SELECT variable, stratum, survival FROM {sn} WHERE t = (SELECT t_star FROM near)),
p0 AS (SELECT te.id, te.event, te.duration, te.amount,
              1.0 - coalesce({coalesce}, (SELECT s_overall FROM near)) AS churn_probability
       FROM te {' '.join(look)}),
med AS (SELECT quantile_cont(amount, 0.5) AS m FROM tr),
pred AS (SELECT id, event, duration, churn_probability, (churn_probability > 0.15)::INTEGER AS predicted,
                least(greatest(churn_probability
                     * CASE WHEN duration < 180 THEN 1.2 WHEN duration > 365 THEN 0.8 ELSE 1.0 END
                     * CASE WHEN amount > (SELECT m FROM med) THEN 0.9 ELSE 1.0 END, 0.01), 0.99) AS adjusted_probability
         FROM p0)"""


oracle("km_predict", "SELECT id, event, duration, round(churn_probability, 6) AS churn_probability, predicted FROM pred",
       extra_ctes=predict_ctes())


def adjusted_predictions(spark, sf_dir):
    """K10 scores with K11's rule adjustments (observation time, training
    median): a score of many values for the evaluation queries."""
    train, _, p = km_predictions(spark, sf_dir)
    m = median(train, "amount").first()["median"]
    return p.withColumn("adjusted_probability",
                        KM.adjust_prediction(F.col("churn_probability"), F.col("duration"), F.col("amount"), m))


@register("km_predict_adjusted")
def q_km_adjusted(spark, sf_dir):
    """K11 on the test split, tuned on the training split."""
    sp = cut_lineage(stratified_split(survival_base(spark, sf_dir)))
    test = sp.where(F.col("split") == "test").withColumn("term_days", F.datediff("end_insurance", "start_insurance"))
    train = sp.where(F.col("split") == "train").withColumn("term_days", F.datediff("end_insurance", "start_insurance"))
    p = KM.km_predict_adjusted(train, test)
    return rounded(p.select("id", "event", "adjusted_probability", "threshold", "adjusted_predicted"))


_TH = list(KM.ADJUSTED_THRESHOLDS)
_oc, _on = km_sql("tr", prefix="ko")
oracle("km_predict_adjusted", """
SELECT id, event, round(p, 6) AS adjusted_probability, threshold, (p > threshold)::INTEGER AS adjusted_predicted
FROM adj, (SELECT arg_max(threshold, (ba, -threshold)) AS threshold FROM sweep) WHERE split = 'test'
""", extra_ctes=f"""{SPLIT_SQL},
tr AS (SELECT * FROM sp WHERE split = 'train'),
{_oc},
base AS (SELECT 1.0 - arg_max(survival, t) AS p0 FROM {_on} WHERE t <= 180),
adj AS (SELECT id, event, split, least(greatest(p0
          * CASE WHEN end_insurance - start_insurance < 180 THEN 1.2 WHEN end_insurance - start_insurance > 365 THEN 0.8 ELSE 1.0 END
          * CASE WHEN amount > (SELECT quantile_cont(amount, 0.5) FROM tr) THEN 0.9 ELSE 1.0 END, 0.01), 0.99) AS p
        FROM sp, base),
sweep AS (SELECT threshold,
            (coalesce(count(*) FILTER (event = 1 AND p > threshold) / nullif(count(*) FILTER (event = 1), 0), 0)
             + coalesce(count(*) FILTER (event = 0 AND p <= threshold) / nullif(count(*) FILTER (event = 0), 0), 0)) / 2 AS ba
          FROM adj, (SELECT unnest({_TH})::DOUBLE AS threshold) WHERE split = 'train' GROUP BY threshold)""")


# --- K3 / K4 at each contract's own time ----------------------------------------------
@register("km_conditional")
def q_km_conditional(spark, sf_dir):
    """Every contract's chance to last another 180 days, from the curve of its campaign."""
    df = survival_base(spark, sf_dir)
    curve = cut_lineage(KM.km_curve(df, strata=["campaign"]))
    out = KM.conditional_survival(df, curve, 180, strata=["campaign"])
    return rounded(out.select("id", "campaign", "duration", "survival_now", "survival_then", "conditional_survival"))


_cc, _cn = km_sql(SURV, ["campaign"], prefix="kc")
oracle("km_conditional", f"""
SELECT s.id, s.campaign, s.duration, round(a.survival, 6) AS survival_now, round(b.survival, 6) AS survival_then,
       round(b.survival / nullif(a.survival, 0), 6) AS conditional_survival
FROM (SELECT *, duration + 180 AS later FROM {SURV}) s
ASOF LEFT JOIN {_cn} a ON s.campaign = a.campaign AND s.duration >= a.t
ASOF LEFT JOIN {_cn} b ON s.campaign = b.campaign AND s.later >= b.t
""", extra_ctes=_cc)

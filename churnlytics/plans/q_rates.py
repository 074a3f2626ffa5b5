"""Descriptive churn-rate queries (A5-A24, O2, K16) and their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from churnlytics.functions import columns as C
from churnlytics.operators import rates as R
from churnlytics.operators import sketches as SK
from churnlytics.operators.density import smoothed_density
from churnlytics.operators.quantiles import quantiles
from churnlytics.operators.survival import survival_frame
from churnlytics.plans.catalog import register
from churnlytics.plans.common import AS_OF, EV, K7, PARAMS, SURV, contracts, rounded
from churnlytics.plans.oracle import oracle
from churnlytics.session import checkpoint_dir, cut_lineage

STATUS = "CASE WHEN deletion_type = 0 THEN 'active' WHEN deletion_type IN (1, 2, 5) THEN 'withdrawal' ELSE 'other' END"


def _base(spark, sf_dir, due_dates=False, region=False):
    return survival_frame(contracts(spark, sf_dir, due_dates=due_dates, region=region), AS_OF)


def _k7(spark, sf_dir):
    return survival_frame(contracts(spark, sf_dir), rule="k7")


# --- A7 / A8 -----------------------------------------------------------------
@register("status_distribution")
def q_status(spark, sf_dir):
    c = contracts(spark, sf_dir, due_dates=False).withColumn("status", C.status_class("deletion_type"))
    return rounded(R.value_counts(c, "status"))


oracle("status_distribution", f"""
SELECT status, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM (SELECT {STATUS} AS status FROM contracts) GROUP BY status
""")


@register("deletion_type_distribution")
def q_deltype(spark, sf_dir):
    return rounded(R.value_counts(contracts(spark, sf_dir, due_dates=False), "deletion_type"))


oracle("deletion_type_distribution", """
SELECT deletion_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM contracts GROUP BY deletion_type
""")


@register("event_share")
def q_event_share(spark, sf_dir):
    return rounded(R.two_class_share(contracts(spark, sf_dir, due_dates=False)))


oracle("event_share", """
SELECT count(*) FILTER (WHERE deletion_type = 0) AS n_zero, count(*) FILTER (WHERE deletion_type > 0) AS n_positive,
       count(*) AS n,
       round(count(*) FILTER (WHERE deletion_type = 0) * 100.0 / count(*), 6) AS pct_zero,
       round(count(*) FILTER (WHERE deletion_type > 0) * 100.0 / count(*), 6) AS pct_positive
FROM contracts
""")


# --- A9 rates by key ------------------------------------------------------------
def _rate_sql(key: str, key_expr: str | None = None) -> str:
    ke = key_expr or key
    return f"""
SELECT {ke} AS {key}, count(*) AS contracts, sum({EV})::BIGINT AS cancelled,
       round_even(sum({EV}) * 100.0 / count(*), 2)::DOUBLE AS rate
FROM contracts GROUP BY {ke}
"""


for _key in ("call_center", "channel", "campaign", "amount"):
    def _mk(key):
        def q(spark, sf_dir):
            return rounded(R.rate_by(_base(spark, sf_dir), [key]))
        return q
    register(f"rate_by_{_key}")(_mk(_key))
    oracle(f"rate_by_{_key}", _rate_sql(_key))


@register("rate_all_levels")
def q_rate_levels(spark, sf_dir):
    return rounded(R.rate_all_levels(_base(spark, sf_dir), ["call_center", "channel", "campaign", "amount"]))


oracle("rate_all_levels", f"""
SELECT CASE WHEN grouping(call_center) = 0 THEN 'call_center' WHEN grouping(channel) = 0 THEN 'channel'
            WHEN grouping(campaign) = 0 THEN 'campaign' WHEN grouping(amount) = 0 THEN 'amount' ELSE 'all' END AS level,
       CASE WHEN grouping(call_center) = 0 THEN call_center WHEN grouping(channel) = 0 THEN channel
            WHEN grouping(campaign) = 0 THEN campaign WHEN grouping(amount) = 0 THEN amount::VARCHAR END AS key,
       count(*) AS contracts, sum({EV})::BIGINT AS cancelled,
       round_even(sum({EV}) * 100.0 / count(*), 2)::DOUBLE AS rate
FROM contracts GROUP BY GROUPING SETS ((call_center), (channel), (campaign), (amount), ())
""")


CHANNELS = ["ITM", "OTM", "S2S", "SCL"]


@register("rate_matrix")
def q_rate_matrix(spark, sf_dir):
    return rounded(R.rate_matrix(_base(spark, sf_dir), "call_center", "channel", CHANNELS))


oracle("rate_matrix", f"""
SELECT call_center, {', '.join(f'round(max(rate) FILTER (WHERE channel = {chr(39)}{c}{chr(39)}), 6) AS "{c}"' for c in CHANNELS)}
FROM (SELECT call_center, channel, avg({EV}) * 100.0 AS rate FROM contracts GROUP BY call_center, channel)
GROUP BY call_center
""")


@register("rate_unpivot")
def q_rate_unpivot(spark, sf_dir):
    r = R.rate_by(_base(spark, sf_dir), ["call_center"])
    return rounded(R.unpivot_measures(r, ["call_center"], ["contracts", "cancelled", "rate"]))


oracle("rate_unpivot", f"""
UNPIVOT (SELECT call_center, contracts::DOUBLE AS contracts, cancelled::DOUBLE AS cancelled, rate
         FROM ({_rate_sql('call_center')}))
ON contracts, cancelled, rate INTO NAME metric VALUE value
""")


@register("rate_trend")
def q_rate_trend(spark, sf_dir):
    return rounded(R.rate_trend(R.rate_by(_base(spark, sf_dir), ["amount"]), "amount"))


oracle("rate_trend", f"""
SELECT round(regr_slope(rate, amount), 6) AS slope, round(regr_intercept(rate, amount), 6) AS intercept,
       round(regr_r2(rate, amount), 6) AS r2
FROM ({_rate_sql('amount')})
""")


@register("channel_share")
def q_channel_share(spark, sf_dir):
    return rounded(R.share(contracts(spark, sf_dir, due_dates=False), "channel"))


oracle("channel_share", """
SELECT channel, count(*) AS contracts, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share
FROM contracts GROUP BY channel
""")


# --- A12 / A13 -------------------------------------------------------------------
@register("feature_rate")
def q_feature_rate(spark, sf_dir):
    return rounded(R.feature_rate(_base(spark, sf_dir), "amount"))


oracle("feature_rate", f"""
SELECT amount, round(avg({EV}), 6) AS event_rate, count(*) AS n FROM contracts GROUP BY amount
""")


@register("feature_rate_by_campaign")
def q_feature_rate_campaign(spark, sf_dir):
    return rounded(R.feature_rate_by_campaign(_base(spark, sf_dir, region=True), "region_code"))


oracle("feature_rate_by_campaign", f"""
SELECT campaign, region_code, event_rate, n FROM (
  SELECT campaign, region_code, round(avg({EV}), 6) AS event_rate, count(*) AS n,
         sum(count(*)) OVER (PARTITION BY campaign) AS cn
  FROM contracts GROUP BY campaign, region_code) WHERE cn >= 10 AND n >= 5
""")


# --- A14 - A18 -------------------------------------------------------------------
@register("duration_histogram")
def q_dur_hist(spark, sf_dir):
    s = _base(spark, sf_dir).where(F.col("event") == 1)
    return R.histogram_fixed(s, "duration")


oracle("duration_histogram", f"""
SELECT b.bin, b.lower, b.upper, coalesce(c.n, 0)::BIGINT AS n
FROM (SELECT * FROM (VALUES (0, 0.0, 30.0), (1, 30.0, 60.0), (2, 60.0, 90.0), (3, 90.0, 180.0),
                            (4, 180.0, 365.0), (5, 365.0, 1000.0), (6, 1000.0, 'inf'::DOUBLE)) v(bin, lower, upper)) b
LEFT JOIN (SELECT CASE WHEN duration < 30 THEN 0 WHEN duration < 60 THEN 1 WHEN duration < 90 THEN 2
                       WHEN duration < 180 THEN 3 WHEN duration < 365 THEN 4 WHEN duration < 1000 THEN 5 ELSE 6 END AS bin,
                  count(*) AS n FROM {SURV} WHERE event = 1 AND duration >= 0 GROUP BY 1) c ON c.bin = b.bin
""")


@register("duration_bins")
def q_dur_bins(spark, sf_dir):
    return R.duration_bins(_k7(spark, sf_dir), "duration")


oracle("duration_bins", f"""
SELECT b.bin, b.lower, b.upper, coalesce(c.n, 0)::BIGINT AS n
FROM (SELECT * FROM (VALUES (0, 0.0, 30.0), (1, 30.0, 90.0), (2, 90.0, 180.0), (3, 180.0, 365.0),
                            (4, 365.0, 730.0), (5, 730.0, 1200.0), (6, 1200.0, 'inf'::DOUBLE)) v(bin, lower, upper)) b
LEFT JOIN (SELECT CASE WHEN d <= 30 THEN 0 WHEN d <= 90 THEN 1 WHEN d <= 180 THEN 2 WHEN d <= 365 THEN 3
                       WHEN d <= 730 THEN 4 WHEN d <= 1200 THEN 5 ELSE 6 END AS bin, count(*) AS n
           FROM (SELECT {K7} AS d FROM contracts) WHERE d >= 0 GROUP BY 1) c ON c.bin = b.bin
""")


@register("duration_stats")
def q_dur_stats(spark, sf_dir):
    s = _k7(spark, sf_dir).withColumn("status", C.status_class("deletion_type"))
    return rounded(R.describe_by(s, "duration", "status"))


oracle("duration_stats", f"""
SELECT status, min(d)::DOUBLE AS min, max(d)::DOUBLE AS max, round(avg(d), 6) AS mean, count(d) AS n,
       round(quantile_cont(d, 0.5), 6) AS median
FROM (SELECT {STATUS} AS status, {K7} AS d FROM contracts) GROUP BY status
""")


AMOUNT_QS = [0.33, 0.5, 0.6, 0.66, 0.7, 0.75, 0.8, 0.9]


@register("amount_quantiles")
def q_amount_q(spark, sf_dir):
    return rounded(quantiles(contracts(spark, sf_dir, due_dates=False), "amount", AMOUNT_QS))


oracle("amount_quantiles", f"""
SELECT q, round(value, 6) AS value FROM (
  SELECT unnest({AMOUNT_QS}::DOUBLE[]) AS q, unnest(quantile_cont(amount, {AMOUNT_QS})) AS value FROM contracts)
""")


@register("duration_quantiles")
def q_dur_q(spark, sf_dir):
    return rounded(quantiles(_base(spark, sf_dir), "duration", [0.25, 0.5, 0.75], ["event"]))


oracle("duration_quantiles", f"""
SELECT event, q, round(value, 6) AS value FROM (
  SELECT event, unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS q, unnest(quantile_cont(duration, [0.25, 0.5, 0.75])) AS value
  FROM {SURV} GROUP BY event)
""")


SKETCH_WINDOWS = {"1995": (199501, 199512), "1996-97": (199601, 199712), "all": (0, 999912)}


@register("sketch_windows")
def q_sketch_windows(spark, sf_dir):
    """Quartiles of the observation time by campaign for three windows of
    months, from stored sketches of month and campaign; ``within`` holds where
    the true rank is within twice the sketches' stated error."""
    df = _base(spark, sf_dir)
    path = f"{checkpoint_dir(spark).rstrip('/')}/sketches-{uuid.uuid4().hex}"
    SK.store_sketches(SK.sketches(df, "duration", ["acq_month", "campaign"]), path, "whole")
    answers = SK.window_quantiles(SK.stored_sketches(spark, path), "acq_month", SKETCH_WINDOWS, [0.25, 0.5, 0.75], ["campaign"])
    answers = cut_lineage(answers)  # the sketches draw at random: one answer, then its check
    errors = SK.rank_errors(SK.in_windows(df, "acq_month", SKETCH_WINDOWS), answers, "duration", ["window", "campaign"])
    return answers.drop("value").join(errors.select("window", "campaign", "q", (F.col("rank_error") <= 2 * SK.rank_error())
                                                    .alias("within")), ["window", "campaign", "q"])


oracle("sketch_windows", "SELECT w.name AS \"window\", campaign, unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS q, count(*)::BIGINT AS n, TRUE AS within "
       f"FROM {SURV} JOIN (VALUES " + ", ".join(f"('{k}', {a}, {z})" for k, (a, z) in SKETCH_WINDOWS.items())
       + ") w(name, a, z) ON acq_month BETWEEN w.a AND w.z GROUP BY w.name, campaign")


@register("amount_classes")
def q_amount_classes(spark, sf_dir):
    c = R.tertile_classes(contracts(spark, sf_dir, due_dates=False), "amount")
    return c.groupBy("amount_class").agg(F.count(F.lit(1)).alias("n"))


oracle("amount_classes", """
SELECT CASE WHEN amount > 0 AND amount <= q33 THEN 'low' WHEN amount > q33 AND amount <= q66 THEN 'mid'
            WHEN amount > q66 THEN 'high' END AS amount_class, count(*) AS n
FROM contracts, (SELECT quantile_cont(amount, 0.33) AS q33, quantile_cont(amount, 0.66) AS q66 FROM contracts)
GROUP BY 1
""")


# --- A21 correlations -----------------------------------------------------------
FEATURES = ["amount", "duration", "product_code"]


@register("feature_correlation")
def q_corr(spark, sf_dir):
    return rounded(R.correlation_with(_base(spark, sf_dir), "event", FEATURES))


oracle("feature_correlation", "SELECT feature, round(corr, 6) AS corr FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, corr({f}::DOUBLE, event::DOUBLE) AS corr FROM {SURV}" for f in FEATURES) + ")")


@register("correlation_matrix")
def q_corr_matrix(spark, sf_dir):
    return rounded(R.correlation_matrix(_base(spark, sf_dir), FEATURES + ["event"]))


_CF = FEATURES + ["event"]
oracle("correlation_matrix", "SELECT feature_a, feature_b, round(corr, 6) AS corr FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}::DOUBLE, {b}::DOUBLE) AS corr FROM {SURV}"
    for i, a in enumerate(_CF) for b in _CF[i:]) + ")")


# --- O2 / K16 / A24 / A5 / A16 ------------------------------------------------------
@register("top_categories")
def q_top(spark, sf_dir):
    return R.top_n(contracts(spark, sf_dir, due_dates=False, region=True), "region_code", 10)


oracle("top_categories", """
SELECT region_code, count(*) AS n FROM contracts GROUP BY region_code ORDER BY n DESC, region_code LIMIT 10
""")


@register("early_cancellation")
def q_early(spark, sf_dir):
    return rounded(R.early_cancellation(_base(spark, sf_dir), "duration"))


oracle("early_cancellation", f"""
SELECT count(*) FILTER (WHERE event = 1 AND duration <= 30) AS early, count(*) FILTER (WHERE event = 1) AS cancelled,
       count(*) AS total,
       round(count(*) FILTER (WHERE event = 1 AND duration <= 30) * 100.0 / count(*), 6) AS pct_of_total,
       round(coalesce(count(*) FILTER (WHERE event = 1 AND duration <= 30) * 100.0
                      / nullif(count(*) FILTER (WHERE event = 1), 0), 0), 6) AS pct_of_cancelled
FROM {SURV}
""")


MISSING_COLS = ["first_due_date", "last_due_date", "deletion_allowed_at", "del_month", "region_code"]


@register("missing_values")
def q_missing(spark, sf_dir):
    return R.missing_counts(contracts(spark, sf_dir, region=True), MISSING_COLS)


oracle("missing_values", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM contracts"
    for c in MISSING_COLS))


@register("tariff_count")
def q_tariff_count(spark, sf_dir):
    c = contracts(spark, sf_dir, due_dates=False).where(F.col("campaign") == PARAMS.split_campaign)
    return rounded(R.grouped_tariff_count(c, "acq_month", "amount", PARAMS.ufc_tariff))


oracle("tariff_count", "SELECT acq_month, amount, count(*) AS n, round(count(*) * (CASE round(amount, 2) " + " ".join(
    f"WHEN {k} THEN {v}" for k, v in sorted(PARAMS.ufc_tariff.items())) +
    " END)::DOUBLE, 6) AS value FROM contracts WHERE campaign = 'FO-SCL' GROUP BY acq_month, amount")


@register("feature_density")
def q_density(spark, sf_dir):
    return rounded(R.density_histogram(_base(spark, sf_dir), "duration", "event", n_bins=20))


oracle("feature_density", f"""
SELECT event, bin, round(lo + bin * width, 6) AS lower, n, round(n / (sum(n) OVER (PARTITION BY event) * width), 6) AS density
FROM (SELECT event, lo, width, least(floor((duration - lo) / width), 19)::INTEGER AS bin, count(*) AS n
      FROM {SURV}, (SELECT min(duration)::DOUBLE AS lo, (max(duration) - min(duration)) / 20.0 AS width FROM {SURV})
      WHERE duration IS NOT NULL GROUP BY ALL)
""")


@register("duration_density")
def q_duration_density(spark, sf_dir):
    """Smoothed density of the duration by class, bandwidth of 90 days, on 31 grid points."""
    return rounded(smoothed_density(_base(spark, sf_dir), "duration", ["event"], grid=31, bandwidth=90.0, low=0.0, high=3000.0), 9)


oracle("duration_density", f"""
SELECT event, i * 100.0::DOUBLE AS x,
       round(sum(w * exp(-power((i - j) * 100.0 / 90.0, 2) / 2) / (90.0 * n * sqrt(2 * pi())))::DOUBLE, 9) AS density
FROM (SELECT event, j, sum(w) AS w
      FROM (SELECT event, least(floor(v), 29)::INTEGER + s AS j,
                   CASE s WHEN 1 THEN v - least(floor(v), 29) ELSE 1 - (v - least(floor(v), 29)) END AS w
            FROM (SELECT event, least(greatest(duration::DOUBLE / 100, 0), 30) AS v FROM {SURV} WHERE duration IS NOT NULL),
                 (SELECT unnest([0, 1]) AS s)) GROUP BY event, j)
JOIN (SELECT event, count(duration) AS n FROM {SURV} GROUP BY event) USING (event), (SELECT unnest(range(31)) AS i)
GROUP BY event, i
""")

"""Cohort matrices: enrichment, A1-A4, A20, O5, O7."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlytics.operators import cohort as K
from churnlytics.operators.enrich import enrich_contracts
from churnlytics.plans.catalog import register
from churnlytics.plans.common import CAMPAIGN_KEYS, SPLIT_KEYS, contracts, rounded
from churnlytics.plans.oracle import SPLIT_KEY_SQL, oracle, pivot_cols
from churnlytics.schema import TERMINATION_TYPES, WITHDRAWAL_TYPES
from churnlytics.sources.testdata import raw_contracts_from_testdata


# --- P1 enrichment ----------------------------------------------------------
@register("enrich_contracts")
def q_enrich(spark, sf_dir):
    return enrich_contracts(raw_contracts_from_testdata(spark, sf_dir))


oracle("enrich_contracts", """
SELECT contract_no, substr(contract_no, 7, 2) AS call_center, campaign_no,
       substr(contract_no, 7, 2) || '-' || campaign_no AS campaign,
       start_insurance, (start_insurance - 1) AS report_date,
       (year(start_insurance - 1) * 100 + month(start_insurance - 1))::INTEGER AS acq_month,
       deletion_allowed_at,
       (year(deletion_allowed_at + INTERVAL 1 MONTH) * 100 + month(deletion_allowed_at + INTERVAL 1 MONTH))::INTEGER AS del_month
FROM (SELECT 'VTRG00' || call_center || id::VARCHAR || '-' || customer_id::VARCHAR AS contract_no,
             channel AS campaign_no, start_insurance, deletion_allowed_at FROM contracts)
""")


# --- A1 cohort count matrix -------------------------------------------------
@register("cohort_matrix")
def q_cohort_matrix(spark, sf_dir):
    return K.cohort_matrix(contracts(spark, sf_dir, due_dates=False), "acq_month", "campaign",
                           keys=CAMPAIGN_KEYS)


oracle("cohort_matrix", f"""
SELECT acq_month,
  {pivot_cols(CAMPAIGN_KEYS, lambda k: f"count(*) FILTER (WHERE campaign = '{k}')")}
FROM contracts WHERE acq_month IS NOT NULL GROUP BY acq_month
""")


# --- A2 split by amount -----------------------------------------------------
@register("cohort_matrix_split")
def q_cohort_split(spark, sf_dir):
    return K.cohort_matrix_split(contracts(spark, sf_dir, due_dates=False), "acq_month", keys=SPLIT_KEYS)


def _split_matrix_sql(month_col, types=None):
    cond = "" if types is None else f" AND deletion_type IN ({', '.join(map(str, types))})"
    return f"""
SELECT {month_col},
  {pivot_cols(SPLIT_KEYS, lambda k: f"count(*) FILTER (WHERE column_key = '{k}'{cond})")}
FROM (SELECT *, {SPLIT_KEY_SQL} AS column_key FROM contracts)
WHERE {month_col} IS NOT NULL GROUP BY {month_col}
"""


oracle("cohort_matrix_split", _split_matrix_sql("acq_month"))


# --- A3 subsets by deletion type ---------------------------------------------
@register("withdrawals_by_acq_month")
def q_wd_acq(spark, sf_dir):
    return K.cohort_matrix_split(contracts(spark, sf_dir), "acq_month", keys=SPLIT_KEYS,
                                 deletion_types=WITHDRAWAL_TYPES)


oracle("withdrawals_by_acq_month", _split_matrix_sql("acq_month", WITHDRAWAL_TYPES))


@register("withdrawals_by_del_month")
def q_wd_del(spark, sf_dir):
    return K.cohort_matrix_split(contracts(spark, sf_dir), "del_month", keys=SPLIT_KEYS,
                                 deletion_types=WITHDRAWAL_TYPES)


oracle("withdrawals_by_del_month", _split_matrix_sql("del_month", WITHDRAWAL_TYPES))


@register("terminations_by_del_month")
def q_term_del(spark, sf_dir):
    return K.cohort_matrix_split(contracts(spark, sf_dir), "del_month", keys=SPLIT_KEYS,
                                 deletion_types=TERMINATION_TYPES)


oracle("terminations_by_del_month", _split_matrix_sql("del_month", TERMINATION_TYPES))


# --- A4 withdrawal quota ----------------------------------------------------
@register("withdrawal_quota")
def q_quota(spark, sf_dir):
    return rounded(K.withdrawal_quota(contracts(spark, sf_dir, due_dates=False), "acq_month", keys=SPLIT_KEYS))


oracle("withdrawal_quota", f"""
SELECT acq_month,
  {pivot_cols(SPLIT_KEYS, lambda k: (
      f"round(coalesce(100.0 * count(*) FILTER (WHERE column_key = '{k}' AND deletion_type IN (1, 2, 5))"
      f" / nullif(count(*) FILTER (WHERE column_key = '{k}'), 0), 0)::DOUBLE, 6)"))}
FROM (SELECT *, {SPLIT_KEY_SQL} AS column_key FROM contracts)
WHERE acq_month IS NOT NULL GROUP BY acq_month
""")


# --- O7 month gap fill --------------------------------------------------------
@register("month_gap_fill")
def q_gap_fill(spark, sf_dir):
    c = contracts(spark, sf_dir)
    per_month = (c.where(F.col("deletion_type").isin(list(WITHDRAWAL_TYPES)) & F.col("del_month").isNotNull())
                 .groupBy("del_month").agg(F.count(F.lit(1)).alias("n")))
    return K.gap_fill_months(per_month, "del_month", 0)


oracle("month_gap_fill", """
SELECT m.del_month, coalesce(w.n, 0)::BIGINT AS n
FROM (SELECT (year(d) * 100 + month(d))::INTEGER AS del_month
      FROM (SELECT unnest(generate_series(make_date(lo // 100, lo % 100, 1)::TIMESTAMP,
                                          make_date(hi // 100, hi % 100, 1)::TIMESTAMP,
                                          INTERVAL 1 MONTH)) AS d
            FROM (SELECT min(del_month) AS lo, max(del_month) AS hi FROM w))) m
LEFT JOIN w ON w.del_month = m.del_month
""", extra_ctes="""w AS (SELECT del_month, count(*) AS n FROM contracts
       WHERE deletion_type IN (1, 2, 5) AND del_month IS NOT NULL GROUP BY del_month)""")


# --- O5 month union / A20 distinct -------------------------------------------
@register("month_union")
def q_month_union(spark, sf_dir):
    return K.months_of(contracts(spark, sf_dir), ["acq_month", "del_month"], out="month")


oracle("month_union", """
SELECT DISTINCT month FROM (SELECT acq_month AS month FROM contracts UNION ALL
                            SELECT del_month FROM contracts) WHERE month IS NOT NULL
""")


@register("distinct_campaigns")
def q_distinct(spark, sf_dir):
    return contracts(spark, sf_dir, due_dates=False).select("campaign").distinct()


oracle("distinct_campaigns", "SELECT DISTINCT campaign FROM contracts")

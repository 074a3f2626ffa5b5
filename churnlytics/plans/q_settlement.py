"""Settlement queries (B1-B12) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlytics.operators import commission as PC
from churnlytics.operators import settlement as S
from churnlytics.plans.catalog import register
from churnlytics.plans.common import CAMPAIGN_KEYS, PARAMS, SPLIT_KEYS, contracts, rounded
from churnlytics.plans import q_cohort  # noqa: F401  (its SQL of the quota is used below)
from churnlytics.plans.oracle import ORACLE, SPLIT_KEY_SQL, oracle, pivot_cols
from churnlytics.schema import PRODUCT_MAIN

THR = PARAMS.threshold
UFC_KEYS = S.ufc_keys(PARAMS)
UFC_AMOUNTS = sorted(PARAMS.ufc_tariff)
FEE_SQL = lambda m: f"(CASE WHEN {m} > {THR} THEN 59.9 ELSE 49.9 END)"
TARIFF_SQL = ("(CASE round(amount, 2) " + " ".join(
    f"WHEN {k} THEN {v}" for k, v in sorted(PARAMS.ufc_tariff.items())) + " END)::DOUBLE")
SPAN_SQL = ("(CASE WHEN first_due_date IS NULL OR last_due_date IS NULL OR first_due_date > last_due_date THEN 0 "
            "ELSE (year(last_due_date) - year(first_due_date)) * 12 + (month(last_due_date) - month(first_due_date)) "
            "- (CASE WHEN day(last_due_date) < day(first_due_date) THEN 1 ELSE 0 END) + 1 END)")
KEYED = f"(SELECT *, {SPLIT_KEY_SQL} AS column_key, {TARIFF_SQL} AS t FROM contracts)"


def _r(expr: str) -> str:
    return f"round(({expr})::DOUBLE, 6)"


# --- B1 / B2 -------------------------------------------------------------------
@register("cpo_new")
def q_cpo_new(spark, sf_dir):
    return rounded(S.cpo_new(contracts(spark, sf_dir, due_dates=False), PARAMS, SPLIT_KEYS))


oracle("cpo_new", f"""
SELECT acq_month,
  {pivot_cols(SPLIT_KEYS, lambda k: _r(f"count(*) FILTER (WHERE column_key = '{k}') * {FEE_SQL('acq_month')}"))}
FROM {KEYED} WHERE acq_month IS NOT NULL GROUP BY acq_month
""")


@register("cpo_new_by_product")
def q_cpo_new_prod(spark, sf_dir):
    return rounded(S.cpo_new(contracts(spark, sf_dir, due_dates=False), PARAMS, SPLIT_KEYS, by_product=True))


oracle("cpo_new_by_product", f"""
SELECT product_code, acq_month,
  {pivot_cols(SPLIT_KEYS, lambda k: _r(f"count(*) FILTER (WHERE column_key = '{k}') * {FEE_SQL('acq_month')}"))}
FROM {KEYED} WHERE acq_month IS NOT NULL GROUP BY product_code, acq_month
""")


# --- B3 ------------------------------------------------------------------------------
@register("cpo_withdrawal")
def q_cpo_wd(spark, sf_dir):
    return rounded(S.cpo_withdrawal(contracts(spark, sf_dir), PARAMS, SPLIT_KEYS, product=PRODUCT_MAIN))


_FO = [k for k in SPLIT_KEYS if k.startswith("FO-")]
_JD = [k for k in SPLIT_KEYS if k.startswith("JD-")]
oracle("cpo_withdrawal", f"""
SELECT m.del_month,
  {pivot_cols(SPLIT_KEYS, lambda k: f'round(coalesce(w."{k}", 0), 6)')},
  round(coalesce({' + '.join(f'w."{k}"' for k in _FO)}, 0), 6) AS "FO",
  round(coalesce({' + '.join(f'w."{k}"' for k in _JD)}, 0), 6) AS "JD"
FROM (SELECT (year(d) * 100 + month(d))::INTEGER AS del_month
      FROM (SELECT unnest(generate_series(make_date(lo // 100, lo % 100, 1)::TIMESTAMP,
                                          make_date(hi // 100, hi % 100, 1)::TIMESTAMP, INTERVAL 1 MONTH)) AS d
            FROM (SELECT min(del_month) AS lo, max(del_month) AS hi FROM w))) m
LEFT JOIN w ON w.del_month = m.del_month
""", extra_ctes=f"""w AS (SELECT del_month,
  {pivot_cols(SPLIT_KEYS, lambda k: f"(count(*) FILTER (WHERE column_key = '{k}') * {FEE_SQL('del_month')})::DOUBLE")}
  FROM {KEYED} WHERE product_code = 3402 AND deletion_type IN (1, 2, 5) AND del_month IS NOT NULL
  GROUP BY del_month)""")


# --- B4 - B6 -------------------------------------------------------------------------
def _ufc_cols(value_expr: str) -> str:
    return ",\n  ".join(
        f'{_r(f"coalesce(sum({value_expr}) FILTER (WHERE round(amount, 2) = {a}), 0)")} AS "{k}"'
        for k, a in zip(UFC_KEYS, UFC_AMOUNTS))


@register("ufc_new")
def q_ufc_new(spark, sf_dir):
    return rounded(S.ufc_new(contracts(spark, sf_dir, due_dates=False), PARAMS))


oracle("ufc_new", f"""
SELECT acq_month, {_ufc_cols('t')}
FROM {KEYED} WHERE campaign = 'FO-SCL' AND acq_month > {THR} AND t IS NOT NULL GROUP BY acq_month
""")


def _ufc_wd_sql(rule: str) -> str:
    cond = {"none": "", "same_month": " AND acq_month = del_month", "after_threshold": f" AND acq_month > {THR}"}[rule]
    val = "t" if rule == "none" else f"CASE WHEN del_month > {THR} THEN t ELSE 0.0 END"
    return f"""
SELECT del_month, {_ufc_cols(val)}
FROM {KEYED} WHERE campaign = 'FO-SCL' AND deletion_type IN (1, 2, 5) AND del_month IS NOT NULL
  AND t IS NOT NULL{cond} GROUP BY del_month
"""


for _name, _rule in (("ufc_withdrawal_all", "none"), ("ufc_withdrawal_same_month", "same_month"),
                     ("ufc_withdrawal_after", "after_threshold")):
    def _mk(rule):
        def q(spark, sf_dir):
            return rounded(S.ufc_withdrawal(contracts(spark, sf_dir), PARAMS, rule))
        return q
    register(_name)(_mk(_rule))
    oracle(_name, _ufc_wd_sql(_rule))


@register("ufc_clawback")
def q_ufc_claw(spark, sf_dir):
    return rounded(S.ufc_clawback(contracts(spark, sf_dir), PARAMS))


oracle("ufc_clawback", f"""
SELECT del_month, {_ufc_cols(f'(1.0 - {SPAN_SQL} / 24.0) * t')}
FROM {KEYED} WHERE campaign = 'FO-SCL' AND deletion_type IN (3, 4, 6, 7) AND acq_month > {THR}
  AND del_month IS NOT NULL AND {SPAN_SQL} < 24 AND t IS NOT NULL GROUP BY del_month
""")


# --- B7 ------------------------------------------------------------------------------
@register("settlement_result")
def q_settlement_result(spark, sf_dir):
    return rounded(S.settlement_result(contracts(spark, sf_dir), PARAMS))


_SFX = "(CASE WHEN product_code = 3783 THEN '_3783' ELSE '' END)"
_CC = "lower(split_part(campaign, '-', 1))"
_GEN = """SELECT (year(d) * 100 + month(d))::INTEGER AS month
      FROM (SELECT unnest(generate_series(make_date(lo // 100, lo % 100, 1)::TIMESTAMP,
                                          make_date(hi // 100, hi % 100, 1)::TIMESTAMP, INTERVAL 1 MONTH)) AS d
            FROM (SELECT min(month) AS lo, max(month) AS hi FROM m WHERE suffix(measure, '{s}')) WHERE lo IS NOT NULL)"""
oracle("settlement_result", f"""
SELECT mo.month,
  {pivot_cols(S.RESULT_MEASURES, lambda k: _r(f"coalesce(sum(m.value) FILTER (WHERE m.measure = '{k}'), 0)"))}
FROM (SELECT month FROM m UNION SELECT month FROM g1 UNION SELECT month FROM g2) mo
LEFT JOIN m ON m.month = mo.month
GROUP BY mo.month
""", extra_ctes=f"""k AS {KEYED},
m AS (
  SELECT acq_month AS month, {_CC} || '_new_cpo' || {_SFX} AS measure, {FEE_SQL('acq_month')}::DOUBLE AS value
    FROM k WHERE product_code IN (3402, 3783) AND acq_month IS NOT NULL
  UNION ALL
  SELECT del_month, {_CC} || '_withdrawal_cpo' || {_SFX}, (-1.0 * {FEE_SQL('del_month')})::DOUBLE
    FROM k WHERE product_code IN (3402, 3783) AND deletion_type IN (1, 2, 5) AND del_month IS NOT NULL
  UNION ALL
  SELECT acq_month, 'fo_new_ufc', t FROM k WHERE campaign = 'FO-SCL' AND acq_month > {THR} AND t IS NOT NULL
  UNION ALL
  SELECT del_month, 'fo_withdrawal_ufc', -t FROM k
    WHERE campaign = 'FO-SCL' AND deletion_type IN (1, 2, 5) AND del_month IS NOT NULL AND t IS NOT NULL
  UNION ALL
  SELECT del_month, 'fo_clawback_ufc', -((1.0 - {SPAN_SQL} / 24.0) * t) FROM k
    WHERE campaign = 'FO-SCL' AND deletion_type IN (3, 4, 6, 7) AND acq_month > {THR}
      AND del_month IS NOT NULL AND {SPAN_SQL} < 24 AND t IS NOT NULL
  UNION ALL
  SELECT del_month, '_month', 0.0 FROM k WHERE del_month IS NOT NULL
),
g1 AS ({_GEN.format(s='_withdrawal_cpo')}),
g2 AS ({_GEN.format(s='_withdrawal_cpo_3783')})""")


# --- B9 - B12 ------------------------------------------------------------------------
PV = "(27.9 + 0.53 * (3.0 * amount))"
MD = "((del_month // 100 - acq_month // 100) * 12 + (del_month % 100 - acq_month % 100))"


@register("premium_commission_new")
def q_pc_new(spark, sf_dir):
    return rounded(PC.premium_commission_new(contracts(spark, sf_dir, due_dates=False), CAMPAIGN_KEYS))


oracle("premium_commission_new", f"""
SELECT acq_month,
  {pivot_cols(CAMPAIGN_KEYS, lambda k: _r(f"coalesce(sum({PV}) FILTER (WHERE campaign = '{k}'), 0)"))}
FROM contracts WHERE acq_month IS NOT NULL GROUP BY acq_month
""")


@register("premium_commission_withdrawal")
def q_pc_wd(spark, sf_dir):
    return rounded(PC.premium_commission_withdrawal(contracts(spark, sf_dir), CAMPAIGN_KEYS))


oracle("premium_commission_withdrawal", f"""
SELECT del_month,
  {pivot_cols(CAMPAIGN_KEYS, lambda k: _r(f"coalesce(-sum({PV}) FILTER (WHERE campaign = '{k}'), 0)"))}
FROM contracts WHERE deletion_type IN (1, 2, 5) AND del_month IS NOT NULL GROUP BY del_month
""")


_CLAW = f"CASE WHEN {MD} BETWEEN 1 AND 36 THEN -({PV} * (36.0 - {MD}) / 36.0) ELSE 0.0 END"


@register("premium_clawback")
def q_pc_claw(spark, sf_dir):
    return rounded(PC.premium_clawback(contracts(spark, sf_dir), CAMPAIGN_KEYS))


oracle("premium_clawback", f"""
SELECT del_month,
  {pivot_cols(CAMPAIGN_KEYS, lambda k: _r(f"coalesce(sum({_CLAW}) FILTER (WHERE campaign = '{k}'), 0)"))}
FROM contracts WHERE deletion_type IN (3, 4, 6) AND del_month IS NOT NULL GROUP BY del_month
""")


CALL_CENTERS = ["FO", "JD", "M3", "TS"]
_CC_KEYS = [f"{c}_{k}" for c in CALL_CENTERS for k in ("new", "withdrawal", "clawback")]


@register("call_center_result")
def q_cc_result(spark, sf_dir):
    return rounded(PC.call_center_result(contracts(spark, sf_dir), CALL_CENTERS, others="raise"))


oracle("call_center_result", f"""
SELECT month,
  {pivot_cols(_CC_KEYS, lambda k: _r(f"coalesce(sum(value) FILTER (WHERE k = '{k}'), 0)"))}
FROM (
  SELECT acq_month AS month, substr(campaign, 1, 2) || '_new' AS k, {PV} AS value
    FROM contracts WHERE length(campaign) >= 2 AND acq_month IS NOT NULL
  UNION ALL
  SELECT del_month, substr(campaign, 1, 2) || '_withdrawal', -{PV}
    FROM contracts WHERE length(campaign) >= 2 AND deletion_type IN (1, 2, 5) AND del_month IS NOT NULL
  UNION ALL
  SELECT del_month, substr(campaign, 1, 2) || '_clawback', {_CLAW}
    FROM contracts WHERE length(campaign) >= 2 AND deletion_type IN (3, 4, 6) AND del_month IS NOT NULL
) GROUP BY month
""")


# --- B8 ------------------------------------------------------------------------------
@register("short_result")
def q_short_result(spark, sf_dir):
    return rounded(S.short_result(contracts(spark, sf_dir), PARAMS))


_SHORT_KEYS = [f"{c}_{k}_cpo" for c in ("jd", "ts", "m3") for k in ("new", "withdrawal")]
_SHORT_SQL = f"""
SELECT CASE WHEN length(month::VARCHAR) = 6 THEN substr(month::VARCHAR, 1, 4) || '-' || substr(month::VARCHAR, 5, 2)
            ELSE 'unknown' END AS month,
  {pivot_cols(_SHORT_KEYS, lambda k: _r(f"coalesce(sum(value) FILTER (WHERE measure = '{k}'), 0)"))}
FROM (
  SELECT acq_month AS month, {_CC} || '_new_cpo' AS measure, {FEE_SQL('acq_month')}::DOUBLE AS value
    FROM contracts WHERE acq_month IS NOT NULL
  UNION ALL
  SELECT del_month, {_CC} || '_withdrawal_cpo', {FEE_SQL('del_month')}::DOUBLE
    FROM contracts WHERE deletion_type IN (1, 2, 5) AND del_month IS NOT NULL
) GROUP BY month
"""
oracle("short_result", _SHORT_SQL)


@register("short_result_report")
def q_short_result_report(spark, sf_dir):
    """B8 with the report's column letters."""
    return rounded(S.short_result(contracts(spark, sf_dir), PARAMS, report_names=True))


oracle("short_result_report", "SELECT month, " + ", ".join(
    f'{name} AS "{letter}"' for letter, name in S.SHORT_RESULT_COLUMNS.items()) + f" FROM ({_SHORT_SQL})")


@register("ufc_new_zero_early")
def q_ufc_new_zero(spark, sf_dir):
    """B4, older variant: months up to the threshold kept with value 0."""
    return rounded(S.ufc_new(contracts(spark, sf_dir, due_dates=False), PARAMS, early_months="zero"))


oracle("ufc_new_zero_early", f"""
SELECT acq_month, {_ufc_cols(f'CASE WHEN acq_month > {THR} THEN t ELSE 0.0 END')}
FROM {KEYED} WHERE campaign = 'FO-SCL' AND acq_month IS NOT NULL AND t IS NOT NULL GROUP BY acq_month
""")


# --- B13: the money tables of one run ---------------------------------------------------
MONEY_TABLES = {"withdrawal_quota": "acq_month", "cpo_new": "acq_month", "cpo_withdrawal": "del_month",
                "cpo_new_3783": "acq_month", "cpo_withdrawal_3783": "del_month", "ufc_new": "acq_month",
                "ufc_withdrawal": "del_month", "ufc_clawback": "del_month", "result": "month"}


@register("settlement_money")
def q_settlement_money(spark, sf_dir):
    """Every cell of the nine tables of amounts of one settlement run, from
    its one base (those of the second product: its non-zero cells)."""
    tables, out = S.settlement_tables(contracts(spark, sf_dir), PARAMS, keys=SPLIT_KEYS), None
    for name, month in MONEY_TABLES.items():
        cells = [c for c in tables[name].columns if c != month]
        long = tables[name].select(month, *[F.col(f"`{c}`").cast("double").alias(c) for c in cells]).unpivot(
            [month], cells, "key", "value").select(F.lit(name).alias("table"), F.col(month).alias("month"), "key", "value")
        long = long.where("value <> 0") if name.endswith("_3783") else long
        out = long if out is None else out.unionByName(long)
    return rounded(out)


def _cells(name: str, sql: str, where: str = "TRUE") -> str:
    month = MONEY_TABLES[name]
    return (f"SELECT '{name}' AS \"table\", {month} AS month, key, value::DOUBLE AS value FROM "
            f"(UNPIVOT ({sql}) ON COLUMNS(* EXCLUDE ({month})) INTO NAME key VALUE value) WHERE {where}")


def _cpo_sql(month: str, where: str) -> str:
    return f"""SELECT {month},
  {pivot_cols(SPLIT_KEYS, lambda k: _r(f"count(*) FILTER (WHERE column_key = '{k}') * {FEE_SQL(month)}"))}
FROM {KEYED} WHERE {month} IS NOT NULL AND {where} GROUP BY {month}"""


def _second_withdrawals() -> str:
    sums = {"FO": "FO-%", "JD": "JD-%"}
    each = _cpo_sql("del_month", "product_code = 3783 AND deletion_type IN (1, 2, 5)")
    rolled = ", ".join(_r(f"count(*) FILTER (WHERE column_key LIKE '{p}') * {FEE_SQL('del_month')}") + f' AS "{k}"'
                       for k, p in sums.items())
    return (f"SELECT a.*, b.* EXCLUDE (del_month) FROM ({each}) a JOIN (SELECT del_month, {rolled} FROM {KEYED} "
            "WHERE product_code = 3783 AND deletion_type IN (1, 2, 5) GROUP BY del_month) b USING (del_month)")


oracle("settlement_money", " UNION ALL ".join([
    _cells("withdrawal_quota", ORACLE["withdrawal_quota"]),
    _cells("cpo_new", _cpo_sql("acq_month", "product_code = 3402")),
    _cells("cpo_withdrawal", ORACLE["cpo_withdrawal"]),
    _cells("cpo_new_3783", _cpo_sql("acq_month", "product_code = 3783"), "value <> 0"),
    _cells("cpo_withdrawal_3783", _second_withdrawals(), "value <> 0"),
    _cells("ufc_new", ORACLE["ufc_new"]), _cells("ufc_withdrawal", ORACLE["ufc_withdrawal_all"]),
    _cells("ufc_clawback", ORACLE["ufc_clawback"]), _cells("result", ORACLE["settlement_result"])]))

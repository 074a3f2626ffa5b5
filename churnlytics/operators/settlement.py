"""Call-center and UFC settlement tables.

Tariffs are a parameter (``SettlementParams``) and are applied as a literal
map lookup keyed by the amount rounded to cents, so no join is needed and
float equality on 9.9 etc. is avoided.

``settlement_result`` (B7) is computed in one scan: each contract emits the
measure rows it contributes to (new business, withdrawal, UFC new/withdrawal/
claw-back), they are summed per (month, measure) with map-side partial
aggregation, and only the aggregated table (months x measures) is pivoted.
"""

from __future__ import annotations

from decimal import Decimal
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlytics.functions import columns as C
from churnlytics.operators.cohort import pivot_wide, weighted_count, with_column_key, with_gap_markers
from churnlytics.schema import (PRODUCT_MAIN, PRODUCT_SECOND, SETTLEMENT_REQUIRED, TERMINATION_TYPES,
                                WITHDRAWAL_TYPES, SettlementParams)
from churnlytics.sources import require_columns


def fee(month: Column | str, p: SettlementParams) -> Column:
    """B1 factor: ``fee_after`` for months after the threshold, else ``fee_before``."""
    m = F.col(month) if isinstance(month, str) else month
    return F.when(m > F.lit(p.threshold), F.lit(p.fee_after)).otherwise(F.lit(p.fee_before))


def amount_key(amount: Column | str = "amount") -> Column:
    a = F.col(amount) if isinstance(amount, str) else amount
    return F.round(a, 2).cast("decimal(12,2)")


def tariff(p: SettlementParams, amount: Column | str = "amount") -> Column:
    """UFC tariff of the contract's amount; NULL for amounts without tariff."""
    pairs = []
    for k, v in sorted(p.ufc_tariff.items()):
        pairs += [F.lit(Decimal(str(k))).cast("decimal(12,2)"), F.lit(float(v))]
    return F.try_element_at(F.create_map(*pairs), amount_key(amount))


def ufc_keys(p: SettlementParams) -> list[str]:
    """Column names of the UFC tables: ``FO-SCL_9_9`` ... in amount order."""
    return [f"{p.split_campaign}_{str(float(k)).replace('.', '_')}" for k in sorted(p.ufc_tariff)]


def _ufc_label(p: SettlementParams) -> Column:
    return F.concat(F.lit(p.split_campaign + "_"), F.regexp_replace(F.col("amount").cast("string"), r"\.", "_"))


# --- B1 / B2 ---------------------------------------------------------------
def cpo_new(df: DataFrame, p: SettlementParams, keys: Sequence[str] | None = None,
            by_product: bool = False, product: int | None = None, weight: str | None = None) -> DataFrame:
    """B1/B2: new-business count per (month, column key) times the month's fee.

    ``product`` filters one product (B2); ``by_product`` keeps the product as
    a row key so both products come from one scan."""
    require_columns(df, ("product_code", "campaign", "acq_month", "amount"))
    d = df if product is None else df.where(F.col("product_code") == product)
    rows = ["product_code", "acq_month"] if by_product else ["acq_month"]
    long = (with_column_key(d, p.split_campaign).where(F.col("acq_month").isNotNull())
            .groupBy(*rows, "column_key").agg(weighted_count(None, weight).alias("n"))
            .withColumn("value", F.col("n") * fee("acq_month", p)))
    return pivot_wide(long, rows, "column_key", "value", keys, fill=0.0).orderBy(*rows)


# --- B3 ----------------------------------------------------------------------
def cpo_withdrawal(df: DataFrame, p: SettlementParams, keys: Sequence[str] | None = None,
                   product: int | None = PRODUCT_MAIN, rollups: Sequence[str] = ("FO", "JD"),
                   weight: str | None = None) -> DataFrame:
    """Withdrawals {1,2,5} by deletion month times the month's fee, every
    calendar month between the first and last deletion month present, plus
    call-center roll-ups over the columns with that prefix."""
    d = df if product is None else df.where(F.col("product_code") == product)
    long = (with_column_key(d, p.split_campaign)
            .where(F.col("deletion_type").isin(list(WITHDRAWAL_TYPES)) & F.col("del_month").isNotNull())
            .groupBy("del_month", "column_key").agg(weighted_count(None, weight).alias("n"))
            .withColumn("value", F.col("n") * fee("del_month", p)))
    long = with_gap_markers(long.select("del_month", "column_key", "value"), "del_month", "column_key", "value")
    wide = pivot_wide(long, ["del_month"], "column_key", "value", keys, fill=0.0, markers=("_month",))
    key_cols = [c for c in wide.columns if c != "del_month"]
    for r in rollups:
        members = [F.col(f"`{c}`") for c in key_cols if c.startswith(r + "-")]
        wide = wide.withColumn(r, sum(members[1:], members[0]) if members else F.lit(0.0))
    return wide.orderBy("del_month")


# --- B4 - B6 -----------------------------------------------------------------
def _w(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.col(weight).cast("double")


def span_months(df: DataFrame) -> Column:
    """P12 span of the due dates, or the pre-computed ``span_months`` of a B13 base."""
    if "span_months" in df.columns:
        return F.col("span_months")
    return C.month_span("first_due_date", "last_due_date")


def ufc_new(df: DataFrame, p: SettlementParams, weight: str | None = None, early_months: str = "drop") -> DataFrame:
    """Split campaign; count x tariff per amount by acquisition month.

    Months up to the threshold are dropped (``early_months='drop'``) or kept
    as rows with value 0 (``'zero'``, the older variant)."""
    cond = F.col("campaign") == p.split_campaign
    if early_months == "drop":
        cond = cond & (F.col("acq_month") > p.threshold)
    elif early_months != "zero":
        raise ValueError(f"unknown early_months {early_months!r}")
    d = df.where(cond & F.col("acq_month").isNotNull()).withColumn("t", tariff(p)).where(F.col("t").isNotNull())
    val = F.when(F.col("acq_month") > p.threshold, F.col("t")).otherwise(F.lit(0.0))
    long = (d.groupBy("acq_month", _ufc_label(p).alias("k"))
            .agg(F.sum(val * _w(weight)).alias("value")))
    return pivot_wide(long, ["acq_month"], "k", "value", ufc_keys(p), fill=0.0).orderBy("acq_month")


def ufc_withdrawal(df: DataFrame, p: SettlementParams, cohort_rule: str = "none",
                   weight: str | None = None) -> DataFrame:
    """Withdrawals {1,2,5} of the split campaign by deletion month, x tariff.

    ``cohort_rule``: ``none`` (all), ``same_month`` (acquisition month = deletion
    month) or ``after_threshold`` (acquired after the threshold). The last two
    keep months up to the threshold as rows with value 0."""
    cond = ((F.col("campaign") == p.split_campaign) & F.col("deletion_type").isin(list(WITHDRAWAL_TYPES))
            & F.col("del_month").isNotNull())
    if cohort_rule == "same_month":
        cond = cond & (F.col("acq_month") == F.col("del_month"))
    elif cohort_rule == "after_threshold":
        cond = cond & (F.col("acq_month") > p.threshold)
    elif cohort_rule != "none":
        raise ValueError(f"unknown cohort_rule {cohort_rule!r}")
    d = df.where(cond).withColumn("t", tariff(p)).where(F.col("t").isNotNull())
    val = F.col("t")
    if cohort_rule != "none":
        val = F.when(F.col("del_month") > p.threshold, val).otherwise(F.lit(0.0))
    long = d.groupBy("del_month", _ufc_label(p).alias("k")).agg(F.sum(val * _w(weight)).alias("value"))
    return pivot_wide(long, ["del_month"], "k", "value", ufc_keys(p), fill=0.0).orderBy("del_month")


def clawback_factor(p: SettlementParams, span: Column | None = None) -> Column:
    """``1 - months/24`` with months = P12 span of the due dates."""
    span = C.month_span("first_due_date", "last_due_date") if span is None else span
    return F.lit(1.0) - span / F.lit(float(p.clawback_months))


def ufc_clawback_rows(df: DataFrame, p: SettlementParams) -> DataFrame:
    """B6 filter: terminations of the split campaign acquired after the threshold
    with a deletion month and a due-date span below ``clawback_months``."""
    return (df.where((F.col("campaign") == p.split_campaign)
                     & F.col("deletion_type").isin(list(TERMINATION_TYPES))
                     & (F.col("acq_month") > p.threshold) & F.col("del_month").isNotNull())
            .withColumn("span_months", span_months(df))
            .where(F.col("span_months") < p.clawback_months))


def ufc_clawback(df: DataFrame, p: SettlementParams, weight: str | None = None) -> DataFrame:
    """Sum of ``(1 - months/24) x tariff`` per (deletion month, amount)."""
    d = ufc_clawback_rows(df, p).withColumn("t", tariff(p)).where(F.col("t").isNotNull())
    long = d.groupBy("del_month", _ufc_label(p).alias("k")).agg(
        F.sum(clawback_factor(p, F.col("span_months")) * F.col("t") * _w(weight)).alias("value"))
    return pivot_wide(long, ["del_month"], "k", "value", ufc_keys(p), fill=0.0).orderBy("del_month")


# --- B7 ----------------------------------------------------------------------
RESULT_MEASURES = ["fo_new_cpo", "fo_withdrawal_cpo", "fo_new_cpo_3783", "fo_withdrawal_cpo_3783",
                   "jd_new_cpo", "jd_withdrawal_cpo", "fo_new_ufc", "fo_withdrawal_ufc", "fo_clawback_ufc",
                   "ts_new_cpo", "ts_withdrawal_cpo", "m3_new_cpo", "m3_withdrawal_cpo"]


def settlement_measures(df: DataFrame, p: SettlementParams, weight: str | None = None) -> DataFrame:
    """Long form of B7: ``(month, measure, value)`` summed over contracts.

    One scan; every contract emits at most six measure rows. Months of all
    component tables are kept (a ``_month`` marker row carries value 0).
    Per-row inputs (tariff, due-date span, call center, fees) are computed
    once in a projection below the explode."""
    require_columns(df, SETTLEMENT_REQUIRED)
    base = df.select(_w(weight).alias("_wt"), 
        F.col("acq_month"), F.col("del_month"), F.col("deletion_type"), F.col("product_code"), F.col("campaign"),
        F.lower(F.split_part(F.col("campaign"), F.lit("-"), F.lit(1))).alias("_cc"),
        tariff(p).alias("_t"),
        span_months(df).alias("_span"),
        fee("acq_month", p).alias("_fee_acq"), fee("del_month", p).alias("_fee_del"))
    prod = F.col("product_code")
    suffix = F.when(prod == PRODUCT_SECOND, F.lit("_3783")).otherwise(F.lit(""))
    is_cpo_product = prod.isin(PRODUCT_MAIN, PRODUCT_SECOND)
    wd = F.col("deletion_type").isin(list(WITHDRAWAL_TYPES)) & F.col("del_month").isNotNull()
    split = F.col("campaign") == p.split_campaign
    t = F.col("_t")
    claw = (split & F.col("deletion_type").isin(list(TERMINATION_TYPES)) & (F.col("acq_month") > p.threshold)
            & F.col("del_month").isNotNull() & (F.col("_span") < p.clawback_months))
    claw_value = -((F.lit(1.0) - F.col("_span") / F.lit(float(p.clawback_months))) * t)

    def row(cond, month, measure, value):
        return F.when(cond, F.struct(month.cast("int").alias("month"), measure.alias("measure"),
                                     (value.cast("double") * F.col("_wt")).alias("value")))

    sign = float(p.withdrawal_sign)
    rows = F.array(
        row(is_cpo_product & F.col("acq_month").isNotNull(), F.col("acq_month"),
            F.concat(F.col("_cc"), F.lit("_new_cpo"), suffix), F.col("_fee_acq")),
        row(is_cpo_product & wd, F.col("del_month"),
            F.concat(F.col("_cc"), F.lit("_withdrawal_cpo"), suffix), F.lit(sign) * F.col("_fee_del")),
        row(split & (F.col("acq_month") > p.threshold) & t.isNotNull(), F.col("acq_month"), F.lit("fo_new_ufc"), t),
        row(split & wd & t.isNotNull(), F.col("del_month"), F.lit("fo_withdrawal_ufc"), -t),
        row(claw & t.isNotNull(), F.col("del_month"), F.lit("fo_clawback_ufc"), claw_value),
        row(F.col("del_month").isNotNull(), F.col("del_month"), F.lit("_month"), F.lit(0.0)),
    )
    exploded = base.select(F.explode(rows).alias("r")).where(F.col("r").isNotNull()).select("r.*")
    return exploded.groupBy("month", "measure").agg(F.sum("value").alias("value"))


def settlement_result(df: DataFrame, p: SettlementParams, placeholders: bool = False,
                      weight: str | None = None) -> DataFrame:
    """Monthly result table (one row per month of any component table).

    The withdrawal tables of each product are gap-filled between their first
    and last month; the markers are added in the same pass over the
    aggregated measures, so the contracts are scanned once. Contracts are
    counted per settlement key first, so measures are made from the few keys."""
    if weight is None:
        df, weight = settlement_base(df, p), "n"
    long = settlement_measures(df, p, weight)
    group = (F.when(F.col("measure").endswith("_withdrawal_cpo"), F.lit("cpo"))
             .when(F.col("measure").endswith("_withdrawal_cpo_3783"), F.lit("cpo_3783")))
    allrows = with_gap_markers(long, "month", "measure", "value", group)
    # The report has fixed columns: money of a call center without any must not vanish. Other measures (gap
    # markers, a second product of the other call centers) just keep their months.
    known = {m.split("_")[0] for m in RESULT_MEASURES}
    told = F.concat(F.lit("settlement_result: no column for the call center of "), F.col("measure"))
    stray = F.col("measure").rlike("_cpo(_3783)?$") & ~F.substring_index("measure", "_", 1).isin(*known)
    allrows = allrows.withColumn("measure", F.when(stray, F.raise_error(told)).otherwise(F.col("measure")))
    wide = pivot_wide(allrows, ["month"], "measure", "value", RESULT_MEASURES, fill=0.0, others="drop")
    if placeholders:
        for cc in ("", "_3783", "_jd", "_ufc", "_ts", "_m3"):
            wide = wide.withColumn(f"re_call_center{cc}", F.lit("")).withColumn(f"actual_minus_target{cc}", F.lit(""))
    return wide.orderBy("month")


# Spreadsheet columns of the short result table -> engine names.
SHORT_RESULT_COLUMNS = {"M": "jd_new_cpo", "N": "jd_withdrawal_cpo", "Q": "ts_new_cpo",
                        "R": "ts_withdrawal_cpo", "U": "m3_new_cpo", "V": "m3_withdrawal_cpo"}


def short_result(df: DataFrame, p: SettlementParams, call_centers: Sequence[str] = ("jd", "ts", "m3"),
                 report_names: bool = False) -> DataFrame:
    """Short result table by ``YYYY-MM`` month label (P10): new business and
    withdrawals {1,2,5} x fee for the JD, TS and M3 call centers (all products,
    withdrawals positive, months = union of acquisition and deletion months).
    ``report_names`` gives the columns the report's letters."""
    cc = F.lower(F.split_part(F.col("campaign"), F.lit("-"), F.lit(1)))
    wd = F.col("deletion_type").isin(list(WITHDRAWAL_TYPES)) & F.col("del_month").isNotNull()

    def row(cond, month, measure, value):
        return F.when(cond, F.struct(month.cast("int").alias("month"), measure.alias("measure"),
                                     value.cast("double").alias("value")))
    rows = F.array(
        row(F.col("acq_month").isNotNull(), F.col("acq_month"), F.concat(cc, F.lit("_new_cpo")), fee("acq_month", p)),
        row(wd, F.col("del_month"), F.concat(cc, F.lit("_withdrawal_cpo")), fee("del_month", p)),
    )
    long = (df.select(F.explode(rows).alias("r")).where(F.col("r").isNotNull()).select("r.*")
            .groupBy("month", "measure").agg(F.sum("value").alias("value")))
    keys = [f"{c}_{k}_cpo" for c in call_centers for k in ("new", "withdrawal")]
    wide = pivot_wide(long, ["month"], "measure", "value", keys, fill=0.0, others="drop")
    letters = {v: k for k, v in SHORT_RESULT_COLUMNS.items()} if report_names else {}
    return wide.select(C.month_label("month").alias("month"),
                       *[F.col(k).alias(letters.get(k, k)) for k in keys]).orderBy("month")


BASE_KEYS = ("acq_month", "del_month", "campaign", "product_code", "amount", "deletion_type")


def settlement_base(df: DataFrame, p: SettlementParams) -> DataFrame:
    """B13 base: contracts counted per settlement key and due-date span.

    Spans of ``clawback_months`` or more never enter the claw-back, so they
    share one bucket; the result's size depends on the key domains (months,
    campaigns, amounts, types, spans), not on the number of contracts."""
    require_columns(df, SETTLEMENT_REQUIRED + ("first_due_date", "last_due_date"))
    span = F.least(C.month_span("first_due_date", "last_due_date"), F.lit(p.clawback_months)).alias("span_months")
    return df.groupBy(*BASE_KEYS, span).agg(F.count(F.lit(1)).alias("n"))


def settlement_tables(df: DataFrame, p: SettlementParams, keys: Sequence[str] | None = None,
                      base: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole settlement run as named tables derived from ONE base
    aggregate (``settlement_base``), materialised once with a reliable
    checkpoint so the 13 tables do not rescan the contracts."""
    from churnlytics.operators import cohort as K
    from churnlytics.session import cut_lineage
    b = cut_lineage(settlement_base(df, p)) if base is None else base
    w = "n"
    return {
        "contracts": df,
        "new_business": K.cohort_matrix_split(b, "acq_month", keys, None, p.split_campaign, weight=w),
        "withdrawals": K.cohort_matrix_split(b, "acq_month", keys, WITHDRAWAL_TYPES, p.split_campaign, weight=w),
        "terminations": K.cohort_matrix_split(b, "del_month", keys, TERMINATION_TYPES, p.split_campaign, weight=w),
        "withdrawals_by_del_month": K.cohort_matrix_split(b, "del_month", keys, WITHDRAWAL_TYPES, p.split_campaign,
                                                          weight=w),
        "withdrawal_quota": K.withdrawal_quota(b, "acq_month", keys, p.split_campaign, weight=w),
        "cpo_new": cpo_new(b, p, keys, product=PRODUCT_MAIN, weight=w),
        "cpo_withdrawal": cpo_withdrawal(b, p, keys, product=PRODUCT_MAIN, weight=w),
        "cpo_new_3783": cpo_new(b, p, None, product=PRODUCT_SECOND, weight=w),
        "cpo_withdrawal_3783": cpo_withdrawal(b, p, None, product=PRODUCT_SECOND, weight=w),
        "ufc_new": ufc_new(b, p, weight=w),
        "ufc_withdrawal": ufc_withdrawal(b, p, "none", weight=w),
        "ufc_clawback": ufc_clawback(b, p, weight=w),
        "result": settlement_result(b, p, weight=w),
    }

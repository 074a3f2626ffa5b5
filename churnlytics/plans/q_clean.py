"""Rows for the cleaning operators (P6-P9, P14-P16, P19, P22, B13) and for
NULLs in splits, top values and pivots, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlytics.functions import columns as C
from churnlytics.operators import cohort as K
from churnlytics.operators import settlement as S
from churnlytics.operators.enrich import drop_leakage, enrich_contracts, normalize_status
from churnlytics.operators.features import stratified_split
from churnlytics.operators.rates import top_n
from churnlytics.plans.catalog import register
from churnlytics.plans.common import AS_OF, CAMPAIGN_KEYS, PARAMS, SPLIT_KEYS, contracts, rounded
from churnlytics.plans.oracle import oracle
from churnlytics.sources.rejects import clean_contracts, rejects
from churnlytics.sources.testdata import raw_contracts_from_testdata, table


# --- P7-P9: text columns as a source delivers them ------------------------------------
def text_contracts(spark, sf_dir):
    """Every contract with its amount, start and deletion type as text: decimal
    commas, a date that is none for urgent orders, types written as '3.0'."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"),
                    F.concat(F.lit(" "), F.regexp_replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
                                                          r"\.", ",")).alias("amount_text"),
                    F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("n/a"))
                     .otherwise(F.to_date("o_orderdate").cast("string")).alias("start_text"),
                    F.when(F.col("o_orderstatus") == "O", F.lit("?"))
                     .otherwise(F.concat((F.col("o_orderkey") % 7).cast("string"), F.lit(".0"))).alias("type_text"))


@register("lenient_clean")
def q_lenient(spark, sf_dir):
    """P7-P9 and P21 on text columns."""
    t = text_contracts(spark, sf_dir)
    df = t.select("id", C.lenient_double("amount_text").alias("amount"), C.lenient_date("start_text").alias("start"),
                  F.col("type_text").alias("deletion_type"))
    return rounded(normalize_status(df))


oracle("lenient_clean", """
SELECT id, round(amount, 6) AS amount, start, deletion_type,
  CASE WHEN deletion_type = 0 THEN 'active' WHEN deletion_type IN (1, 2, 5) THEN 'withdrawal' ELSE 'other' END AS status
FROM (SELECT o_orderkey AS id, o_totalprice::DECIMAL(18,2)::DOUBLE AS amount,
  CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate::DATE END AS start,
  CASE WHEN o_orderstatus = 'O' THEN 0 ELSE (o_orderkey % 7)::INTEGER END AS deletion_type FROM orders)
""")


@register("rejected_values")
def q_rejected(spark, sf_dir):
    """The values that the cleaning of the text columns could not read."""
    cleaned = clean_contracts(text_contracts(spark, sf_dir), numbers=["amount_text"], types=["type_text"],
                              dates=["start_text"], integers=[])
    return rejects(cleaned)


oracle("rejected_values", """
SELECT o_orderkey AS id, 'start_text' AS "column", 'n/a' AS value, 'not a date' AS reason FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT o_orderkey, 'type_text', '?', 'not a type' FROM orders WHERE o_orderstatus = 'O'
""")


# --- P14-P16 ----------------------------------------------------------------------------
@register("date_features")
def q_dates(spark, sf_dir):
    """P14 with fill values, P15, P16 on the due dates (missing for some contracts)."""
    c = contracts(spark, sf_dir)
    gone = F.when(F.col("deletion_type") == 0, F.lit(None).cast("date")).otherwise(F.col("last_due_date"))
    c = c.withColumn("gone", gone)
    return rounded(c.select("id", C.day_diff_clipped("end_insurance", "gone", 365, 0).alias("days_left"),
                            C.days_until("gone", "end_insurance").alias("days_after"),
                            C.age_years("gone", F.to_date(F.lit(AS_OF))).alias("years"),
                            C.birth_month("gone").alias("month")))


oracle("date_features", f"""
SELECT id, greatest(coalesce(end_insurance - g, 365), 0)::INTEGER AS days_left, coalesce(g - end_insurance, -1)::INTEGER AS days_after,
  round(coalesce((DATE '{AS_OF}' - g) / 365.25, 0.0), 6) AS years, coalesce(month(g), -1)::INTEGER AS month
FROM (SELECT *, CASE WHEN deletion_type <> 0 THEN last_due_date END AS g FROM contracts)
""")


# --- P6 -----------------------------------------------------------------------------------
@register("enrich_legacy_month13")
def q_legacy(spark, sf_dir):
    """P1/P6 with the old month rule (month 13 in December)."""
    e = enrich_contracts(raw_contracts_from_testdata(spark, sf_dir), legacy_month13=True)
    return e.groupBy("del_month").agg(F.count(F.lit(1)).alias("n"))


oracle("enrich_legacy_month13", """
SELECT (year(deletion_allowed_at) * 100 + month(deletion_allowed_at) + 1)::INTEGER AS del_month, count(*) AS n
FROM contracts GROUP BY 1
""")


# --- P19 ----------------------------------------------------------------------------------
@register("leakage_columns")
def q_leakage(spark, sf_dir):
    """A column per contract column that the rule leaves, counted."""
    c = contracts(spark, sf_dir).withColumn("event", C.event_flag("deletion_type"))
    kept = drop_leakage(c)
    row = kept.agg(*[F.count(x).alias(x) for x in kept.columns])
    return row.unpivot([], kept.columns, "column", "n")


_KEPT = ["id", "customer_id", "campaign", "amount", "product_code", "start_insurance", "call_center", "channel",
         "end_insurance", "report_date", "acq_month", "first_due_date", "event"]
oracle("leakage_columns", " UNION ALL ".join(
    f"SELECT '{x}' AS \"column\", count({'deletion_type' if x == 'event' else x}) AS n FROM contracts" for x in _KEPT))


# --- NULLs --------------------------------------------------------------------------------
def with_gaps(spark, sf_dir):
    """Contracts with the nation's region where it lies in the first region, else
    NULL (a left join that misses), and a label that is NULL there too."""
    n = table(spark, sf_dir, "nation").where("n_regionkey <> 0").select(F.col("n_name").alias("region_code"),
                                                                       F.col("n_name").alias("known"))
    c = contracts(spark, sf_dir, due_dates=False, region=True)
    c = c.join(F.broadcast(n), "region_code", "left")  # nation: 25 rows
    return c.withColumn("label", F.when(F.col("known").isNotNull(), C.event_flag("deletion_type")))


GAPS_SQL = """g AS (SELECT c.*, n.n_name AS known, CASE WHEN n.n_name IS NOT NULL THEN (deletion_type <> 0)::INTEGER END AS label
  FROM contracts c LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) n ON n.n_name = c.region_code)"""


@register("split_with_nulls")
def q_split_nulls(spark, sf_dir):
    """X10 with a class of NULL labels."""
    sp = stratified_split(with_gaps(spark, sf_dir), "label")
    return sp.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


oracle("split_with_nulls", """
SELECT split, label, count(*) AS n, sum(id)::BIGINT AS id_sum
FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY h, id)
        <= floor(0.8 * count(*) OVER (PARTITION BY label)) THEN 'train' ELSE 'test' END AS split
      FROM (SELECT *, ('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT AS h FROM g))
GROUP BY split, label
""", extra_ctes=GAPS_SQL)


@register("top_categories_with_nulls")
def q_top_nulls(spark, sf_dir):
    """O2 over a column with NULLs, which take no place."""
    return top_n(with_gaps(spark, sf_dir), "known", 10)


oracle("top_categories_with_nulls", "SELECT known, count(*) AS n FROM g WHERE known IS NOT NULL GROUP BY known ORDER BY n DESC, known LIMIT 10",
       extra_ctes=GAPS_SQL)


@register("cohort_matrix_found_keys")
def q_found_keys(spark, sf_dir):
    """A1 with the column keys read from the data."""
    return K.cohort_matrix(contracts(spark, sf_dir, due_dates=False), "acq_month", "campaign")


oracle("cohort_matrix_found_keys", "SELECT acq_month, " + ", ".join(
    f"count(*) FILTER (WHERE campaign = '{k}') AS \"{k}\"" for k in CAMPAIGN_KEYS) + " FROM contracts GROUP BY acq_month")


# --- B13 ----------------------------------------------------------------------------------
WORKBOOK = {"new_business": "acq_month", "withdrawals": "acq_month", "terminations": "del_month",
            "withdrawals_by_del_month": "del_month"}


@register("settlement_workbook")
def q_workbook(spark, sf_dir):
    """The count tables of one settlement run, from its one base, in long form."""
    t = S.settlement_tables(contracts(spark, sf_dir), PARAMS, keys=SPLIT_KEYS)
    out = None
    for name, month in WORKBOOK.items():
        long = t[name].unpivot([month], SPLIT_KEYS, "key", "n").select(
            F.lit(name).alias("table"), F.col(month).alias("month"), "key", F.col("n").cast("long").alias("n"))
        out = long if out is None else out.unionByName(long)
    return out.where("n <> 0")


_KEY = "CASE WHEN campaign = 'FO-SCL' THEN campaign || '_' || replace(amount::VARCHAR, '.', '_') ELSE campaign END"
_TYPES = {"new_business": "TRUE", "withdrawals": "deletion_type IN (1, 2, 5)",
          "terminations": f"deletion_type IN ({', '.join(map(str, S.TERMINATION_TYPES))})",
          "withdrawals_by_del_month": "deletion_type IN (1, 2, 5)"}
oracle("settlement_workbook", " UNION ALL ".join(
    f"SELECT '{name}' AS \"table\", {month} AS month, {_KEY} AS key, count(*) AS n FROM contracts "
    f"WHERE {_TYPES[name]} AND {month} IS NOT NULL GROUP BY ALL" for name, month in WORKBOOK.items()))

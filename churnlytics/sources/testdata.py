"""The ``contracts`` view over the driver's TPC-H-like test tables.

The test tables hold no insurance contracts, so this module maps orders,
line items, customers and nations onto the contract schema. It only shapes
rows; it does none of the analytics. Joins are added only when a caller asks
for the columns they produce, because Catalyst cannot drop an unused outer
join by itself:

* ``due_dates=True``  -> line items are pre-aggregated per order (partial
  aggregate before the shuffle) and joined on the order key.
* ``region=True``     -> customer join on the customer key, then the 25-row
  nation table (fixed size) is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlytics.functions.columns import deletion_month, month_key

# Fixed values of the test view (FIXTURES §2).
TEST_CAMPAIGNS = ("FO-S2S", "FO-ITM", "FO-OTM", "FO-SCL", "JD-ITM", "JD-OTM", "M3-OTM", "TS-OTM")
TEST_AMOUNTS = (9.9, 14.9, 19.9, 24.9, 29.9)
TEST_THRESHOLD = 199806
TEST_AS_OF = "2001-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contracts_from_testdata(spark: SparkSession, sf_dir: str, due_dates: bool = True,
                            region: bool = False) -> DataFrame:
    """Contracts derived from ``orders`` (+ ``lineitem``, ``customer``, ``nation``)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    campaign = F.element_at(F.array(*[F.lit(c) for c in TEST_CAMPAIGNS]),
                            (F.col("o_custkey") % 8).cast("int") + 1)
    amount = F.element_at(F.array(*[F.lit(a) for a in TEST_AMOUNTS]),
                          (F.col("o_orderkey") % 5).cast("int") + 1)
    df = o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer_id"),
        campaign.alias("campaign"),
        amount.alias("amount"),
        F.when(F.col("o_orderstatus") == "O", F.lit(0))
         .otherwise(F.lit(1) + F.col("o_orderkey") % 7).cast("int").alias("deletion_type"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit(3783)).otherwise(F.lit(3402)).cast("int").alias("product_code"),
        F.to_date("o_orderdate").alias("start_insurance"),
        (F.lit(365) * (F.lit(1) + F.col("o_orderkey") % 3)).cast("int").alias("_term_days"),
    )
    df = df.withColumns({
        "call_center": F.split_part("campaign", F.lit("-"), F.lit(1)),
        "channel": F.split_part("campaign", F.lit("-"), F.lit(2)),
        "end_insurance": F.date_add("start_insurance", F.col("_term_days")),
        "report_date": F.date_sub("start_insurance", 1),
    }).drop("_term_days")
    df = df.withColumn("acq_month", month_key("report_date"))

    if due_dates:
        # Partial aggregate per order before the shuffle; output is one row per order.
        li = (table(spark, sf_dir, "lineitem")
              .select("l_orderkey", F.to_date("l_shipdate").alias("ship"))
              .groupBy("l_orderkey")
              .agg(F.min("ship").alias("first_due_date"), F.max("ship").alias("last_due_date")))
        df = df.join(li, df.id == li.l_orderkey, "left").drop("l_orderkey")
        df = df.withColumn("deletion_allowed_at",
                           F.when(F.col("deletion_type") != 0, F.col("last_due_date")))
        df = df.withColumn("del_month", deletion_month("deletion_allowed_at"))
    if region:
        cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("region_code"))
        # nation has a fixed 25 rows: safe to broadcast at any scale.
        cn = cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey, "left") \
                 .select("c_custkey", "region_code")
        df = df.join(cn, df.customer_id == cn.c_custkey, "left").drop("c_custkey")
    return df


def raw_contracts_from_testdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw source rows of the enrichment job (P1): contract number (a head of 6
    characters, the call center at 7-8, then the whole contract and customer
    ids), campaign number, start date, deletion date."""
    c = contracts_from_testdata(spark, sf_dir, due_dates=True)
    return c.select(
        F.concat(F.lit("VTRG00"), F.col("call_center"), F.col("id").cast("string"), F.lit("-"),
                 F.col("customer_id").cast("string")).alias("contract_no"),
        F.col("channel").alias("campaign_no"),
        F.col("start_insurance"),
        F.col("deletion_allowed_at"),
    )

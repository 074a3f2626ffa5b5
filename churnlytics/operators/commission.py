"""Premium commission per campaign.

Commission per contract = 27.90 + 0.53 x (3 yearly premiums). Withdrawals
reverse it; terminations within 36 months pay back the unearned share.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlytics.functions import columns as C
from churnlytics.operators.cohort import pivot_wide
from churnlytics.schema import (PREMIUM_BASE, PREMIUM_CLAWBACK_MONTHS, PREMIUM_RATE,
                                PREMIUM_YEARS, TERMINATION_TYPES_PREMIUM, WITHDRAWAL_TYPES)
from churnlytics.sources import require_columns


def premium_value(amount: Column | str = "amount") -> Column:
    """B9 per-contract commission."""
    a = F.col(amount) if isinstance(amount, str) else amount
    return F.lit(PREMIUM_BASE) + F.lit(PREMIUM_RATE) * (F.lit(float(PREMIUM_YEARS)) * a)


def premium_clawback_value(months: Column) -> Column:
    """``-commission x (36 - months) / 36``."""
    return -(premium_value() * (F.lit(float(PREMIUM_CLAWBACK_MONTHS)) - months)
             / F.lit(float(PREMIUM_CLAWBACK_MONTHS)))


def premium_commission_new(df: DataFrame, campaigns: Sequence[str] | None = None) -> DataFrame:
    """Sum of commissions per (acquisition month, campaign)."""
    require_columns(df, ("campaign", "acq_month", "amount"))
    long = (df.where(F.col("acq_month").isNotNull())
            .groupBy("acq_month", "campaign").agg(F.sum(premium_value()).alias("value")))
    return pivot_wide(long, ["acq_month"], "campaign", "value", campaigns, fill=0.0).orderBy("acq_month")


def premium_commission_withdrawal(df: DataFrame, campaigns: Sequence[str] | None = None) -> DataFrame:
    """Withdrawals {1,2,5} by deletion month, negated."""
    long = (df.where(F.col("deletion_type").isin(list(WITHDRAWAL_TYPES)) & F.col("del_month").isNotNull())
            .groupBy("del_month", "campaign").agg((-F.sum(premium_value())).alias("value")))
    return pivot_wide(long, ["del_month"], "campaign", "value", campaigns, fill=0.0).orderBy("del_month")


def premium_clawback(df: DataFrame, campaigns: Sequence[str] | None = None) -> DataFrame:
    """Terminations {3,4,6}; months = P11(acq, del); only 1..36 pay back.

    Every deletion month of a termination is a row (0 when all were skipped)."""
    md = C.month_diff("acq_month", "del_month")
    keep = md.between(1, PREMIUM_CLAWBACK_MONTHS)
    long = (df.where(F.col("deletion_type").isin(list(TERMINATION_TYPES_PREMIUM)) & F.col("del_month").isNotNull())
            .groupBy("del_month", "campaign")
            .agg(F.sum(F.when(keep, premium_clawback_value(md)).otherwise(F.lit(0.0))).alias("value")))
    return pivot_wide(long, ["del_month"], "campaign", "value", campaigns, fill=0.0).orderBy("del_month")


def call_center_result(df: DataFrame, call_centers: Sequence[str] | None = None, others: str = "drop") -> DataFrame:
    """Per month and call center (P18 prefix) the new, withdrawal and
    claw-back sums, from one scan (long rows -> one pivot). ``call_centers``
    selects some; with ``others='raise'`` they must be all, and a call center
    that is not among them fails the query."""
    cc = C.call_center_prefix("campaign")
    md = C.month_diff("acq_month", "del_month")
    pv = premium_value()

    def row(cond, month, kind, value):
        return F.when(cond, F.struct(month.cast("int").alias("month"),
                                     F.concat(cc, F.lit("_" + kind)).alias("k"),
                                     value.cast("double").alias("value")))
    has_cc = cc.isNotNull()
    rows = F.array(
        row(has_cc & F.col("acq_month").isNotNull(), F.col("acq_month"), "new", pv),
        row(has_cc & F.col("deletion_type").isin(list(WITHDRAWAL_TYPES)) & F.col("del_month").isNotNull(),
            F.col("del_month"), "withdrawal", -pv),
        row(has_cc & F.col("deletion_type").isin(list(TERMINATION_TYPES_PREMIUM)) & F.col("del_month").isNotNull(),
            F.col("del_month"), "clawback",
            F.when(md.between(1, PREMIUM_CLAWBACK_MONTHS), premium_clawback_value(md)).otherwise(F.lit(0.0))),
    )
    long = (df.select(F.explode(rows).alias("r")).where(F.col("r").isNotNull()).select("r.*")
            .groupBy("month", "k").agg(F.sum("value").alias("value")))
    if call_centers is None:
        keys = None
    else:
        keys = [f"{c}_{k}" for c in call_centers for k in ("new", "withdrawal", "clawback")]
    return pivot_wide(long, ["month"], "k", "value", keys, fill=0.0, others=others).orderBy("month")

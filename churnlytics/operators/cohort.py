"""Cohort count matrices.

Long form ``(month, key, value)`` is the core result; the wide matrix is a
thin last step (``pivot`` on the already aggregated long table, whose size is
months x keys and does not grow with the number of contracts).
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlytics.functions.columns import split_key
from churnlytics.schema import SPLIT_CAMPAIGN, WITHDRAWAL_TYPES

MAX_PIVOT_KEYS = 2000


def distinct_values(df: DataFrame, col: str, limit: int = MAX_PIVOT_KEYS) -> list:
    """Sorted distinct non-NULL values of a low-cardinality column.

    The list becomes pivot columns, so its size is checked: more than
    ``limit`` values raises instead of collecting an unbounded list; a caller
    that wants more columns passes a larger limit or the keys themselves.
    """
    vals = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct()
            .limit(limit + 1).collect()]
    if len(vals) > limit:
        raise ValueError(f"column {col!r} has more than {limit} distinct values; not a pivot key")
    return sorted(vals)


def with_column_key(df: DataFrame, split_campaign: str | None = SPLIT_CAMPAIGN,
                    campaign_col: str = "campaign", amount_col: str = "amount",
                    out: str = "column_key") -> DataFrame:
    """A2: the campaign, with ``split_campaign`` split by premium amount."""
    if split_campaign is None:
        return df.withColumn(out, F.col(campaign_col))
    return df.withColumn(out, split_key(campaign_col, amount_col, split_campaign))


def weighted_count(pred: Column | None = None, weight: str | None = None) -> Column:
    """``count_if(pred)`` on contracts, or the sum of ``weight`` over rows of a
    pre-aggregated table (B13 base)."""
    if weight is None:
        return F.count(F.lit(1)) if pred is None else F.count_if(pred)
    w = F.col(weight)
    return F.sum(w if pred is None else F.when(pred, w).otherwise(F.lit(0))).cast("long")


def cohort_long(df: DataFrame, month_col: str = "acq_month", key_col: str = "campaign",
                deletion_types: Iterable[int] | None = None, extra_keys: Sequence[str] = (),
                value: str = "n", weight: str | None = None) -> DataFrame:
    """A1/A3 long form: one row per (month, key) present in the input.

    With ``deletion_types`` the count is a conditional count over *all* rows,
    so every month of the input appears (A3's "given row set") with 0 where no
    contract of those types exists - one pass, no join against a month list.
    """
    pred = None if deletion_types is None else F.col("deletion_type").isin(list(deletion_types))
    return (df.where(F.col(month_col).isNotNull())
            .groupBy(*extra_keys, month_col, key_col)
            .agg(weighted_count(pred, weight).alias(value)))


def pivot_wide(long_df: DataFrame, row_cols: Sequence[str], key_col: str, value_col: str,
               keys: Sequence | None = None, fill=0, others: str = "raise",
               markers: Sequence = ()) -> DataFrame:
    """Pivot an aggregated long table to a wide matrix, missing cells -> ``fill``.

    ``keys`` should be passed when known; otherwise they are read from the
    (already small) long table with a size check. A key that is not among
    them fails the query, unless ``others='drop'`` says that the table has
    fixed columns. NULL keys (as in a pandas pivot) and ``markers`` have no
    column; their rows stay. ``fill=None`` leaves missing cells NULL.
    """
    if others not in ("raise", "drop"):
        raise ValueError("others is 'raise' or 'drop'")
    if keys is None:
        keys = distinct_values(long_df, key_col)
    elif others == "raise":
        known = F.col(key_col).isNull()
        for k in [*keys, *markers]:
            known = known | (F.col(key_col) == F.lit(k))
        told = F.concat(F.lit(f"pivot of {key_col}: no column for the key "), F.col(key_col).cast("string"))
        long_df = long_df.where(F.when(known, F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))
    # one conditional aggregation (a single exchange) instead of pivot's two
    cells = [F.sum(F.when(F.col(key_col) == F.lit(k), F.col(value_col))).alias(str(k)) for k in keys]
    wide = long_df.groupBy(*row_cols).agg(*cells)
    return wide if fill is None else wide.na.fill(fill, subset=[str(k) for k in keys])


def cohort_matrix(df: DataFrame, month_col: str = "acq_month", key_col: str = "campaign",
                  keys: Sequence | None = None, deletion_types: Iterable[int] | None = None,
                  extra_keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """A1/A3 wide: rows = month (ascending), one count column per key."""
    long = cohort_long(df, month_col, key_col, deletion_types, extra_keys, weight=weight)
    return pivot_wide(long, [*extra_keys, month_col], key_col, "n", keys).orderBy(*extra_keys, month_col)


def cohort_matrix_split(df: DataFrame, month_col: str = "acq_month", keys: Sequence | None = None,
                        deletion_types: Iterable[int] | None = None,
                        split_campaign: str = SPLIT_CAMPAIGN, weight: str | None = None) -> DataFrame:
    """A2 (and A3 with ``deletion_types``): campaign columns, the split campaign by amount."""
    keyed = with_column_key(df, split_campaign)
    return cohort_matrix(keyed, month_col, "column_key", keys, deletion_types, weight=weight)


def quota_long(df: DataFrame, month_col: str = "acq_month", key_col: str = "column_key",
               deletion_types: Iterable[int] = WITHDRAWAL_TYPES, weight: str | None = None) -> DataFrame:
    """A4 long: ``100 * count_if(type in deletion_types) / count(*)`` per (month, key)."""
    pred = F.col("deletion_type").isin(list(deletion_types))
    return (df.where(F.col(month_col).isNotNull())
            .groupBy(month_col, key_col)
            .agg((weighted_count(pred, weight) * 100.0 / weighted_count(None, weight)).alias("quota")))


def withdrawal_quota(df: DataFrame, month_col: str = "acq_month", keys: Sequence | None = None,
                     split_campaign: str = SPLIT_CAMPAIGN, weight: str | None = None) -> DataFrame:
    """A4 wide: one pass computes numerator and denominator together; a cell
    with no contracts is 0 (the safe-ratio rule P23)."""
    long = quota_long(with_column_key(df, split_campaign), month_col, weight=weight)
    return pivot_wide(long, [month_col], "column_key", "quota", keys, fill=0.0).orderBy(month_col)


def _month_date(c: Column) -> Column:
    return F.make_date((c / 100).cast("int"), (c % 100).cast("int"), F.lit(1))


def _months_between_keys(lo: Column, hi: Column) -> Column:
    """Array of ``YYYYMM`` ints from ``lo`` to ``hi`` (calendar months)."""
    seq = F.sequence(_month_date(lo), _month_date(hi), F.expr("INTERVAL 1 MONTH"))
    return F.transform(seq, lambda d: (F.year(d) * 100 + F.month(d)).cast("int"))


def with_gap_markers(long: DataFrame, month_col: str, key_col: str, value_col: str,
                     group: Column | None = None, marker: str = "_month") -> DataFrame:
    """O7 in one pass over an aggregated long table: rows are kept and, per
    ``group`` (all rows when None; rows with a NULL group get no markers),
    one marker row ``(m, marker, 0.0)`` is added for every calendar month m
    between the group's min and max month. Bounds come from window functions
    over the small aggregated table, so the source is read once (no self-join,
    no second branch)."""
    g = F.lit(1) if group is None else group
    x = long.withColumn("_g", g)
    w = Window.partitionBy("_g")
    x = (x.withColumn("_lo", F.min(month_col).over(w)).withColumn("_hi", F.max(month_col).over(w))
          .withColumn("_rn", F.row_number().over(w.orderBy(month_col, key_col))))
    own = F.array(F.struct(F.col(month_col).cast("int").alias(month_col), F.col(key_col).alias(key_col),
                           F.col(value_col).cast("double").alias(value_col)))
    marks = F.transform(_months_between_keys(F.col("_lo"), F.col("_hi")),
                        lambda m: F.struct(m.alias(month_col), F.lit(marker).alias(key_col),
                                           F.lit(0.0).alias(value_col)))
    rows = F.when((F.col("_rn") == 1) & F.col("_g").isNotNull(), F.concat(own, marks)).otherwise(own)
    return x.select(F.explode(rows).alias("_r")).select("_r.*")


def gap_fill_months(df: DataFrame, month_col: str, fill=0) -> DataFrame:
    """O7 for a table with one row per month: every calendar month between the
    min and max month gets a row, missing values -> ``fill``. Single pass:
    marker rows are generated next to the data and merged by month."""
    value_cols = [c for c in df.columns if c != month_col]
    w = Window.partitionBy()
    x = (df.withColumn("_lo", F.min(month_col).over(w)).withColumn("_hi", F.max(month_col).over(w))
           .withColumn("_rn", F.row_number().over(w.orderBy(month_col))))
    own = F.array(F.struct(F.col(month_col).cast("int").alias(month_col),
                           *[F.col(f"`{c}`").alias(c) for c in value_cols]))
    marks = F.transform(_months_between_keys(F.col("_lo"), F.col("_hi")),
                        lambda m: F.struct(m.alias(month_col),
                                           *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in value_cols]))
    rows = F.when(F.col("_rn") == 1, F.concat(own, marks)).otherwise(own)
    exploded = x.select(F.explode(rows).alias("_r")).select("_r.*")
    out = exploded.groupBy(month_col).agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in value_cols])
    return out.na.fill(fill, subset=value_cols) if value_cols else out


def months_of(df: DataFrame, cols: Sequence[str], out: str = "month") -> DataFrame:
    """O5 for several month columns of ONE table: one pass (explode), distinct."""
    arr = F.array(*[F.col(c).cast("int") for c in cols])
    return df.select(F.explode(arr).alias(out)).where(F.col(out).isNotNull()).distinct()


def month_union(*frames_and_cols: tuple[DataFrame, str], out: str = "month") -> DataFrame:
    """Distinct union of month columns of several (different) tables."""
    parts = [f.select(F.col(c).cast("int").alias(out)) for f, c in frames_and_cols]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.where(F.col(out).isNotNull()).distinct()

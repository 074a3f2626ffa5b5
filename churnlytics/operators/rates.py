"""Descriptive churn-rate analytics.

All operators are single-scan aggregations; shares against a grand total use
a window over the already aggregated (small) table instead of a second scan.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlytics.functions import columns as C
from churnlytics.operators.cohort import pivot_wide
from churnlytics.operators.quantiles import quantiles
from churnlytics.schema import CANCEL_TIME_EDGES, DURATION_BIN_EDGES


def _total(counts: DataFrame, n: str) -> Column:
    """Sum of the counts as a scalar subquery over the aggregated table (one
    row; no window over all values, no second scan: the aggregate is reused)."""
    return counts.agg(F.sum(n).cast("double")).scalar()


def value_counts(df: DataFrame, col: str, digits: int | None = None) -> DataFrame:
    """``(value, n, pct)`` with the percentage of all rows."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    pct = F.col("n") * 100.0 / _total(g, "n")
    return g.withColumn("pct", pct if digits is None else F.bround(pct, digits))


def two_class_share(df: DataFrame, col: str = "deletion_type") -> DataFrame:
    """Count and share of 0 vs > 0 in one pass."""
    return df.agg(F.count_if(F.col(col) == 0).alias("n_zero"), F.count_if(F.col(col) > 0).alias("n_positive"),
                  F.count(F.lit(1)).alias("n")) \
        .withColumn("pct_zero", F.col("n_zero") * 100.0 / F.col("n")) \
        .withColumn("pct_positive", F.col("n_positive") * 100.0 / F.col("n"))


def rate_by(df: DataFrame, keys: Sequence[str], event_col: str = "event", digits: int | None = 2) -> DataFrame:
    """Contracts, cancelled and cancellation quota (%) per key."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("contracts"),
                              F.sum(F.col(event_col)).cast("long").alias("cancelled"))
    r = F.col("cancelled") * 100.0 / F.col("contracts")
    return g.withColumn("rate", r if digits is None else F.bround(r, digits))


def rate_all_levels(df: DataFrame, levels: Sequence[str], event_col: str = "event") -> DataFrame:
    """A9 at every level plus the grand total in one scan (GROUPING SETS).

    Output ``(level, key, contracts, cancelled, rate)``; ``level='all'`` is the total."""
    sets = [[F.col(l)] for l in levels] + [[]]
    g = df.groupingSets(sets, *levels).agg(F.count(F.lit(1)).alias("contracts"),
                                           F.sum(F.col(event_col)).cast("long").alias("cancelled"),
                                           *[F.grouping(l).alias(f"_g_{l}") for l in levels])
    level = F.lit("all")
    key = F.lit(None).cast("string")
    for l in reversed(levels):
        level = F.when(F.col(f"_g_{l}") == 0, F.lit(l)).otherwise(level)
        key = F.when(F.col(f"_g_{l}") == 0, F.col(l).cast("string")).otherwise(key)
    return g.select(level.alias("level"), key.alias("key"), "contracts", "cancelled",
                    F.bround(F.col("cancelled") * 100.0 / F.col("contracts"), 2).alias("rate"))


def rate_matrix(df: DataFrame, row_key: str, col_key: str, cols: Sequence[str] | None = None,
                event_col: str = "event") -> DataFrame:
    """A10: mean cancellation rate (%) pivoted row_key x col_key (NULL where empty)."""
    long = df.groupBy(row_key, col_key).agg((F.avg(event_col) * 100.0).alias("rate"))
    return pivot_wide(long, [row_key], col_key, "rate", cols, fill=None)


def unpivot_measures(df: DataFrame, ids: Sequence[str], measures: Sequence[str],
                     var: str = "metric", val: str = "value") -> DataFrame:
    """Melt measure columns into (metric, value) rows."""
    cast = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in measures])
    return cast.unpivot(list(ids), list(measures), var, val)


def rate_trend(rates: DataFrame, x: str, y: str = "rate") -> DataFrame:
    """Least-squares slope, intercept and R^2 of y on x."""
    return rates.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                     F.regr_r2(y, x).alias("r2"))


def share(df: DataFrame, key: str) -> DataFrame:
    """Contracts per key and share (%) of all contracts."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("contracts"))
    return g.withColumn("share", F.col("contracts") * 100.0 / _total(g, "contracts"))


def feature_rate(df: DataFrame, feature: str, event_col: str = "event", by: Sequence[str] = (),
                 min_n: int = 0) -> DataFrame:
    """Mean event and n per feature value (per ``by`` group), keeping n >= min_n."""
    g = df.groupBy(*by, feature).agg(F.avg(F.col(event_col).cast("double")).alias("event_rate"),
                                     F.count(F.lit(1)).alias("n"))
    if min_n:
        g = g.where(F.col("n") >= min_n)
    return g


def feature_rate_by_campaign(df: DataFrame, feature: str, event_col: str = "event",
                             min_group: int = 5, min_campaign: int = 10) -> DataFrame:
    """A12 per campaign; campaigns with >= min_campaign rows, groups with n >= min_group.

    The campaign size comes from a window over the (campaign, value) aggregate,
    not from a second scan of the contracts."""
    g = df.groupBy("campaign", feature).agg(F.avg(F.col(event_col).cast("double")).alias("event_rate"),
                                            F.count(F.lit(1)).alias("n"))
    g = g.withColumn("_campaign_n", F.sum("n").over(Window.partitionBy("campaign")))
    return g.where((F.col("_campaign_n") >= min_campaign) & (F.col("n") >= min_group)).drop("_campaign_n")


def histogram_fixed(df: DataFrame, value_col: str, edges: Sequence[float] = CANCEL_TIME_EDGES,
                    right_closed: bool = False, include_lowest: bool = True, open_last: bool = True) -> DataFrame:
    """Counts per bin of fixed edges; the last bin is open to +inf.

    Left-closed bins ``[e_i, e_{i+1})`` (A14) or right-closed ``(e_i, e_{i+1}]``
    with the lowest edge included (A15). Empty bins are kept with 0."""
    v = F.col(value_col)
    bounds = list(edges) + ([float("inf")] if open_last else [])
    idx = F.lit(None).cast("int")
    for i in range(len(bounds) - 2, -1, -1):
        lo, hi = bounds[i], bounds[i + 1]
        if right_closed:
            cond = ((v > lo) | (F.lit(include_lowest and i == 0) & (v == lo))) & (v <= hi)
        else:
            cond = (v >= lo) & (v < hi)
        idx = F.when(cond, F.lit(i)).otherwise(idx)
    counts = df.select(idx.alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"))
    # Empty bins: the bin list is a fixed parameter (len(edges) rows).
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, float(bounds[i]), float(bounds[i + 1])) for i in range(len(bounds) - 1)],
                                 "bin int, lower double, upper double")
    return bins.join(counts, "bin", "left").select("bin", "lower", "upper",
                                                   F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def duration_bins(df: DataFrame, value_col: str = "duration") -> DataFrame:
    """Right-closed duration groups 0-30 ... >1200, duration 0 in the first."""
    return histogram_fixed(df, value_col, DURATION_BIN_EDGES, right_closed=True, include_lowest=True)


def density_histogram(df: DataFrame, value_col: str, class_col: str, lo: float | None = None,
                      hi: float | None = None, n_bins: int = 20) -> DataFrame:
    """Per-class density histogram ``count / (n_class * width)`` over
    the range of the data (two scalars; the last bin holds the maximum). With
    ``lo`` or ``hi`` given, a value beyond them fails the query."""
    if lo is None or hi is None:
        r = df.agg(F.min(value_col).cast("double"), F.max(value_col).cast("double")).first()
        lo, hi = (r[0] if lo is None else lo), (r[1] if hi is None else hi)
        lo, hi = (0.0 if lo is None else lo), (1.0 if hi is None else hi)
    hi = hi if hi > lo else lo + 1.0
    inside = F.col(value_col).isNull() | F.col(value_col).between(lo, hi)
    df = df.where(F.when(inside, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"{value_col} outside [{lo}, {hi}]")).cast("boolean")))
    width = (hi - lo) / n_bins
    b = F.least(F.greatest(F.floor((F.col(value_col) - lo) / width), F.lit(0)), F.lit(n_bins - 1)).cast("int")
    g = df.where(F.col(value_col).isNotNull()).groupBy(class_col, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("_nc", F.sum("n").over(Window.partitionBy(class_col)))
    return g.select(class_col, "bin", (F.lit(lo) + F.col("bin") * width).alias("lower"), "n",
                    (F.col("n") / (F.col("_nc") * F.lit(width))).alias("density"))


def describe_by(df: DataFrame, value_col: str, group_col: str) -> DataFrame:
    """Min / max / mean / exact median per group (median from value counts;
    a NULL group is a group)."""
    basic = df.groupBy(group_col).agg(F.min(value_col).cast("double").alias("min"),
                                      F.max(value_col).cast("double").alias("max"),
                                      F.avg(value_col).alias("mean"), F.count(value_col).alias("n"))
    med = quantiles(df, value_col, [0.5], [group_col]).select(F.col(group_col).alias("_g"), F.col("value").alias("median"))
    return basic.join(med, basic[group_col].eqNullSafe(med["_g"]), "left").drop("_g")


def tertile_cuts(df: DataFrame, value_col: str = "amount") -> tuple[float, float]:
    """The exact 0.33 / 0.66 quantiles (two scalars of bounded size)."""
    rows = {r["q"]: r["value"] for r in quantiles(df, value_col, [0.33, 0.66]).collect()}
    return rows.get(0.33), rows.get(0.66)


def tertile_classes(df: DataFrame, value_col: str = "amount", labels=("low", "mid", "high"),
                    cuts: tuple[float, float] | None = None) -> DataFrame:
    """Classes ``(0, q33]``, ``(q33, q66]``, ``(q66, inf)``; the cut points
    are fitted once (``tertile_cuts``) and applied as literals."""
    q33, q66 = cuts if cuts is not None else tertile_cuts(df, value_col)
    v = F.col(value_col)
    cls = (F.when((v > 0) & (v <= F.lit(q33)), F.lit(labels[0]))
           .when((v > F.lit(q33)) & (v <= F.lit(q66)), F.lit(labels[1]))
           .when(v > F.lit(q66), F.lit(labels[2])))
    return df.withColumn(f"{value_col}_class", cls)


def correlation_with(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Pearson correlation of each feature with the target, one scan,
    sorted by absolute value (descending)."""
    row = df.agg(*[F.corr(F.col(f).cast("double"), F.col(target).cast("double")).alias(f) for f in features])
    long = row.unpivot([], list(features), "feature", "corr")
    return long.orderBy(F.abs("corr").desc_nulls_last(), "feature")


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pairwise Pearson correlations (upper triangle incl. diagonal) in one scan."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    long = row.unpivot([], [f"{a}__{b}" for a, b in pairs], "pair", "corr")
    return long.select(F.split_part("pair", F.lit("__"), F.lit(1)).alias("feature_a"),
                       F.split_part("pair", F.lit("__"), F.lit(2)).alias("feature_b"), "corr")


def top_n(df: DataFrame, col: str, n: int) -> DataFrame:
    """O2: the n most frequent values; ties broken by value (the limit is the
    feature). NULL is no value and takes no place."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(col).asc()).limit(n)


def fold_rare(df: DataFrame, col: str, n: int = 10, other: str = "Other") -> DataFrame:
    """Values outside the top-n -> ``other`` (top list broadcast: at most n rows)."""
    top = top_n(df, col, n).select(F.col(col).alias("_top"))
    return df.join(F.broadcast(top), F.col(col) == F.col("_top"), "left") \
        .withColumn(col, F.when(F.col("_top").isNotNull(), F.col(col).cast("string")).otherwise(F.lit(other))) \
        .drop("_top")


def early_cancellation(df: DataFrame, time_col: str = "observation_time", event_col: str = "event",
                       days: int = 30) -> DataFrame:
    """Early cancellations (event and time <= days) and their shares."""
    ev = F.col(event_col) == 1
    return df.agg(F.count_if(ev & (F.col(time_col) <= days)).alias("early"),
                   F.count_if(ev).alias("cancelled"), F.count(F.lit(1)).alias("total")) \
        .withColumn("pct_of_total", F.col("early") * 100.0 / F.col("total")) \
        .withColumn("pct_of_cancelled", C.safe_pct("early", "cancelled"))


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL count per column, one scan, as ``(column, n_missing)`` rows."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return row.unpivot([], cols, "column", "n_missing")


def grouped_tariff_count(df: DataFrame, month_col: str, tariff_col: str = "amount",
                         factors: dict | None = None) -> DataFrame:
    """A5: counts per (month, amount) times a per-amount factor (a literal map,
    no join)."""
    g = df.groupBy(month_col, tariff_col).agg(F.count(F.lit(1)).alias("n"))
    if factors:
        from decimal import Decimal
        pairs = []
        for k, v in sorted(factors.items()):
            pairs += [F.lit(Decimal(str(k))).cast("decimal(12,2)"), F.lit(float(v))]
        g = g.withColumn("value", F.col("n") * F.try_element_at(
            F.create_map(*pairs), F.round(F.col(tariff_col), 2).cast("decimal(12,2)")))
    return g

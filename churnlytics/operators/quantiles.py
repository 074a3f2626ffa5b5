"""Exact quantiles without holding a group's rows in memory.

``percentile`` keeps every value of a group in one task. Here the rows are
first reduced to a value -> count table (partial aggregation before the
shuffle); ranks come from running sums over *distinct* values and the pandas
rule is applied: linear interpolation between the values at ranks
``floor(h)`` and ``ceil(h)``, ``h = (n - 1) q``.

The distinct values are range-bucketed by approximate quantile cut points (the
bucket count grows with the number of distinct values, ``operators.buckets``);
bucket totals per group locate the bucket of every requested rank, and only
those buckets are ranked, each in its own task. A NULL group is a group.

``approx=True`` switches to ``percentile_approx``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlytics.operators.buckets import bucket_count, cut_points, with_range_bucket
from churnlytics.session import cut_lineage


def _approx(base: DataFrame, value_col: str, qs: list[float], group_cols: Sequence[str], accuracy: int) -> DataFrame:
    agg = base.groupBy(*group_cols).agg(F.percentile_approx(F.col(value_col).cast("double"), qs, accuracy).alias("_v"))
    return agg.select(*group_cols, F.posexplode("_v").alias("_i", "value")) \
              .select(*group_cols, F.element_at(F.array(*[F.lit(q) for q in qs]), F.col("_i") + 1).alias("q"), "value")


def _interpolate(ranked: DataFrame, group_cols: Sequence[str], qs: list[float], hi_col: str, n_col: str) -> DataFrame:
    """From rows (*groups, _x, hi, n) with running counts, the pandas-rule value per (group, q)."""
    per_q = ranked.select("*", F.explode(F.array(*[F.lit(q) for q in qs])).alias("q")) \
        .withColumn("_h", (F.col(n_col) - 1) * F.col("q")) \
        .withColumn("_k0", F.floor("_h")).withColumn("_k1", F.ceil("_h"))
    agg = per_q.groupBy(*group_cols, "q").agg(
        F.min(F.when(F.col(hi_col) > F.col("_k0"), F.col("_x"))).alias("_v0"),
        F.min(F.when(F.col(hi_col) > F.col("_k1"), F.col("_x"))).alias("_v1"),
        F.first("_h").alias("_h"), F.first("_k0").alias("_k0"))
    return agg.select(*group_cols, "q",
                      (F.col("_v0") + (F.col("_h") - F.col("_k0")) * (F.col("_v1") - F.col("_v0"))).alias("value"))


def quantiles(df: DataFrame, value_col: str, qs: Sequence[float], group_cols: Sequence[str] = (),
              approx: bool = False, accuracy: int = 100_000, buckets: int | None = None) -> DataFrame:
    """Rows ``(*group_cols, q, value)``, one per group and requested quantile."""
    qs = [float(q) for q in qs]
    base = df.where(F.col(value_col).isNotNull())
    if approx:
        return _approx(base, value_col, qs, group_cols, accuracy)
    counts = base.groupBy(*group_cols, F.col(value_col).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    # The counts feed the cut points, the totals and the ranking: cut once.
    counts = cut_lineage(counts)
    if not group_cols:
        return _bucketed(counts.withColumn("_g0", F.lit(0)), ["_g0"], qs, buckets).drop("_g0")
    return _bucketed(counts, group_cols, qs, buckets)


def quantiles_of_columns(df: DataFrame, cols: Sequence[str], qs: Sequence[float], approx: bool = False) -> DataFrame:
    """Rows ``(column, q, value)`` for every numeric column of ``cols``, in one
    job chain: all columns' values are counted in one pass as (column, value),
    and one ranking serves every column and quantile. A column without a value
    has no rows."""
    if len(set(cols)) != len(cols):
        raise ValueError("cols name a column twice")
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_value")) for c in cols])
    long = df.select(F.explode(each).alias("_e")).select("_e.column", "_e._value")
    return quantiles(long, "_value", qs, ["column"], approx)


def _same(a: DataFrame, b: DataFrame, cols: Sequence[str], tag: str):
    """``b`` with its ``cols`` renamed by ``tag``, and the null-safe join condition."""
    b = b.select(*[F.col(c).alias(f"{tag}{c}") if c in cols else F.col(c) for c in b.columns])
    cond = F.lit(True)
    for c in cols:
        cond = cond & a[c].eqNullSafe(b[f"{tag}{c}"])
    return b, cond


def _bucketed(counts: DataFrame, group_cols: Sequence[str], qs: list[float], buckets: int | None) -> DataFrame:
    cuts = cut_points(counts, "_x", buckets or bucket_count(counts.count()))
    keyed = with_range_bucket(counts, "_x", cuts, "_b")
    # totals per (group, bucket): at most groups x (len(cuts) + 1) rows
    tot = keyed.groupBy(*group_cols, "_b").agg(F.sum("_c").alias("_bc"))
    wb = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    tot = tot.select(*group_cols, "_b", "_bc", F.sum("_bc").over(wb).alias("_cum"),
                     F.sum("_bc").over(Window.partitionBy(*group_cols)).alias("_n"))
    # buckets holding a requested rank (floor/ceil of (n - 1) q)
    ranks = F.array(*[f((F.col("_n") - 1) * F.lit(q)).cast("long") for q in qs for f in (F.floor, F.ceil)])
    need = tot.where(F.exists(ranks, lambda k: (F.col("_cum") > k) & (F.col("_cum") - F.col("_bc") <= k))) \
              .select(*group_cols, "_b", (F.col("_cum") - F.col("_bc")).alias("_off"), "_n")
    need, same = _same(keyed, need, [*group_cols, "_b"], "_r")
    sel = keyed.join(need, same)
    w = Window.partitionBy(*group_cols, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sel.select(*group_cols, "_x", (F.col("_off") + F.sum("_c").over(w)).alias("_hi"), "_n")
    return _interpolate(ranked, group_cols, qs, "_hi", "_n")


def median(df: DataFrame, value_col: str, group_cols: Sequence[str] = (), approx: bool = False) -> DataFrame:
    return quantiles(df, value_col, [0.5], group_cols, approx).drop("q").withColumnRenamed("value", "median")

"""Mergeable quantile sketches (A18 over any window of months).

One KLL sketch a month and group is made in the scan's own aggregation (partial
sketches merge before the shuffle) and stored; the quantiles of any window come
from merging the stored sketches, so the contracts are read once and a new month
adds its own rows alone. A sketch holds some thousand bytes whatever its rows.

The answer for a quantile is a value of the column whose rank is off by at most
``rank_error(k)`` of the rows with probability 0.99, merged or not; up to ``k``
rows it is exact. The sketches draw at random, so two builds may answer with
different values within that error.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = 800


def rank_error(k: int = K) -> float:
    """The published rank error of a KLL sketch at 99 % (k = 200: 1.33 %)."""
    return 2.296 / k ** 0.9723


def sketches(df: DataFrame, value: str, by: Sequence[str], k: int = K) -> DataFrame:
    """``(*by, sketch, n)``. NULL and NaN values count for nothing; a group that
    has no others gets no row; a NULL in ``by`` is a group."""
    x = F.col(value).cast("double")
    return df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by).agg(
        F.kll_sketch_agg_double(x, k).alias("sketch"), F.count(F.lit(1)).alias("n"))


def store_sketches(made: DataFrame, path: str, batch: str) -> None:
    """Write one delivery; delivered again it replaces itself, so that nothing
    counts twice. A batch's name has no '/'."""
    if "/" in batch:
        raise ValueError("a batch is a plain name")
    made.coalesce(8).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def stored_sketches(spark: SparkSession, path: str) -> DataFrame | None:
    """All deliveries, with their ``batch``; None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def merged(made: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Coarser sketches ``(*by, sketch, n)`` from finer ones; none from none."""
    return made.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n")).where("n > 0")


def quantiles_of(made: DataFrame, qs: Sequence[float]) -> DataFrame:
    """``(..., n, q, value)``, a row a sketch and quantile."""
    rest = [c for c in made.columns if c != "sketch"]
    ranks = F.array(*[F.lit(float(q)) for q in qs])
    return made.select(*rest, F.explode(F.arrays_zip(ranks.alias("q"), F.kll_sketch_get_quantile_double("sketch", ranks)
                                                     .alias("value"))).alias("x")) \
        .select(*rest, F.col("x.q").alias("q"), F.col("x.value").alias("value"))


def in_windows(df: DataFrame, month: str, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """``df`` with ``window``: a row for every window (first, last month, both
    inside) that holds its month. Windows may overlap; a NULL month is in none."""
    marks = F.array(*[F.struct(F.lit(name).alias("window"), F.lit(a).alias("a"), F.lit(z).alias("z"))
                      for name, (a, z) in windows.items()])
    held = F.filter(marks, lambda w: F.col(month).between(w["a"], w["z"]))
    return df.select("*", F.explode(F.transform(held, lambda w: w["window"])).alias("window"))


def window_quantiles(made: DataFrame, month: str, windows: dict[str, tuple[int, int]], qs: Sequence[float],
                     by: Sequence[str] = ()) -> DataFrame:
    """``(window, *by, n, q, value)`` from the sketches of months."""
    return quantiles_of(merged(in_windows(made, month, windows), ["window", *by]), qs)


def rank_errors(df: DataFrame, answers: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """``answers(*by, q, value, ...)`` with ``rank_error``: how far q lies from
    the ranks that the value truly has among the rows of ``df``. Measured on
    distinct values, counted first."""
    x = F.col(value).cast("double")
    counts = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by, x.alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    a = answers.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("q").alias("_q"), F.col("value").alias("_v"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    ranks = counts.join(a, same).groupBy(*[f"_by_{c}" for c in by], "_q", "_v").agg(
        (F.sum(F.when(F.col("_x") < F.col("_v"), F.col("_c")).otherwise(0)) / F.sum("_c")).alias("_lt"),
        (F.sum(F.when(F.col("_x") <= F.col("_v"), F.col("_c")).otherwise(0)) / F.sum("_c")).alias("_le"))
    return ranks.select(*[F.col(f"_by_{c}").alias(c) for c in by], F.col("_q").alias("q"), F.col("_v").alias("value"),
                        F.greatest(F.lit(0.0), F.col("_q") - F.col("_le"), F.col("_lt") - F.col("_q")).alias("rank_error"))

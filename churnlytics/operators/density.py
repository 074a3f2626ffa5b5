"""Smoothed densities (E9, A16): Gaussian kernels over linearly binned counts.

Each value gives its weight to the two grid points around it, in proportion to
its nearness; one aggregation counts them, and the kernels run over the counted
grid, whose size does not depend on the data.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID = 256
REACH = 4.0  # bandwidths beyond the data at either end of the grid


def smoothed_density(df: DataFrame, value_col: str, by: Sequence[str] = (), grid: int = GRID,
                     bandwidth: float | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """``(*by, x, density)`` on ``grid`` points, each group's density integrating
    to 1. Without a ``bandwidth`` each group has its own by Scott's rule
    (population deviation times n^(-1/5); a group without spread takes the
    grid's step). The grid reaches four of the largest bandwidths beyond the
    data unless ``low`` and ``high`` are given; values beyond them count at its
    ends. NULL and non-finite values are not read; a group without values has
    no rows; a NULL group is a group."""
    if grid < 2:
        raise ValueError("grid has two points at least")
    v = F.col(value_col).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(
        *[F.col(b).alias(f"_g{k}") for k, b in enumerate(by)], v.alias("_v"))
    keys = [f"_g{k}" for k in range(len(by))]
    width = F.lit(float(bandwidth)) if bandwidth else F.stddev_pop("_v") * F.pow(F.count("_v"), F.lit(-0.2))
    about = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), width.alias("_h"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ends = about.agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), F.max("_h").alias("h")).first()
    if ends["lo"] is None:
        return rows.limit(0).select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)],
                                    F.col("_v").alias("x"), F.col("_v").alias("density"))
    lo = ends["lo"] - REACH * ends["h"] if low is None else float(low)
    hi = ends["hi"] + REACH * ends["h"] if high is None else float(high)
    hi = hi if hi > lo else lo + 1.0
    step = (hi - lo) / (grid - 1)
    at = F.least(F.greatest((F.col("_v") - lo) / step, F.lit(0.0)), F.lit(grid - 1.0))
    left = F.least(F.floor("_at"), F.lit(grid - 2))
    share = F.col("_at") - left
    both = F.array(F.struct(left.alias("j"), (F.lit(1.0) - share).alias("w")), F.struct((left + 1).alias("j"), share.alias("w")))
    counted = (rows.withColumn("_at", at).select(*keys, F.explode(both).alias("_p")).select(*keys, "_p.*")
               .groupBy(*keys, "j").agg(F.sum("w").alias("w")))
    same = F.lit(True)
    for k in keys:
        same = same & counted[k].eqNullSafe(about[k])
    spread = F.when(F.col("_h") > 0, F.col("_h")).otherwise(F.lit(step))
    # groups x grid rows meet every grid point: bounded by the grid
    wide = counted.join(about, same).select(*[counted[k] for k in keys], "j", "w", "_n", spread.alias("_h"),
                                            F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
    z = (F.col("i") - F.col("j")) * step / F.col("_h")
    kernel = F.exp(-z * z / 2) / (F.col("_h") * F.col("_n") * math.sqrt(2 * math.pi))
    out = wide.groupBy(*keys, "i").agg(F.sum(F.col("w") * kernel).alias("density"))
    return out.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)],
                      (F.lit(lo) + F.col("i") * step).alias("x"), "density")

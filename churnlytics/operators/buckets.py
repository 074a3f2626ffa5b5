"""Range buckets over distinct values, sized to the data.

Used by the distributed prefix sum (E4-E6) and by exact quantiles on columns
with many distinct values: the number of buckets grows with the number of
distinct values so every bucket - ranked by a window in one task - holds about
``per_bucket`` values, whatever the data size. Cut points are approximate
quantiles (collected once: one double per bucket) and are applied with
``Bucketizer`` (a JVM binary search), so a recomputed task puts every value
in the same bucket.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PER_BUCKET = 1_000_000


def bucket_count(n_distinct: int, minimum: int = 64, per_bucket: int = PER_BUCKET) -> int:
    return int(max(minimum, math.ceil(n_distinct / per_bucket)))


def cut_points(df: DataFrame, col: str, buckets: int) -> list[float]:
    """Strictly increasing inner cut points (approximate quantiles of ``col``)."""
    if buckets <= 1:
        return []
    probs = [i / buckets for i in range(1, buckets)]
    rel = min(0.001, 0.5 / buckets)
    return sorted(set(float(v) for v in df.approxQuantile(col, probs, rel)))


def with_range_bucket(df: DataFrame, col: str, cuts: list[float], out: str = "_b") -> DataFrame:
    """Bucket index 0..len(cuts) (values equal to a cut go to the upper bucket)."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    splits = [-math.inf] + cuts + [math.inf]
    tmp = f"{out}_d"
    b = Bucketizer(splits=splits, inputCol=col, outputCol=tmp, handleInvalid="keep")
    return b.transform(df).withColumn(out, F.col(tmp).cast("int")).drop(tmp)


def running_sums(df: DataFrame, order: str, cols: list[str], descending: bool, bucket: str = "bucket") -> DataFrame:
    """``df`` (one row per value of ``order``) with ``cols`` replaced by their
    running sums in that order, this row included: sums inside the range
    buckets plus the totals of the buckets before (one row per bucket)."""
    tot = df.groupBy(bucket).agg(*[F.sum(c).alias(f"_t{k}") for k, c in enumerate(cols)])
    at = F.col(bucket).desc() if descending else F.col(bucket)
    before = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    offsets = tot.select(F.col(bucket).alias("_bucket"),
                         *[F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_o{k}") for k in range(len(cols))])
    inside = Window.partitionBy(bucket).orderBy(F.col(order).desc() if descending else F.col(order)) \
        .rowsBetween(Window.unboundedPreceding, 0)
    # one row per bucket, and a bucket per million values (or 64)
    out = df.join(F.broadcast(offsets), df[bucket] == offsets["_bucket"], "left")
    sums = {c: F.col(f"_o{k}") + F.sum(c).over(inside) for k, c in enumerate(cols)}
    return out.select(*[sums[c].alias(c) if c in sums else df[c] for c in df.columns])

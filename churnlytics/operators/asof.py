"""As-of lookups on Spark: each row meets the curve point before its time, or
the nearest one, of its own stratum.

The points of a stratum become half-open intervals, spread over time buckets
of a fixed width; rows and intervals meet by an equi-join on stratum and
bucket with a range condition inside. A point list of a counted size is
broadcast, so that the rows are not shuffled; beyond it adaptive execution can
split a hot bucket, as a row needs no other row.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_POINTS = 1_000_000


def as_of_join(rows: DataFrame, points: DataFrame, time: str, point_time: str, by: Sequence[str] = (),
               values: Sequence[str] = (), direction: str = "backward", width: float = 64.0,
               broadcast_points: int = BROADCAST_POINTS) -> DataFrame:
    """``rows`` with the ``values`` of one point: the last at or before
    ``time`` (``backward``) or the nearest (``nearest``, of two equally near the
    earlier). ``by`` names the stratum columns of both sides; NULL is no
    stratum. Rows without a point, or with a NULL time, get NULL values.
    Several points of a stratum at one time: the query fails if they differ in
    ``values``, else they are one. ``width`` is the bucket's, in time units."""
    if direction not in ("backward", "nearest"):
        raise ValueError("direction is 'backward' or 'nearest'")
    clash = set(values) & set(rows.columns)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    keys = [f"_k{i}" for i in range(len(by))]
    p = points.where(F.col(point_time).isNotNull()).select(
        *[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(point_time).cast("double").alias("_t"),
        F.struct(*[F.col(v) for v in values]).alias("_v")).distinct()
    part = Window.partitionBy(*keys).orderBy("_t")
    after, before = F.lead("_t").over(part), F.lag("_t").over(part)
    twice = F.when(before == F.col("_t"), F.raise_error(F.lit("as_of_join: points that differ at one time")).cast("double"))
    lo, hi = (F.col("_t"), after) if direction == "backward" else ((before + F.col("_t")) / 2, (F.col("_t") + after) / 2)
    p = p.select(*keys, "_v", F.coalesce(twice, lo).alias("_lo"), hi.alias("_hi"))
    # Open ends reach as far as the rows do.
    span = rows.agg(F.min(F.col(time).cast("double")).alias("a"), F.max(F.col(time).cast("double")).alias("z")).first()
    a, z = (float(span["a"]), float(span["z"])) if span["a"] is not None else (0.0, 0.0)
    first = F.greatest(F.coalesce("_lo", F.lit(a)), F.lit(a))
    last = F.least(F.coalesce("_hi", F.lit(z)), F.lit(z))
    p = p.where(first <= last).withColumn(
        "_b", F.explode(F.sequence(F.floor(first / width), F.floor(last / width))))
    if p.count() <= broadcast_points:
        p = F.broadcast(p)
    t = F.col(time).cast("double")
    meets = F.floor(t / width) == F.col("_b")
    for b, k in zip(by, keys, strict=True):
        meets = meets & (rows[b] == F.col(k))
    if direction == "backward":  # [lo, hi)
        meets = meets & (t >= F.col("_lo")) & (F.col("_hi").isNull() | (t < F.col("_hi")))
    else:  # (lo, hi]
        meets = meets & (F.col("_lo").isNull() | (t > F.col("_lo"))) & (F.col("_hi").isNull() | (t <= F.col("_hi")))
    return rows.join(p, meets, "left").select(*[rows[c] for c in rows.columns], *[F.col("_v")[v].alias(v) for v in values])

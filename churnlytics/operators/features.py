"""Feature preparation.

Fitted state (medians, means, standard deviations, vocabularies, class
weights) is computed on the training rows only and applied as literals or
Spark ML models, so test rows never leak into the fit.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlytics.operators.quantiles import quantiles_of_columns
from churnlytics.session import cut_lineage

HASH_BITS_BUCKET = 20
FOLD_BITS = 14


def id_hash(id_col: str = "id") -> Column:
    """32-bit deterministic hash of the id: first 8 hex digits of md5."""
    return F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long")


def stratified_split(df: DataFrame, label_col: str = "event", train_fraction: float = 0.8,
                     id_col: str = "id") -> DataFrame:
    """Deterministic stratified split; adds ``split`` in {train, test}.

    Within each class the rows are ordered by (hash(id), id); the first
    ``floor(train_fraction * n_class)`` are train. Exact and scalable:

    1. counts per (class, top-20-bit hash bucket) - a partial aggregate of at
       most 2^20 rows per class;
    2. a running sum over that small table finds, per class, the boundary
       bucket and how many of its rows still go to train;
    3. the few rows of the boundary buckets (~ n / 2^20 per class) are ranked
       in that same scan's small result and give, per class, the last
       (hash, id) of the training rows;
    4. every row is labelled by comparing with it (map-side; the table of
       bounds is broadcast - one row per class).

    The source is scanned twice: for (label, id, hash), checkpointed, and for
    the labels. A NULL label is a class of its own: every row comes out once.
    """
    df = df.withColumn("_h", id_hash(id_col))
    rows = cut_lineage(df.select(label_col, id_col, "_h", F.shiftright(F.col("_h"), 32 - HASH_BITS_BUCKET).alias("_b")))
    counts = rows.groupBy(label_col, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(label_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.select(label_col, "_b", "_c", F.sum("_c").over(w).alias("_cum"),
                        F.sum("_c").over(Window.partitionBy(label_col)).alias("_n"))
    cum = cum.withColumn("_k", F.floor(F.col("_n") * F.lit(train_fraction)))
    # Boundary bucket: first bucket whose running count reaches k (k may be 0).
    boundary = cum.where(F.col("_cum") >= F.col("_k")).groupBy(label_col).agg(
        F.min_by(F.struct("_b", (F.col("_k") - (F.col("_cum") - F.col("_c"))).alias("_rem")), "_b").alias("_x"))
    boundary = boundary.select(label_col, F.col("_x._b").alias("_bb"), F.col("_x._rem").alias("_rem"))
    boundary = boundary.withColumnRenamed(label_col, "_class")
    inside = rows.join(F.broadcast(boundary), rows[label_col].eqNullSafe(boundary["_class"]) & (F.col("_b") == F.col("_bb")))
    rn = F.row_number().over(Window.partitionBy(label_col).orderBy("_h", id_col))
    last = (inside.withColumn("_rn", rn).where(F.col("_rn") <= F.col("_rem")).groupBy(label_col)
            .agg(F.max(F.struct("_h", F.col(id_col).alias("_id"))).alias("_last")))
    # Without a training row in the boundary bucket, all buckets below it are training.
    bounds = (boundary.join(last, boundary["_class"].eqNullSafe(last[label_col]), "left").drop(label_col)
              .withColumn("_first", F.shiftleft(F.col("_bb"), 32 - HASH_BITS_BUCKET)))
    j = df.join(F.broadcast(bounds), df[label_col].eqNullSafe(bounds["_class"]), "left")
    train = F.when(F.col("_last").isNull(), F.col("_h") < F.col("_first")) \
             .otherwise(F.struct("_h", F.col(id_col).alias("_id")) <= F.col("_last"))
    return j.withColumn("split", F.when(train, F.lit("train")).otherwise(F.lit("test"))).select(
        *[F.col(f"`{c}`") for c in df.columns if c != "_h"], "split")


def stratified_folds(df: DataFrame, folds: int = 5, label_col: str = "event", id_col: str = "id",
                     seed: int = 0, out: str = "fold") -> DataFrame:
    """``df`` with a fold 0 .. ``folds`` - 1; within each class the
    folds' sizes differ by one at most.

    A row's fold is its place among its class, ordered by (hash of the id and
    the seed, id), modulo ``folds``. The place is the number of rows in lower
    hash buckets (2^14 a class, counted once) plus the place within the bucket,
    so no task ranks a whole class. A NULL label is a class of its own; rows
    that repeat an id are dealt one by one."""
    h = id_hash(id_col) if seed == 0 else F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))),
                                                             1, 8), 16, 10).cast("long")
    rows = df.withColumn("_h", h).withColumn("_b", F.shiftright("_h", 32 - FOLD_BITS))
    counts = rows.groupBy(F.col(label_col).alias("_class"), F.col("_b").alias("_cb")).agg(F.count(F.lit(1)).alias("_c"))
    below = Window.partitionBy("_class").orderBy("_cb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_class", "_cb", F.coalesce(F.sum("_c").over(below), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(label_col, "_b").orderBy("_h", id_col)
    # at most 2^14 rows a class
    placed = rows.withColumn("_n", F.row_number().over(inside)).join(
        F.broadcast(offsets), rows[label_col].eqNullSafe(offsets["_class"]) & rows["_b"].eqNullSafe(offsets["_cb"]))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns],
                         F.pmod(F.col("_o") + F.col("_n") - 1, F.lit(folds)).cast("int").alias(out))


def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict:
    """Exact medians (value-count method) of the given columns - scalars;
    one job chain for all columns, None for a column without values."""
    found = {r["column"]: r["value"] for r in quantiles_of_columns(df, cols, [0.5]).collect()} if cols else {}
    return {c: found.get(c) for c in cols}


def impute(df: DataFrame, values: dict) -> DataFrame:
    """Fill NULLs with fitted medians or constants (``missing``, ``unknown``)."""
    return df.na.fill({k: v for k, v in values.items() if v is not None})


def fit_standardizer(df: DataFrame, cols: Sequence[str]) -> dict:
    """Mean and population std per column, one scan (``StandardScaler``
    would use the sample std)."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def standardize(df: DataFrame, stats: dict, suffix: str = "") -> DataFrame:
    """``(x - mean) / std``; a zero std gives 0."""
    cols = {}
    for c, (m, s) in stats.items():
        cols[c + suffix] = F.when(F.lit(s) > 0, (F.col(c) - F.lit(m)) / F.lit(s)).otherwise(F.lit(0.0)) \
            if s else F.lit(0.0)
    return df.withColumns(cols)


def fit_vocabulary(df: DataFrame, col: str, max_categories: int | None = None, limit: int = 10_000) -> list:
    """Sorted category list from the training rows (optionally the most
    frequent ``max_categories``; NULL is no category). The list becomes
    columns; more than ``limit`` categories raise."""
    df = df.where(F.col(col).isNotNull())
    if max_categories:
        vals = [r[0] for r in df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
                .orderBy(F.col("n").desc(), F.col(col)).limit(max_categories).collect()]
    else:
        vals = [r[0] for r in df.select(col).distinct().limit(limit + 1).collect()]
        if len(vals) > limit:
            raise ValueError(f"{col!r} has more than {limit} categories")
    return sorted(vals)


def one_hot(df: DataFrame, col: str, vocabulary: Sequence, drop_first: bool = False, prefix: str | None = None) -> DataFrame:
    """One indicator column per vocabulary entry; unknown -> all zero."""
    prefix = prefix or col
    vocab = list(vocabulary)[1:] if drop_first else list(vocabulary)
    return df.withColumns({f"{prefix}_{v}": (F.col(col) == F.lit(v)).cast("int") for v in vocab})


def variance_filter(df: DataFrame, cols: Sequence[str], threshold: float = 0.01) -> DataFrame:
    """Population variance per column (one scan) and whether it is kept."""
    row = df.agg(*[F.var_pop(F.col(c).cast("double")).alias(c) for c in cols])
    long = row.unpivot([], list(cols), "feature", "variance")
    return long.withColumn("kept", F.col("variance") > threshold)


def correlated_pairs(corr_pairs: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Pairs of different features with |r| above the threshold (from the
    small pair table of ``rates.correlation_matrix``); ``feature_b`` is the
    later column, the one to drop."""
    return corr_pairs.where((F.col("feature_a") != F.col("feature_b")) & (F.abs("corr") > threshold))


def correlated_to_drop(corr_pairs: DataFrame, threshold: float = 0.95) -> list[str]:
    """The later column of every pair with |r| > threshold (a few names)."""
    return sorted({r["feature_b"] for r in correlated_pairs(corr_pairs, threshold).collect()})


def class_weights(df: DataFrame, label_col: str = "event") -> DataFrame:
    """Balanced weights ``n / (k * n_c)`` per class."""
    g = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_class"))
    w = Window.partitionBy()
    return g.withColumn("weight", F.sum("n_class").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_class")))


def with_class_weight(df: DataFrame, weights: DataFrame, label_col: str = "event") -> DataFrame:
    """Attach the class weight (one row per class: broadcast)."""
    return df.join(F.broadcast(weights.select(label_col, "weight")), label_col, "left")

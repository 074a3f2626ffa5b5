"""Shared helpers of the operators: reading tables, cutting lineage through the
cluster's shared folder, and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlytics.session import checkpoint_dir

# Words of the contracts: digits, letters and everything beyond ASCII, after
# lower-casing A-Z only.
WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: the lineage is cut, a lost executor loses nothing, and later joins
    see the table's real size. The folder's owner clears it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def neutral(df: DataFrame) -> DataFrame:
    """``df`` with its columns called c0, c1, ..., so that none can clash with a
    column that an operator adds; ``toDF`` with the old names undoes it."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def filter_ids(df: DataFrame, ids: DataFrame, id_col: str, keep: bool = True, most: int = 2_000_000) -> DataFrame:
    """The rows of ``df`` whose id is in ``ids(id)`` (or, without ``keep``, is
    not; null ids are in none). Up to ``most`` ids, counted first, are
    broadcast, so that texts are not shuffled; beyond that both sides are."""
    ids = ids.select(F.col("id").alias("_wanted_id"))
    if ids.count() <= most:
        ids = F.broadcast(ids)
    return df.join(ids, df[id_col] == ids["_wanted_id"], "left_semi" if keep else "left_anti")


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(node, component)`` for every node of ``edges(src, dst)`` (longs);
    ``component`` is the smallest node that links reach.

    Alternating star contraction: each round joins every node to the smallest
    neighbour seen, once towards larger and once towards smaller neighbours, so
    the number of rounds grows with the logarithm of the longest chain. The
    minima are partial aggregates; a hub with very many neighbours is met by a
    sort-merge join that adaptive execution can split. Empty edges give an
    empty result. Raises if ``max_rounds`` do not suffice.
    """
    e = store(edges.where("src <> dst")
              .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    state = None
    for _ in range(max_rounds):
        # Towards larger neighbours: all b > a of node u hang on u's minimum.
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct())
        # Towards smaller neighbours: all of u's smaller neighbours hang on the least.
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = (large.withColumnRenamed("b", "u").join(low, "u")
                 .select(F.col("m").alias("x"), F.explode(F.array("a", "u")).alias("y"))
                 .where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        e = store(small)
        row = e.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == (row["n"], row["s"]):
            return (e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
                    .union(e.select("a", "a").distinct()))
        state = (row["n"], row["s"])
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

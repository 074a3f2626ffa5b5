"""Contract sources and result sinks.

* S1  partitioned JDBC scan (filters and column pruning reach the database).
* S3/S4  CSV (``;`` separated, decimal comma tolerated) and Parquet scans with
  an explicit schema, column names normalised with ``ALIASES`` (P22).
* S2/S5  CSV / Parquet sinks written by the executors, never via the driver.
* S6  a settlement run's named tables written as one directory each, under a
  run of their own that appears with its manifest, or not at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlytics.schema import ALIASES


def normalize_columns(df: DataFrame, aliases: dict | None = None) -> DataFrame:
    """Rename source-system column names to engine names."""
    aliases = ALIASES if aliases is None else aliases
    mapping = {c: aliases[c] for c in df.columns if c in aliases and aliases[c] != c}
    return df.withColumnsRenamed(mapping) if mapping else df


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              lower_bound: int | None = None, upper_bound: int | None = None,
              num_partitions: int = 64, fetchsize: int = 10_000, properties: dict | None = None) -> DataFrame:
    """Partitioned JDBC scan; ``fetchsize`` replaces the 1000-row fetch loop."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table) \
        .option("fetchsize", fetchsize)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", lower_bound).option("upperBound", upper_bound)
                  .option("numPartitions", num_partitions))
    return normalize_columns(reader.load())


def read_csv(spark: SparkSession, path: str, schema=None, sep: str = ";", header: bool = True) -> DataFrame:
    """``;``-separated CSV. Without a schema every column is read as a string
    and cleaned later with the lenient parsers (P7-P9)."""
    reader = spark.read.option("sep", sep).option("header", header)
    if schema is not None:
        reader = reader.schema(schema)
    return normalize_columns(reader.csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S3 (re-aimed from spreadsheets): columnar scan with pushdown."""
    return normalize_columns(spark.read.parquet(path))


def write_csv(df: DataFrame, path: str, sep: str = ";", mode: str = "overwrite") -> None:
    """``;`` delimited, header, minimal quoting; written by the executors."""
    df.write.mode(mode).option("sep", sep).option("header", True).option("quoteAll", False).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    """Parquet sink."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_tables(tables: dict[str, DataFrame], base_path: str, fmt: str = "parquet") -> dict[str, str]:
    """Write each named result table to ``base_path/<name>``; returns the paths."""
    paths = {}
    for name, df in tables.items():
        safe = "".join(ch if ch.isalnum() or ch in "_-" else "_" for ch in name)
        path = f"{base_path.rstrip('/')}/{safe}"
        if fmt == "csv":
            write_csv(df, path)
        else:
            write_parquet(df, path)
        paths[name] = path
    return paths


def publish_tables(tables: dict[str, DataFrame], base_path: str, run: str | None = None, fmt: str = "parquet") -> str:
    """Write the named tables as one run and return its id.

    Every table goes to ``base_path/runs/<run>/<name>``; the manifest (run, name,
    path, format, time) is one small file written after all of them, so that
    ``published_tables`` sees a whole run or the one before it. A run that dies
    leaves no manifest, and nothing that readers look at is overwritten. A run
    id can be used once."""
    run = run or uuid.uuid4().hex
    base = base_path.rstrip("/")
    spark = next(iter(tables.values())).sparkSession
    if any(r["run"] == run for r in _manifests(spark, base).select("run").distinct().collect()):
        raise ValueError(f"run {run!r} is published")
    paths = write_tables(tables, f"{base}/runs/{run}", fmt)
    rows = spark.createDataFrame([(run, n, p, fmt) for n, p in paths.items()], "run string, name string, path string, format string")
    # One file of one task: its commit is a rename, whole or not there.
    rows.withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{base}/manifest")
    return run


MANIFEST = "run string, name string, path string, format string, published_at timestamp"


def _manifests(spark: SparkSession, base: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{base}/manifest")


def published_tables(spark: SparkSession, base_path: str, run: str | None = None) -> dict[str, DataFrame]:
    """The tables of a published run, the latest without ``run``; raises if
    there is none."""
    rows = _manifests(spark, base_path.rstrip("/"))
    if run is None:
        last = rows.orderBy(F.desc("published_at"), "run").first()
        run = last["run"] if last else None
    found = rows.where(F.col("run") == F.lit(run)).collect()  # a row for each table
    if not found:
        raise FileNotFoundError(f"no published run {run or ''} under {base_path}")
    return {r["name"]: read_csv(spark, r["path"]) if r["format"] == "csv" else spark.read.parquet(r["path"]) for r in found}


def lenient_contracts(df: DataFrame) -> DataFrame:
    """Clean a string-typed contract frame with the lenient parsers."""
    from churnlytics.functions import columns as C
    out = df
    if "amount" in df.columns:
        out = out.withColumn("amount", C.lenient_double("amount"))
    if "deletion_type" in df.columns:
        out = out.withColumn("deletion_type", C.deletion_type("deletion_type"))
    for c in ("start_insurance", "end_insurance", "first_due_date", "last_due_date",
              "deletion_allowed_at", "promised_deletion_date", "report_date", "birthday"):
        if c in df.columns:
            out = out.withColumn(c, C.lenient_date(c))
    for c in ("acq_month", "del_month", "product_code"):
        if c in df.columns:
            out = out.withColumn(c, F.col(c).cast("string").try_cast("int"))
    return out

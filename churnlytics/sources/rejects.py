"""Cleaning that tells what it could not read.

The lenient parsers turn a bad value into NULL (or type 0). ``clean_contracts``
does the same and says which values were bad, from the same pass over the
rows: each row carries the list of its rejected values.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlytics.functions import columns as C
from churnlytics.sources.files import normalize_columns

REJECTED = "_rejected"
CORRUPT = "_corrupt_record"
NUMBERS = ("amount",)
TYPES = ("deletion_type",)
DATES = ("start_insurance", "end_insurance", "first_due_date", "last_due_date",
         "deletion_allowed_at", "promised_deletion_date", "report_date", "birthday")
INTEGERS = ("acq_month", "del_month", "product_code")


def _checked(name: str, kind: str) -> tuple[Column, Column]:
    """(value, reason or NULL). An absent or blank value is no reject."""
    raw = F.col(f"`{name}`").cast("string")
    parsed = {"number": C.lenient_double, "date": C.lenient_date,
              "type": lambda c: C._c(c).cast("string").try_cast("double").try_cast("int"),
              "integer": lambda c: C._c(c).cast("string").try_cast("int")}[kind](name)
    bad = raw.isNotNull() & (F.trim(raw) != "") & parsed.isNull()
    value = F.coalesce(parsed, F.lit(0)) if kind == "type" else parsed
    return value, F.when(bad, F.lit(f"not a {kind}" if kind != "integer" else "not an integer"))


def clean_contracts(df: DataFrame, numbers: Sequence[str] = NUMBERS, types: Sequence[str] = TYPES,
                    dates: Sequence[str] = DATES, integers: Sequence[str] = INTEGERS) -> DataFrame:
    """``df`` with its columns parsed (those that it has) and ``_rejected``, an
    array of (column, value, reason) of the values that could not be read;
    empty where all could. A row of a corrupt CSV line has that as its reject."""
    kinds = {**dict.fromkeys(numbers, "number"), **dict.fromkeys(types, "type"), **dict.fromkeys(dates, "date"),
             **dict.fromkeys(integers, "integer")}
    parsed, found = {}, []
    for name, kind in kinds.items():
        if name in df.columns:
            parsed[name], reason = _checked(name, kind)
            found.append(F.when(reason.isNotNull(), F.struct(
                F.lit(name).alias("column"), F.col(f"`{name}`").cast("string").alias("value"), reason.alias("reason"))))
    if CORRUPT in df.columns:
        found.append(F.when(F.col(CORRUPT).isNotNull(), F.struct(
            F.lit(CORRUPT).alias("column"), F.col(CORRUPT).alias("value"), F.lit("not a line of the table").alias("reason"))))
    empty = F.array().cast("array<struct<column:string,value:string,reason:string>>")
    rejected = F.array_compact(F.array(*found)) if found else empty
    return df.select(*[parsed[c].alias(c) if c in parsed else F.col(f"`{c}`") for c in df.columns if c != CORRUPT],
                     rejected.alias(REJECTED))


def rejects(cleaned: DataFrame, id_cols: Sequence[str] = ("id",)) -> DataFrame:
    """``(*id_cols, column, value, reason)``, a row for each rejected value."""
    return cleaned.select(*id_cols, F.explode(REJECTED).alias("_r")).select(*id_cols, "_r.*")


def reject_counts(cleaned: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, accepted, rejected, missing)`` in one pass: they add up to the
    rows. ``missing`` counts NULL results that no reject explains; a type's 0
    for a missing value counts as accepted."""
    def has(c):
        return F.exists(REJECTED, lambda r: r["column"] == F.lit(c))

    aggs = []
    for k, c in enumerate(columns):
        bad = has(c)
        aggs += [F.count_if(bad).alias(f"r{k}"), F.count_if(~bad & F.col(f"`{c}`").isNull()).alias(f"m{k}")]
    row = cleaned.agg(F.count(F.lit(1)).alias("n"), *aggs)
    each = [F.struct(F.lit(c).alias("column"), (F.col("n") - F.col(f"r{k}") - F.col(f"m{k}")).alias("accepted"),
                     F.col(f"r{k}").alias("rejected"), F.col(f"m{k}").alias("missing")) for k, c in enumerate(columns)]
    return row.select(F.explode(F.array(*each)).alias("s")).select("s.*")


def read_csv_with_rejects(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ";", **kinds) -> DataFrame:
    """``clean_contracts`` of a ``;``-separated file with the given columns
    (its header's, in their order). Lines with too few or too many fields come
    back with what could be read and the line among their rejects."""
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in columns], T.StructField(CORRUPT, T.StringType())])
    raw = (spark.read.option("sep", sep).option("header", True).option("mode", "PERMISSIVE")
           .option("enforceSchema", True).option("columnNameOfCorruptRecord", CORRUPT).schema(schema).csv(path))
    return clean_contracts(normalize_columns(raw), **kinds)

"""Rejected values, and runs of tables that appear whole."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from churnlytics.operators.commission import call_center_result
from churnlytics.operators.settlement import settlement_result
from churnlytics.sources import (clean_contracts, publish_tables, published_tables, read_csv_with_rejects, reject_counts,
                                 rejects)

ROWS = [(1, "1,5", "3.0", "2024-01-31"), (2, "abc", "?", "31.31.2024"), (3, None, None, None), (4, " ", "", "2024-02-30"),
        (5, "7.25 ", "0", "2024-01-31 10:00:00")]


def test_every_bad_value_is_told(spark):
    df = spark.createDataFrame(ROWS, "id int, amount string, deletion_type string, start_insurance string")
    cleaned = clean_contracts(df)
    assert [(r["amount"], r["deletion_type"]) for r in cleaned.orderBy("id").collect()] == [
        (1.5, 3), (None, 0), (None, 0), (None, 0), (7.25, 0)]
    got = {tuple(r) for r in rejects(cleaned).collect()}
    assert got == {(2, "amount", "abc", "not a number"), (2, "deletion_type", "?", "not a type"),
                   (2, "start_insurance", "31.31.2024", "not a date"), (4, "start_insurance", "2024-02-30", "not a date")}
    counts = {r["column"]: tuple(r)[1:] for r in reject_counts(cleaned, ["amount", "deletion_type", "start_insurance"]).collect()}
    assert counts == {"amount": (2, 1, 2), "deletion_type": (4, 1, 0), "start_insurance": (2, 2, 1)}
    assert all(sum(c) == len(ROWS) for c in counts.values())
    assert rejects(clean_contracts(df.limit(0))).count() == 0


def test_corrupt_lines_are_kept_apart(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("id;amount;deletion_type\n1;2,5;0\n2;3\n3;x;1;surplus\n")
    cleaned = read_csv_with_rejects(spark, str(path), ["id", "amount", "deletion_type"])
    got = {(r["id"], r["column"], r["value"]) for r in rejects(cleaned).collect()}
    assert cleaned.count() == 3
    assert got == {("2", "_corrupt_record", "2;3"), ("3", "amount", "x"), ("3", "_corrupt_record", "3;x;1;surplus")}


def test_a_run_that_dies_leaves_the_former_one(spark, tmp_path):
    base = str(tmp_path / "book")
    a, b = spark.range(3), spark.range(5).withColumn("x", F.lit("y"))
    with pytest.raises(FileNotFoundError):
        published_tables(spark, base)
    first = publish_tables({"a": a, "b": b}, base)
    bad = spark.range(3).select(F.raise_error(F.lit("dies")).cast("long").alias("id"))
    with pytest.raises(PySparkException, match="dies"):
        publish_tables({"a": spark.range(9), "b": bad}, base, run="half")
    now = published_tables(spark, base)
    assert (now["a"].count(), now["b"].count()) == (3, 5)
    with pytest.raises(FileNotFoundError):
        published_tables(spark, base, "half")
    second = publish_tables({"a": spark.range(7)}, base, fmt="csv")
    assert published_tables(spark, base)["a"].count() == 7
    assert published_tables(spark, base, first)["b"].count() == 5
    with pytest.raises(ValueError, match="published"):
        publish_tables({"a": a}, base, run=second)


def test_money_of_an_unlisted_call_center_is_not_lost(spark):
    from churnlytics.plans.common import PARAMS, contracts
    df = contracts(spark, "/root/testdata/sf0.001")
    stray = df.withColumn("campaign", F.when(F.col("id") % 50 == 0, F.lit("ZZ-ITM")).otherwise(F.col("campaign")))
    with pytest.raises(PySparkException, match="no column for the call center"):
        settlement_result(stray, PARAMS).collect()
    with pytest.raises(PySparkException, match="no column for the key"):
        call_center_result(stray, ["FO", "JD", "TS", "M3"], others="raise").collect()
    assert any(c.startswith("ZZ") for c in call_center_result(stray).columns)

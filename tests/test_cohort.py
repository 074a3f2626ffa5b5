"""Cohort helpers: gap markers, month union, pivot-key size check, weighted counts."""

import pytest
from pyspark.sql import functions as F

from churnlytics.operators import cohort as K


def test_with_gap_markers_per_group(spark):
    long = spark.createDataFrame([(202111, "a_w", 1.0), (202202, "a_w", 2.0), (202105, "other", 3.0)],
                                 "month int, measure string, value double")
    grp = F.when(F.col("measure").endswith("_w"), F.lit("w"))
    rows = K.with_gap_markers(long, "month", "measure", "value", grp).collect()
    markers = sorted(r["month"] for r in rows if r["measure"] == "_month")
    assert markers == [202111, 202112, 202201, 202202]  # only the grouped rows' range, across a year end
    assert sum(r["value"] for r in rows) == 6.0


def test_gap_fill_months_fills_values(spark):
    df = spark.createDataFrame([(202110, 5), (202201, 7)], "m int, n long")
    rows = {r["m"]: r["n"] for r in K.gap_fill_months(df, "m", 0).collect()}
    assert rows == {202110: 5, 202111: 0, 202112: 0, 202201: 7}


def test_months_of_one_pass(spark):
    df = spark.createDataFrame([(202101, None), (202102, 202101), (None, 202105)], "a int, b int")
    assert sorted(r["month"] for r in K.months_of(df, ["a", "b"]).collect()) == [202101, 202102, 202105]


def test_pivot_keys_size_check(spark):
    df = spark.range(50).withColumn("k", F.col("id").cast("string"))
    with pytest.raises(ValueError, match="distinct values"):
        K.distinct_values(df, "k", limit=10)


def test_weighted_cohort_equals_row_counts(spark):
    rows = spark.createDataFrame([(202101, "x", 1), (202101, "x", 2), (202102, "y", 1)],
                                 "acq_month int, campaign string, deletion_type int")
    base = rows.groupBy("acq_month", "campaign", "deletion_type").count().withColumnRenamed("count", "n")
    a = K.cohort_matrix(rows, keys=["x", "y"], deletion_types=[1]).collect()
    b = K.cohort_matrix(base, keys=["x", "y"], deletion_types=[1], weight="n").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_unlisted_pivot_key_fails(spark):
    df = spark.createDataFrame([(202101, "x", 1), (202101, "new", 1), (202101, None, 1)],
                               "acq_month int, campaign string, deletion_type int")
    with pytest.raises(Exception, match="no column for the key new"):
        K.cohort_matrix(df, keys=["x"]).collect()
    assert set(K.cohort_matrix(df).columns) == {"acq_month", "x", "new"}

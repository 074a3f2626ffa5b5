"""Golden values of the scalar rules (FIXTURES §3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from churnlytics.functions import columns as C
from churnlytics.operators.commission import premium_clawback_value, premium_value
from churnlytics.operators.settlement import clawback_factor, tariff
from churnlytics.schema import SettlementParams


def one(spark, expr, row, schema):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("first,last,expected", [
    (dt.date(2021, 1, 31), dt.date(2021, 2, 28), 1),
    (dt.date(2021, 1, 15), dt.date(2021, 3, 15), 3),
    (dt.date(2021, 3, 1), dt.date(2021, 2, 1), 0),
    (None, dt.date(2021, 2, 1), 0),
])
def test_month_span(spark, first, last, expected):
    assert one(spark, C.month_span("a", "b"), (first, last), "a date, b date") == expected


@pytest.mark.parametrize("a,b,expected", [("202105", "202201", 8), ("202112", "202113", 1), ("x", "202201", -1)])
def test_month_diff(spark, a, b, expected):
    assert one(spark, C.month_diff("a", "b"), (a, b), "a string, b string") == expected


def test_deletion_month(spark):
    d = dt.date(2021, 12, 10)
    assert one(spark, C.deletion_month("d"), (d,), "d date") == 202201
    assert one(spark, C.deletion_month("d", legacy_month13=True), (d,), "d date") == 202113


@pytest.mark.parametrize("raw,expected", [("9,9", 9.9), ("abc", None), (" 14.9 ", 14.9)])
def test_lenient_number(spark, raw, expected):
    assert one(spark, C.lenient_double("s"), (raw,), "s string") == expected


@pytest.mark.parametrize("raw,expected", [("3.0", 3), (None, 0), ("x", 0), ("5", 5)])
def test_deletion_type(spark, raw, expected):
    assert one(spark, C.deletion_type("s"), (raw,), "s string") == expected


def test_safe_pct_and_labels(spark):
    assert one(spark, C.safe_pct("a", "b"), (1, 0), "a int, b int") == 0.0
    assert one(spark, C.safe_pct("a", "b"), (1, 4), "a int, b int") == 25.0
    assert one(spark, C.month_label("m"), (202206,), "m int") == "2022-06"
    assert one(spark, C.month_label("m"), (2022,), "m int") == "unknown"
    assert one(spark, C.status_class("t"), (2,), "t int") == "withdrawal"


def test_ufc_clawback_value(spark):
    p = SettlementParams()
    df = spark.createDataFrame([(9.9, dt.date(2021, 1, 1), dt.date(2021, 6, 1))],
                               "amount double, first_due_date date, last_due_date date")
    v = df.select((clawback_factor(p) * tariff(p)).alias("v")).first()["v"]
    assert v == pytest.approx(80.996175, abs=1e-6)


def test_premium_commission(spark):
    df = spark.createDataFrame([(10.0,)], "amount double")
    assert df.select(premium_value()).first()[0] == pytest.approx(43.80)
    assert df.select(premium_clawback_value(F.lit(12))).first()[0] == pytest.approx(-29.20)


def test_drop_leakage_keeps_event(spark):
    from churnlytics.operators.enrich import drop_leakage
    df = spark.createDataFrame([(1, 1, 2, "x", 3, 4)],
                               "id int, event int, deletion_type int, `Cancel Reason` string, del_month int, amount int")
    assert drop_leakage(df).columns == ["id", "event", "amount"]


def test_day_diff_defaults_and_age(spark):
    row = (dt.date(2021, 1, 1), None, dt.date(1990, 7, 2), dt.date(2021, 7, 2))
    schema = "start date, end_missing date, birthday date, as_of date"
    assert one(spark, C.day_diff_clipped("end_missing", "start", null_value=365, lower=1), row, schema) == 365
    assert one(spark, C.day_diff_clipped("end_missing", "start", null_value=180, lower=0), row, schema) == 180
    assert one(spark, C.day_diff_clipped("start", "as_of"), row, schema) == 0  # negative -> clipped
    assert one(spark, C.days_until("end_missing", "start"), row, schema) == -1
    days = (dt.date(2021, 7, 2) - dt.date(1990, 7, 2)).days
    assert one(spark, C.age_years("birthday", "as_of"), row, schema) == pytest.approx(days / 365.25)
    assert one(spark, C.birth_month("birthday"), row, schema) == 7
    assert one(spark, C.birth_month("end_missing"), row, schema) == -1


def test_rate_trend_golden(spark):
    from churnlytics.operators.rates import rate_trend
    rates = spark.createDataFrame(list(zip([9.9, 14.9, 19.9, 24.9, 29.9], [39.55, 46.16, 48.92, 43.32, 48.81])),
                                  "amount double, rate double")
    r = rate_trend(rates, "amount").first()
    assert r["slope"] == pytest.approx(0.3136, abs=1e-6)
    assert r["intercept"] == pytest.approx(39.11136, abs=1e-6)
    assert r["r2"] == pytest.approx(0.389433, abs=1e-6)

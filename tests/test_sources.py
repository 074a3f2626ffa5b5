"""Sources and sinks (S2-S7, P22) and lenient cleaning."""

import tempfile

import pytest

from churnlytics.sources import (lenient_contracts, normalize_columns, read_csv, require_columns, write_csv,
                                 write_tables)


def test_csv_roundtrip_with_decimal_comma(spark):
    base = tempfile.mkdtemp(prefix="churnlytics-csv-")
    raw = spark.createDataFrame([("1", "FO-SCL", "9,9", "3.0", "2021-01-15", "202101"),
                                 ("2", "JD-ITM", "abc", None, "not a date", "x")],
                                "ID string, Kampagne string, Amount string, `Deletion Type` string, "
                                "`Start Insurance` string, RKMDAT string")
    write_csv(raw, f"{base}/in")
    back = lenient_contracts(read_csv(spark, f"{base}/in"))
    rows = {r["id"]: r for r in back.collect()}
    assert set(back.columns) >= {"id", "campaign", "amount", "deletion_type", "start_insurance", "acq_month"}
    assert rows["1"]["amount"] == pytest.approx(9.9) and rows["1"]["deletion_type"] == 3
    assert rows["2"]["amount"] is None and rows["2"]["deletion_type"] == 0
    assert str(rows["1"]["start_insurance"]) == "2021-01-15" and rows["2"]["start_insurance"] is None
    assert rows["1"]["acq_month"] == 202101 and rows["2"]["acq_month"] is None


def test_required_columns_lists_all_missing(spark):
    df = spark.createDataFrame([(1,)], "campaign int")
    with pytest.raises(ValueError, match="acq_month, del_month"):
        require_columns(df, ["campaign", "acq_month", "del_month"])


def test_normalize_columns(spark):
    df = spark.createDataFrame([(1, 2)], "`Customer Name` int, DELLAT int")
    assert normalize_columns(df).columns == ["campaign", "del_month"]


def test_write_tables(spark, sf_small):
    from churnlytics.operators.settlement import settlement_tables
    from churnlytics.plans.common import PARAMS, contracts
    base = tempfile.mkdtemp(prefix="churnlytics-tables-")
    tables = settlement_tables(contracts(spark, sf_small), PARAMS)
    tables.pop("contracts")
    paths = write_tables({k: tables[k] for k in ("result", "ufc_clawback", "cpo_new")}, base)
    for k, p in paths.items():
        assert spark.read.parquet(p).count() == tables[k].count()

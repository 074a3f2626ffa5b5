"""Hand-computed settlement fixture (threshold 202206, business tariffs)."""

import datetime as dt

import pytest

from churnlytics.operators import commission as PC
from churnlytics.operators import settlement as S
from churnlytics.schema import CONTRACTS, SettlementParams

P = SettlementParams()
D = dt.date


def _contracts(spark, rows):
    cols = [f.name for f in CONTRACTS.fields]
    full = []
    for r in rows:
        base = dict.fromkeys(cols)
        base.update(r)
        full.append(tuple(base[c] for c in cols))
    return spark.createDataFrame(full, CONTRACTS)


@pytest.fixture
def fixture(spark):
    return _contracts(spark, [
        # FO-SCL termination acquired after the threshold, due-date span 6 months
        dict(id=1, campaign="FO-SCL", amount=9.9, product_code=3402, acq_month=202207, del_month=202210,
             deletion_type=3, first_due_date=D(2022, 7, 1), last_due_date=D(2022, 12, 1)),
        # FO-SCL withdrawal in its acquisition month
        dict(id=2, campaign="FO-SCL", amount=14.9, product_code=3402, acq_month=202208, del_month=202208,
             deletion_type=1, first_due_date=D(2022, 8, 1), last_due_date=D(2022, 8, 1)),
        # active JD contract of the second product
        dict(id=3, campaign="JD-ITM", amount=19.9, product_code=3783, acq_month=202205, deletion_type=0),
        # FO-S2S withdrawal acquired before the threshold
        dict(id=4, campaign="FO-S2S", amount=24.9, product_code=3402, acq_month=202205, del_month=202209,
             deletion_type=2),
    ])


def test_settlement_result(spark, fixture):
    rows = {r["month"]: r for r in S.settlement_result(fixture, P).collect()}
    assert sorted(rows) == [202205, 202207, 202208, 202209, 202210]
    assert rows[202205]["fo_new_cpo"] == pytest.approx(49.9)
    assert rows[202205]["jd_new_cpo"] == 0.0  # product 3783 is reported separately
    assert rows[202207]["fo_new_cpo"] == pytest.approx(59.9)
    assert rows[202207]["fo_new_ufc"] == pytest.approx(107.9949)
    assert rows[202208]["fo_withdrawal_cpo"] == pytest.approx(-59.9)
    assert rows[202208]["fo_withdrawal_ufc"] == pytest.approx(-162.5167)
    assert rows[202209]["fo_withdrawal_cpo"] == pytest.approx(-59.9)
    assert rows[202210]["fo_clawback_ufc"] == pytest.approx(-(1 - 6 / 24) * 107.9949)


def test_ufc_withdrawal_rules(spark, fixture):
    same = {r["del_month"]: r for r in S.ufc_withdrawal(fixture, P, "same_month").collect()}
    assert list(same) == [202208] and same[202208]["FO-SCL_14_9"] == pytest.approx(162.5167)
    after = {r["del_month"]: r for r in S.ufc_withdrawal(fixture, P, "after_threshold").collect()}
    assert list(after) == [202208]
    claw = S.ufc_clawback(fixture, P).collect()
    assert len(claw) == 1 and claw[0]["FO-SCL_9_9"] == pytest.approx(80.996175, abs=1e-6)


def test_cpo_withdrawal_gap_fill_and_rollups(spark):
    df = _contracts(spark, [
        dict(id=1, campaign="FO-ITM", amount=9.9, product_code=3402, acq_month=202112, del_month=202201,
             deletion_type=5),
        dict(id=2, campaign="JD-OTM", amount=9.9, product_code=3402, acq_month=202112, del_month=202204,
             deletion_type=1),
    ])
    rows = S.cpo_withdrawal(df, P, ["FO-ITM", "JD-OTM"]).collect()
    assert [r["del_month"] for r in rows] == [202201, 202202, 202203, 202204]
    assert rows[0]["FO"] == pytest.approx(49.9) and rows[0]["JD"] == 0.0
    assert rows[3]["JD"] == pytest.approx(49.9) and rows[1]["FO"] == 0.0 == rows[2]["JD"]


def test_premium_clawback_window(spark):
    df = _contracts(spark, [
        dict(id=1, campaign="FO-SCL", amount=9.9, acq_month=202207, del_month=202210, deletion_type=3),
        dict(id=2, campaign="FO-SCL", amount=9.9, acq_month=202207, del_month=202207, deletion_type=4),  # 0 months
        dict(id=3, campaign="FO-SCL", amount=9.9, acq_month=201901, del_month=202202, deletion_type=6),  # 37 months
    ])
    rows = {r["del_month"]: r["FO-SCL"] for r in PC.premium_clawback(df, ["FO-SCL"]).collect()}
    pv = 27.9 + 0.53 * 3 * 9.9
    assert rows[202210] == pytest.approx(-pv * 33 / 36)
    assert rows[202207] == 0.0 and rows[202202] == 0.0


def test_short_result_labels(spark, fixture):
    rows = {r["month"]: r for r in S.short_result(fixture, P).collect()}
    assert "2022-05" in rows and rows["2022-05"]["jd_new_cpo"] == pytest.approx(49.9)

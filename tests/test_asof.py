"""As-of lookups, folds and survival at each contract's own time."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from churnlytics.operators import survival as KM
from churnlytics.operators.asof import as_of_join
from churnlytics.operators.features import stratified_folds

POINTS = [("a", 0.0, 1), ("a", 10.0, 2), ("a", 10.0, 2), ("a", 300.0, 3), ("b", 5.0, 7), (None, 0.0, 9), ("c", None, 8)]


def plain(key, t, nearest):
    found = [(p, v) for k, p, v in set(POINTS) if k == key and p is not None and k is not None and t is not None]
    if nearest:
        return min(found, key=lambda x: (abs(x[0] - t), x[0]))[1] if found else None
    found = [x for x in found if x[0] <= t]
    return max(found)[1] if found else None


@pytest.mark.parametrize("bound", [0, 1000])
@pytest.mark.parametrize("way", ["backward", "nearest"])
def test_as_of_matches_plain_lookup(spark, bound, way):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, 0.0, 5.0, 7.5, 10.0, 155.0, 155.5, 4e3, -2.0]))
            for i in range(200)]
    df = spark.createDataFrame(rows, "id int, k string, t double").repartition(4)
    points = spark.createDataFrame(POINTS, "k string, p double, v int")
    got = {r["id"]: r["v"] for r in as_of_join(df, points, "t", "p", ["k"], ["v"], way, broadcast_points=bound).collect()}
    assert got == {i: plain(k, t, way == "nearest") for i, k, t in rows}
    assert as_of_join(df.limit(0), points, "t", "p", ["k"], ["v"]).count() == 0
    assert as_of_join(df, points.limit(0), "t", "p", ["k"], ["v"]).count() == 200


def test_as_of_refuses_two_values_at_one_time(spark):
    df = spark.createDataFrame([(1, 5.0)], "id int, t double")
    points = spark.createDataFrame([(1.0, 1), (1.0, 2)], "p double, v int")
    with pytest.raises(PySparkException, match="points that differ"):
        as_of_join(df, points, "t", "p", (), ["v"]).collect()


def test_conditional_survival_by_hand(spark):
    rows = spark.createDataFrame([(1, 1, 1), (2, 3, 1), (3, 3, 0), (4, 9, 1)], "id int, duration int, event int")
    curve = KM.km_curve(rows)  # 1, 0.75 from 1, 0.5 from 3, 0 from 9
    got = {r["id"]: (r["survival_now"], r["survival_then"], r["conditional_survival"])
           for r in KM.conditional_survival(rows, curve, 2).collect()}
    assert got == {1: (0.75, 0.5, pytest.approx(2 / 3)), 2: (0.5, 0.5, 1.0), 3: (0.5, 0.5, 1.0), 4: (0.0, 0.0, None)}


def test_curve_refuses_a_null_event(spark):
    rows = spark.createDataFrame([(1, 1), (2, None)], "duration int, event int")
    with pytest.raises(PySparkException, match="event is NULL"):
        KM.km_curve(rows).collect()


def test_folds_are_balanced_in_each_class(spark):
    rows = [(i, None if i % 11 == 0 else int(i % 3 == 0), 5) for i in range(1003)] + [(7, 0, 5)] * 4
    df = spark.createDataFrame(rows, "id long, event int, _n int").repartition(5)
    out = stratified_folds(df, 5)
    assert out.columns == ["id", "event", "_n", "fold"] and out.count() == len(rows)
    for cls in (0, 1, None):
        sizes = [r["n"] for r in out.where(F.col("event").eqNullSafe(F.lit(cls).cast("int"))).groupBy("fold").agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    a, b = ({(r["id"], r["fold"]) for r in stratified_folds(df.dropDuplicates(["id"]), 5, seed=s).collect()} for s in (0, 1))
    assert a != b and stratified_folds(df.limit(0)).count() == 0

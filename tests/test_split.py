"""The bucketed exact split equals the brute-force ranking."""

import numpy as np

from churnlytics.operators.features import stratified_split


def test_split_matches_bruteforce(spark):
    import hashlib
    n = 3000
    rows = [(i, int(i % 3 == 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, event int")
    got = {r["id"]: r["split"] for r in stratified_split(df).collect()}
    assert len(got) == n
    for cls in (0, 1):
        ids = [i for i, e in rows if e == cls]
        hs = sorted(ids, key=lambda i: (int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16), i))
        k = int(np.floor(0.8 * len(ids)))
        assert {i for i in hs[:k]} == {i for i in ids if got[i] == "train"}


def test_split_shares(spark, sf_small):
    from churnlytics.operators.survival import survival_frame
    from churnlytics.plans.common import AS_OF, contracts
    s = stratified_split(survival_frame(contracts(spark, sf_small), AS_OF))
    pdf = s.groupBy("event", "split").count().toPandas()
    for cls, g in pdf.groupby("event"):
        total = g["count"].sum()
        train = g.loc[g["split"] == "train", "count"].sum()
        assert abs(train - 0.8 * total) <= 1


def test_null_label_rows_stay(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(100)], "id long, event int")
    got = stratified_split(df).collect()
    assert len(got) == 100 and {r["split"] for r in got if r["event"] is None} == {"train", "test"}

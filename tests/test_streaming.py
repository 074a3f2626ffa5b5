"""The streaming cohort counts equal the batch counts."""

import tempfile

from churnlytics.plans.common import contracts
from churnlytics.schema import CONTRACTS
from churnlytics.streaming import start_cohort_counts


def test_stream_equals_batch(spark, sf_small):
    base = tempfile.mkdtemp(prefix="churnlytics-stream-")
    c = contracts(spark, sf_small, region=True).select(*[f.name for f in CONTRACTS.fields])
    c.repartition(3).write.parquet(f"{base}/src")
    q = start_cohort_counts(spark, f"{base}/src", f"{base}/ckpt", sink="memory", query_name="cc_test", max_files_per_trigger=1)
    q.processAllAvailable()
    q.stop()
    got = {(r["acq_month"], r["campaign"]): r["n"] for r in spark.sql("SELECT * FROM cc_test").collect()}
    want = {(r["acq_month"], r["campaign"]): r["count"] for r in c.groupBy("acq_month", "campaign").count().collect()}
    assert got == want


def test_stream_parquet_sink(spark, sf_small):
    base = tempfile.mkdtemp(prefix="churnlytics-stream-pq-")
    c = contracts(spark, sf_small, region=True).select(*[f.name for f in CONTRACTS.fields])
    c.repartition(2).write.parquet(f"{base}/src")
    q = start_cohort_counts(spark, f"{base}/src", f"{base}/ckpt", sink="parquet", path=f"{base}/out",
                            query_name="cc_pq", max_files_per_trigger=1)
    q.processAllAvailable()
    q.stop()
    got = {(r["acq_month"], r["campaign"]): r["n"] for r in spark.read.parquet(f"{base}/out").collect()}
    want = {(r["acq_month"], r["campaign"]): r["count"] for r in c.groupBy("acq_month", "campaign").count().collect()}
    assert got == want

"""Shared helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlytics.schema import SettlementParams
from churnlytics.sources.testdata import TEST_AS_OF, TEST_CAMPAIGNS, TEST_THRESHOLD, contracts_from_testdata

DIGITS = 6
PARAMS = SettlementParams(threshold=TEST_THRESHOLD)
AS_OF = TEST_AS_OF

# SQL of the test view: the event, observation time and K7 duration of a contract.
EV = "(deletion_type <> 0)::INTEGER"
OBS = f"greatest(coalesce((DATE '{AS_OF}' - start_insurance), -1), 0)::INTEGER"
K7 = ("least(greatest(coalesce(CASE WHEN deletion_type > 0 THEN (deletion_allowed_at - start_insurance) "
      "ELSE (end_insurance - start_insurance) END, 0), 0), 1200)::INTEGER")
SURV = f"(SELECT *, {EV} AS event, {OBS} AS duration FROM contracts)"

# Column keys of the test view (campaigns, the split campaign by amount).
CAMPAIGN_KEYS = sorted(TEST_CAMPAIGNS)
SPLIT_KEYS = ["FO-ITM", "FO-OTM", "FO-S2S", "FO-SCL_14_9", "FO-SCL_19_9", "FO-SCL_24_9",
              "FO-SCL_29_9", "FO-SCL_9_9", "JD-ITM", "JD-OTM", "M3-OTM", "TS-OTM"]


def contracts(spark: SparkSession, sf_dir: str, due_dates: bool = True, region: bool = False) -> DataFrame:
    return contracts_from_testdata(spark, sf_dir, due_dates=due_dates, region=region)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (presentation precision of the results)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)

"""Enrichment of raw contract rows (column-wise, no in-place UPDATE)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from churnlytics.functions import columns as C


def enrich_contracts(raw: DataFrame, legacy_month13: bool = False) -> DataFrame:
    """Add call center (P2), campaign (P3), report date (P4), acquisition month
    (P5) and deletion month (P6); project the 9 export columns."""
    df = raw.withColumns({
        "call_center": C.call_center_from_contract_no("contract_no"),
    })
    df = df.withColumns({
        "campaign": C.campaign_from_parts("call_center", "campaign_no"),
        "report_date": C.report_date("start_insurance"),
    })
    df = df.withColumns({
        "acq_month": C.month_key("report_date"),
        "del_month": C.deletion_month("deletion_allowed_at", legacy_month13),
    })
    return df.select("contract_no", "call_center", "campaign_no", "campaign", "start_insurance",
                     "report_date", "acq_month", "deletion_allowed_at", "del_month")


def with_event(df: DataFrame, col: str = "deletion_type") -> DataFrame:
    """P20 as a frame operator."""
    return df.withColumn("event", C.event_flag(col))


def drop_leakage(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Drop leakage columns by name and by name pattern; ``event`` stays.
    Schema-only: no data is touched."""
    from churnlytics.schema import LEAKAGE_COLUMNS, LEAKAGE_PATTERNS
    names = set(LEAKAGE_COLUMNS) | set(extra)
    drop = [c for c in df.columns
            if c != "event" and (c in names or any(p in c.lower() for p in LEAKAGE_PATTERNS))]
    return df.drop(*drop)


def normalize_status(df: DataFrame) -> DataFrame:
    """Clean deletion type and add the status class."""
    return df.withColumn("deletion_type", C.deletion_type("deletion_type")) \
             .withColumn("status", C.status_class("deletion_type"))


__all__ = ["enrich_contracts", "with_event", "drop_leakage", "normalize_status"]

"""Structured Streaming adapters of the batch operators."""

from churnlytics.streaming.cohort_stream import cohort_counts_stream, start_cohort_counts

__all__ = ["cohort_counts_stream", "start_cohort_counts"]

"""Registry of queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Each query reads the whole test tables through the ``contracts`` view and runs
one library operator; doubles are rounded to 6 digits for comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        return fn
    return deco


def all_queries() -> dict[str, QueryFn]:
    # Importing the modules registers their queries.
    from churnlytics.plans import (q_clean, q_cohort, q_cox, q_evaluate, q_features, q_models, q_rates,  # noqa: F401
                                   q_settlement, q_survival)
    return dict(QUERIES)

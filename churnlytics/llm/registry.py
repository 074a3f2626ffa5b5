"""Queries of the operators: name -> f(spark, sf_dir) -> DataFrame, and their
DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from churnlytics.llm import queries as Q
from churnlytics.llm.audit import AUDIT_SQL
from churnlytics.llm.decontaminate import CONTAMINATION_SQL
from churnlytics.llm.resample import RESAMPLE_SQL
from churnlytics.llm.urls import urls_sql

QUERIES = {
    "op1_packing": Q.op1_packing,
    "op2_embeddings": Q.op2_embeddings,
    "op3_minhash": Q.op3_minhash,
    "op4_decontamination": Q.op4_decontamination,
    "op5_url_filter": Q.op5_url_filter,
    "op6_token_counts": Q.op6_token_counts,
    "op7_quality": Q.op7_quality,
    "op8_substrings": Q.op8_substrings,
    "op9_toxicity": Q.op9_toxicity,
    "op10_licenses": Q.op10_licenses,
    "op11_resample": Q.op11_resample,
    "op12_neighbors": Q.op12_neighbors,
    "op13_filter_audit": Q.op13_filter_audit,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op4_decontamination": CONTAMINATION_SQL,
    "op5_url_filter": urls_sql(),
    "op11_resample": RESAMPLE_SQL,
    "op13_filter_audit": AUDIT_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL

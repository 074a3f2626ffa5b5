"""The thin ``opN_<name>`` queries: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlytics.llm.audit import filter_audit
from churnlytics.llm.common import filter_ids, read
from churnlytics.llm.decontaminate import contamination
from churnlytics.llm.embeddings import near_vectors
from churnlytics.llm.licenses import scan_licenses
from churnlytics.llm.minhash import near_duplicates
from churnlytics.llm.neighbors import nearest_neighbors
from churnlytics.llm.packing import pack_documents
from churnlytics.llm.quality import THRESHOLD as QUALITY_THRESHOLD
from churnlytics.llm.quality import held_out, score_quality, train_crf
from churnlytics.llm.resample import resample
from churnlytics.llm.substrings import cut_repeats
from churnlytics.llm.tokencounts import commit_batch, totals
from churnlytics.llm.toxicity import CATEGORIES, THRESHOLD, score_toxicity, train_chain
from churnlytics.llm.urls import judge_urls
from churnlytics.session import checkpoint_dir


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 tokens."""
    return pack_documents(read(spark, sf_dir, "documents"), capacity=2048)


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and groups of all ``embeddings``, cosine 0.95."""
    return near_vectors(read(spark, sf_dir, "embeddings"), similarity=0.95)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents``: 5-word shingles, similarity 0.8."""
    return near_duplicates(read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole document that lie in 10-word windows of ``benchmark``."""
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), n=10)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and host trust for the url of every page."""
    return judge_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def change_feed(spark: SparkSession, sf_dir: str) -> list[tuple[int, DataFrame]]:
    """The feed that ``op6_token_counts`` gets: batch 1 brings every document,
    batch 2 takes down those that ``labels`` calls toxic, batch 3 brings a
    revision of those that it calls low in quality (runs of white space become
    one space)."""
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels")

    def feed(rows: DataFrame, seq: int, op: str, text) -> DataFrame:
        return rows.select(F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), "doc_id", "source", "lang",
                           text.alias("text"))

    toxic, low = (labels.where(w).select(F.col("doc_id").alias("id")).distinct()
                  for w in ("toxic = 1", "quality = 0 AND toxic = 0"))
    return [(1, feed(docs, 1, "insert", F.col("text"))),
            (2, feed(filter_ids(docs, toxic, "doc_id"), 2, "delete", F.lit(None).cast("string"))),
            (3, feed(filter_ids(docs, low, "doc_id"), 3, "insert",
                     F.trim(F.regexp_replace("text", r"\s+", " "))))]


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of ``documents`` by source, language and tokenizer version,
    after three batches of a change feed; the second is delivered twice. A
    document without an id counts as it came; no change reaches it."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}"
    feed = change_feed(spark, sf_dir)
    for batch, changes in [*feed[:2], feed[1], feed[2]]:
        commit_batch(root, batch, changes, unnamed="count")
    return totals(spark, root)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole document, by a field fitted on ``labels``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, train_crf(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated passages cut out of the text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return cut_repeats(docs).select("doc_id", F.col("_cut_words").alias("cut_words"),
                                    (F.col("_cut_words") > 0).alias("has_repeats"), "text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, by a chain fitted on ``labels``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train_chain(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", *[f"p_{n}" for n, _ in CATEGORIES],
                         (F.col("p_toxic") >= THRESHOLD).alias("toxic"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License scan of every whole text of ``documents``."""
    return scan_licenses(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.array_join("expressions", "\n").alias("expressions"), "permitted")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of ``documents``, drawn by likeness to ``benchmark``."""
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of every 50th vector among all ``embeddings``."""
    return nearest_neighbors(read(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters on ``documents`` in every order, counted by language."""
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))

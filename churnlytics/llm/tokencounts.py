"""Token counts (operator 6): rollups kept up to date by signed deltas.

A store is a folder with three tables, all in Parquet and partitioned by batch:
``state`` (what each document counts now, per tokenizer version), ``delta``
(signed changes of documents and tokens by source, language and version) and
``commit`` (one row, written last). A batch exists once its commit row does:
a repeated batch is a no-op, an attempt that died is written over. Totals are
the sum of the committed deltas; the corpus is never counted again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlytics.llm import text as TX
from churnlytics.llm.common import store
from churnlytics.llm.tokens import Encoder, vocabulary_path

INSERT, DELETE = "insert", "delete"
# Tokenizer version -> vocabulary file.
VERSIONS = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}
STATE = "batch long, doc_id long, version string, source string, lang string, tokens long, live boolean"
DELTA = "batch long, source string, lang string, version string, docs long, tokens long"
COMMIT = "batch long"


def count_tokens(changes: DataFrame, versions: dict[str, str]) -> DataFrame:
    """``changes(seq, op, doc_id, source, lang, text)`` with a row per version
    and ``tokens`` in place of the text; a deleted or null text counts 0."""
    paths = {v: vocabulary_path(name) for v, name in versions.items()}

    def run(batches):
        encoders = {v: Encoder(p) for v, p in paths.items()}
        for part in TX.slices(batches, 5):
            texts = part.column(5).to_pylist()
            for v, encoder in encoders.items():
                n = [len(encoder.encode(t)) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:5], pa.array([v] * part.num_rows, pa.string()), pa.array(n, pa.int64())],
                    names=["seq", "op", "doc_id", "source", "lang", "version", "tokens"])

    text = F.when(F.col("op") != DELETE, F.col("text"))
    return changes.select("seq", "op", F.col("doc_id").cast("long"), "source", "lang", text.alias("text")) \
        .mapInArrow(run, "seq long, op string, doc_id long, source string, lang string, version string, tokens long")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _committed(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    done = _table(spark, f"{root}/commit", COMMIT)
    return _table(spark, f"{root}/{name}", schema).join(done, "batch", "left_semi")


def commit_batch(root: str, batch: int, changes: DataFrame, versions: dict[str, str] = VERSIONS,
                 unnamed: str = "reject") -> bool:
    """Apply ``changes(seq long, op, doc_id, source, lang, text)`` as batch
    number ``batch`` of the store in ``root``; False if it was there already.

    'insert' gives a document its text, source and language, whether it is new
    or a revision (the difference to its former count is booked, also from one
    source or language to another); 'delete' takes it out of every version that
    counts it. Of several changes of a document, the one with the greatest
    ``seq`` holds (ties: the greatest of op, source, lang and count).

    Defined cases: a null text counts 0 tokens and one document; a null source
    or language is a group of its own; a row with an unknown op, or a delete
    with a null doc_id, is rejected (ValueError) before anything is written, and
    so is an insert with a null doc_id unless ``unnamed`` is 'count': each such
    row then counts as a document of its own, which no later change can reach.
    Deleting what is not there changes nothing; exact repetitions of a row with
    an id count once; a very long text is counted whole, alone; an empty batch is
    committed with no delta. Batches come in ascending order (ValueError
    otherwise); one writer at a time.
    """
    if unnamed not in ("reject", "count"):
        raise ValueError("unnamed is 'reject' or 'count'")
    spark = changes.sparkSession
    done = [r[0] for r in _table(spark, f"{root}/commit", COMMIT).orderBy(F.desc("batch")).limit(1).collect()]
    if done and batch <= done[0]:
        if _table(spark, f"{root}/commit", COMMIT).where(F.col("batch") == batch).isEmpty():
            raise ValueError(f"batch {batch} comes after batch {done[0]}")
        return False
    nameless = F.col("doc_id").isNull()
    if unnamed == "count":
        nameless &= F.col("op") == DELETE
    bad = changes.where(nameless | ~F.coalesce(F.col("op").isin(INSERT, DELETE), F.lit(False)))
    if not bad.isEmpty():
        raise ValueError("a change without doc_id, or of an unknown op")
    counted = store(count_tokens(changes, versions))
    loose = counted.where("doc_id IS NULL").select("source", "lang", "version", F.lit(1).alias("docs"), "tokens")
    last = counted.where("doc_id IS NOT NULL").groupBy("doc_id", "version").agg(F.max(F.struct("seq", "op", "source", "lang", "tokens")).alias("x")) \
        .select("doc_id", "version", (F.col("x.op") == INSERT).alias("live"), "x.source", "x.lang", "x.tokens")
    ids = last.select("doc_id").distinct()
    old = (_committed(spark, root, "state", STATE).join(ids, "doc_id", "left_semi").groupBy("doc_id", "version")
           .agg(F.max(F.struct("batch", "live", "source", "lang", "tokens")).alias("x"))
           .where("x.live").select("doc_id", "version", F.col("x.source").alias("o_source"),
                                   F.col("x.lang").alias("o_lang"), F.col("x.tokens").alias("o_tokens")))
    gone = last.where("NOT live").select("doc_id").distinct()
    # A delete reaches the versions that this batch does not count, too.
    extra = (old.join(gone, "doc_id", "left_semi").join(last.select("doc_id", "version"), ["doc_id", "version"], "left_anti")
             .select("doc_id", "version", F.lit(False).alias("live"), F.col("o_source").alias("source"),
                     F.col("o_lang").alias("lang"), F.lit(0).cast("long").alias("tokens")))
    both = store(last.unionByName(extra).join(old, ["doc_id", "version"], "left"))
    both.select(F.lit(batch).cast("long").alias("batch"), "doc_id", "version", "source", "lang", "tokens", "live") \
        .write.mode("overwrite").parquet(f"{root}/state/b{batch}")
    plus = both.where("live").select("source", "lang", "version", F.lit(1).alias("docs"), "tokens")
    minus = both.where("o_tokens IS NOT NULL").select(F.col("o_source").alias("source"), F.col("o_lang").alias("lang"),
                                                      "version", F.lit(-1).alias("docs"), (-F.col("o_tokens")).alias("tokens"))
    delta = (plus.unionByName(minus).unionByName(loose).groupBy("source", "lang", "version")
             .agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
             .where("docs <> 0 OR tokens <> 0"))
    delta.select(F.lit(batch).cast("long").alias("batch"), "source", "lang", "version", "docs", "tokens") \
        .write.mode("overwrite").parquet(f"{root}/delta/b{batch}")
    spark.range(1).select(F.lit(batch).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{root}/commit/b{batch}")
    return True


def totals(spark: SparkSession, root: str) -> DataFrame:
    """``(source, lang, version, docs, tokens)`` of the committed batches."""
    return (_committed(spark, root, "delta", DELTA).groupBy("source", "lang", "version")
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0"))


def document_counts(spark: SparkSession, root: str) -> DataFrame:
    """``(doc_id, version, source, lang, tokens)`` as of the last batch."""
    return (_committed(spark, root, "state", STATE).groupBy("doc_id", "version")
            .agg(F.max(F.struct("batch", "live", "source", "lang", "tokens")).alias("x")).where("x.live")
            .select("doc_id", "version", "x.source", "x.lang", "x.tokens"))

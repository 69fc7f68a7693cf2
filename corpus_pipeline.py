"""A training-data pipeline over ``documents``: each stage works on all rows that the stage before it kept.

Cases: null or empty texts have no language and go in the second stage; an empty table passes through every stage; each
row is judged by its own text, and rows that repeat both doc_id and text stay or go together; extra columns are carried
to the last stage, which returns its own columns only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, language, minhash, queries, sentencepiece_codec, toxicity
from tidemark.llm.common import documents, labels, shared_dir


#: Rows of an Arrow batch, and the setting that says so: texts may be long, and each worker holds some batches.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def smaller_batches(spark: SparkSession) -> None:
    """Set ``BATCH_ROWS`` in sessions that have Spark's default; ``run`` sets the default again in the end."""
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score half or more go; learned from all labelled rows."""
    smaller_batches(spark)
    return toxicity.clean(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language is predicted with too little confidence, go."""
    smaller_batches(spark)
    return language.accepted(docs, language.fit(docs))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (shingles of five words, similarity 0.8) the smallest doc_id stays."""
    smaller_batches(spark)
    return minhash.deduplicated(docs, size=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes`` of the kept texts, encoded and decoded; other columns end here."""
    smaller_batches(spark)
    return sentencepiece_codec.round_trip(docs, queries.vocabulary())


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near-duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: SQL can express neither the learned stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs, before = documents(spark, sf_dir), spark.conf.get(BATCH_SETTING)
    try:
        for name, stage in STAGES:
            path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}.parquet"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return docs

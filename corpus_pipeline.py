"""A corpus pipeline of five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.decontam import decontaminate
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.pii import redact_pii
from corpusloom.llm.quality_model import learn_quality, score_quality
from corpusloom.llm.simhash import near_dedup
from corpusloom.session import remove, scratch, workspace


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learnt = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    scored = score_quality(docs, learn_quality(learnt, labels), keep=tuple(docs.columns))
    return scored.where("predicted = 1").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dedup(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data written as ``[KIND]``."""
    return redact_pii(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 4096 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("pii", without_pii),
    ("best-fit packing", packed),
]

#: Learnt models, hash links and alignments have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one after the other; only the last one's rows stay in the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    base = f"{workspace(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        if before:
            remove(spark, before)
        before = f"{base}/{k}"
        docs = spark.read.parquet(before)
    return docs

"""Columns that the driver's tables lack, derived alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.ranking import distributed_rank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the metadata of papers."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        "n_chars",
        (i % 4).alias("kb_id"),
        F.col("lang").alias("phase"),
        F.col("source").alias("topic"),
        F.when(i % 11 != 0, 1990 + i % 35).alias("year"),
        F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 1000)).cast("long").alias("total_pages"),
        F.when(i % 3 == 0, F.concat(F.lit("10.1000/"), i)).alias("doi"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80).alias("title"),
        F.concat(F.lit("Author"), i % 7).alias("first_author"),
        F.concat(F.lit("Writer"), i % 5).alias("second_author"),
    )


#: The same as a common table expression.
PAPERS = """papers AS (
  SELECT doc_id, text, n_chars, doc_id % 4 AS kb_id, lang AS phase, source AS topic,
         CASE WHEN doc_id % 11 <> 0 THEN 1990 + doc_id % 35 END AS year,
         greatest(1, CAST(ceil(n_chars / 1000.0) AS BIGINT)) AS total_pages,
         CASE WHEN doc_id % 3 = 0 THEN '10.1000/' || doc_id END AS doi,
         substr(split_part(text, chr(10), 1), 1, 80) AS title,
         'Author' || (doc_id % 7) AS first_author, 'Writer' || (doc_id % 5) AS second_author
  FROM documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_id, doc_id, embedding``: the searched vectors, all of them."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 50).alias("doc_id"), "label", "embedding")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), "embedding")


def paired_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for every text query: in the order of the queries, the query vectors over and over."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    numbered = distributed_rank(asked, [], F.floor(F.col("query_id") / 10_000).cast("long"), ["query_id"])
    given = query_vectors(spark, sf_dir).withColumnRenamed("query_id", "vec_id")
    return numbered.withColumn("vec_id", F.col("rank") % F.lit(max(1, given.count())) * 50).join(given, "vec_id").select("query_id", "embedding")


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage, whole, as a question."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("text").alias("passage"))


TEXT_QUERIES = """text_queries AS (SELECT item_id AS query_id, text AS query, text AS passage FROM benchmark)"""

#: Lower-case words of two or more ASCII letters or digits that touch no other letter or digit.
TOKENS = "list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda t : regexp_full_match(t, '[a-z0-9]{{2,}}'))"

CHUNKS = """chunks AS (
  SELECT doc_id, i AS chunk_index, doc_id || '_chunk_' || i AS chunk_id, substr(text, CAST(i * 800 + 1 AS BIGINT), 1000) AS text
  FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, CAST(ceil((length(text) - 200) / 800.0) AS BIGINT) - 1))) AS i
        FROM documents WHERE length(text) > 0))"""

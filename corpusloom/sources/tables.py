"""Reading corpus files and writing results, in formats that Spark reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.patterns import INTENTS, STRATEGIES


def corpus_catalog(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """``path, filename, phase, phase_name, topic, length`` of every file two levels under ``root``.

    A folder ``Phase 1 - Theory`` gives phase and name; without the dash the whole
    name stands for both.  File contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")
    parts = F.split(F.url_decode("path"), "/")
    folder = F.try_element_at(parts, F.lit(-3))
    name = F.split(folder, " - ", 2)
    return files.select(
        "path",
        F.element_at(parts, -1).alias("filename"),
        name[0].alias("phase"),
        F.coalesce(F.try_element_at(name, F.lit(2)), folder).alias("phase_name"),
        F.try_element_at(parts, F.lit(-2)).alias("topic"),
        "length",
    )


def term_maps(spark: SparkSession, path: str) -> DataFrame:
    """``category, canonical, variants`` from a JSON object of lists of lists; empty groups are skipped."""
    raw = spark.read.option("wholetext", "true").text(path)
    groups = raw.select(F.explode(F.from_json("value", "map<string, array<array<string>>>")).alias("category", "groups"))
    one = groups.select("category", F.explode("groups").alias("g")).where(F.size("g") > 0)
    return one.select("category", F.element_at("g", 1).alias("canonical"), F.expr("slice(g, 2, size(g))").alias("variants"))


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """``id, query, expected_doc_ids, n_results, phase_filter, topic_filter`` from JSON lines; placeholder and empty ids are ignored."""
    rows = spark.read.schema("id string, query string, expected_doc_ids array<string>, n_results int, phase_filter string, topic_filter string").json(path)
    return rows.withColumn("expected_doc_ids", F.filter("expected_doc_ids", lambda x: (x != "") & (x != "REPLACE_ME")))


def parse_claims(df: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per claim of a model's reply: a JSON array, in a code fence or not; blank claims are dropped."""
    body = F.coalesce(F.nullif(F.regexp_extract(raw, r"(?s)```(?:[a-z]*)\s*(\[.*?\])\s*```", 1), F.lit("")), F.col(raw))
    items = F.from_json(body, "array<struct<claim:string,claim_text:string>>")
    out = df.withColumn("item", F.explode(items)).withColumn("claim_text", F.trim(F.coalesce("item.claim", "item.claim_text")))
    return out.where("claim_text <> ''").drop("item", raw)


def parse_graph(df: DataFrame, raw: str = "raw", most: int = 10) -> tuple[DataFrame, DataFrame]:
    """Entities ``name, type`` and relations ``source, target, relation`` of a model's reply, at most ten each."""
    found = df.withColumn("g", F.from_json(raw, "entities array<struct<name:string,type:string>>, relations array<struct<source:string,target:string,relation:string>>"))
    entities = found.withColumn("e", F.explode(F.slice("g.entities", 1, most))).withColumn("name", F.trim("e.name")).withColumn("type", F.coalesce("e.type", F.lit("concept")))
    relations = found.withColumn("r", F.explode(F.slice("g.relations", 1, most)))
    relations = relations.withColumns({"source": F.trim("r.source"), "target": F.trim("r.target"), "relation": F.coalesce("r.relation", F.lit("related_to"))})
    return entities.where("name <> ''").drop(raw, "g", "e"), relations.where("source <> '' and target <> ''").drop(raw, "g", "r")


def write_chunks(chunks: DataFrame, path: str, by: str = "kb_id") -> None:
    """Append chunks, one folder a knowledge base; missing ids are made from document and number."""
    named = chunks.withColumn("chunk_id", F.coalesce("chunk_id", F.concat(F.col("doc_id"), F.lit("_chunk_"), F.col("chunk_index"))))
    named.write.mode("append").partitionBy(by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled and white space at the ends of values is kept."""
    spaces = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    df.write.mode("overwrite").options(header="true", escape='"', **spaces).csv(path)


def write_markdown(lines: DataFrame, path: str, order: list[str], line: str = "line") -> None:
    lines.orderBy(*order).select(line).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def parse_plans(df: DataFrame, raw: str = "raw", question: str = "question", most: int = 5) -> DataFrame:
    """Adds ``intent, strategy, sub_queries`` of a model's plan: a JSON object, in a code fence or not.

    Unknown words become ``factual`` and ``multi_query``; a plan without sub-queries asks the question itself.  A reply
    that is no object is a factual, single question.
    """
    body = F.coalesce(F.nullif(F.regexp_extract(raw, r"(?s)```(?:[a-z]*)\s*(\{.*?\})\s*```", 1), F.lit("")), F.col(raw))
    plan = F.from_json(body, "intent_type string, retrieval_strategy string, sub_queries array<string>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    out = df.withColumn("__p", plan)
    bad = F.col("__p").isNull() | F.col("__p._bad").isNotNull()
    one_of = lambda c, words, other: F.when(F.col(c).isin(words), F.col(c)).otherwise(other)
    asked = F.slice("__p.sub_queries", 1, most)
    return out.select(
        *df.columns,
        F.when(bad, "factual").otherwise(one_of("__p.intent_type", INTENTS, "factual")).alias("intent"),
        F.when(bad, "single").otherwise(one_of("__p.retrieval_strategy", STRATEGIES, "multi_query")).alias("strategy"),
        F.when(bad | F.col("__p.sub_queries").isNull() | (F.size("__p.sub_queries") == 0), F.array(question)).otherwise(asked).alias("sub_queries"),
    )


def write_report(summary: DataFrame, per_query: DataFrame, path: str) -> None:
    """An evaluation report: the summary as one JSON line, and one line a query."""
    write_json(summary, f"{path}/summary")
    write_json(per_query, f"{path}/queries")


def write_documents(chunks: DataFrame, path: str, order: str = "chunk_index") -> None:
    """The table of documents of a chunk table: the first chunk's columns, and how many chunks each has."""
    sizes = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    first = chunks.groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in chunks.columns if c not in ("doc_id", "text")]), order).alias("__d"))
    first.select("doc_id", "__d.*").join(sizes, "doc_id").write.mode("overwrite").parquet(path)


def with_model(df: DataFrame, model, schema: str) -> DataFrame:
    """Rows through a model of the caller (an extractor, an embedder or a scorer): a function of a pandas frame, applied batch by batch in the tasks.

    ``schema`` is that of what the model gives back.
    """
    return df.mapInPandas(lambda parts: (model(part) for part in parts), schema)

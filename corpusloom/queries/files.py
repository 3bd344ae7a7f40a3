"""Readers and sinks: tables are written as files that Spark derives from them, and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import chunking, stats
from corpusloom.queries.corpus import ORACLES as _CORPUS_SQL
from corpusloom.queries.corpus import citation_table
from corpusloom.queries.fixtures import CHUNKS, table, text_queries
from corpusloom.queries.search import _sparse
from corpusloom.queries.tables import _PAPER_CHUNKS, _paper_chunks, _truth
from corpusloom.queries.tables import ORACLES as _TABLE_SQL
from corpusloom.session import materialize, workspace
from corpusloom.sources import tables as io

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, label: str) -> str:
    return f"{workspace(spark)}/{label}-{uuid.uuid4().hex}"


# -- sources


@query("""SELECT 'Phase ' || (doc_id % 3) AS phase, CASE WHEN doc_id % 3 = 2 THEN 'Phase 2' ELSE 'Part ' || (doc_id % 3) END AS phase_name, source AS topic, CAST(sum(length(CAST(doc_id AS VARCHAR)) + 1) AS BIGINT) AS bytes
FROM documents WHERE source IS NOT NULL GROUP BY ALL""")
def corpus_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of every topic's files; one phase has no name of its own."""
    path = _folder(spark, "catalog")
    docs = table(spark, sf_dir, "documents").where("source is not null")
    folder = F.expr("CASE WHEN doc_id % 3 = 2 THEN 'Phase 2' ELSE concat('Phase ', doc_id % 3, ' - Part ', doc_id % 3) END")
    docs.select(F.col("doc_id").cast("string"), folder.alias("p"), F.col("source").alias("t")).write.partitionBy("p", "t").text(path)
    found = io.corpus_catalog(spark, path, "*.txt")
    bare = lambda c: F.regexp_replace(c, "^[pt]=", "")  # noqa: E731  (a folder of Spark begins with the name of its column)
    return found.groupBy(bare("phase").alias("phase"), bare("phase_name").alias("phase_name"), bare("topic").alias("topic")).agg(F.sum("length").alias("bytes"))


@query("SELECT DISTINCT p_brand AS category, p_type AS canonical, p_type || ' kind,' || p_brand AS variants FROM part")
def term_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map a brand, with a group a type and an empty one."""
    path = _folder(spark, "terms")
    types = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("types"))
    groups = F.expr("concat(transform(types, t -> array(t, t || ' kind', p_brand)), array(array()))")
    types.select(F.to_json(F.create_map("p_brand", groups)).alias("value"), F.col("p_brand").alias("b")).write.partitionBy("b").text(path)
    return io.term_maps(spark, path).select("category", "canonical", F.array_join("variants", ",").alias("variants"))


@query("""SELECT CAST(item_id AS VARCHAR) AS id, text AS query, CASE WHEN item_id % 2 = 0 THEN 'd' || item_id ELSE '' END AS expected, CAST(5 + item_id % 3 AS INT) AS n_results, CASE WHEN item_id % 4 = 0 THEN 'Phase 1' END AS phase_filter FROM benchmark""")
def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "queries")
    items = table(spark, sf_dir, "benchmark").selectExpr(
        "cast(item_id as string) AS id", "text AS query", "array('', 'REPLACE_ME', CASE WHEN item_id % 2 = 0 THEN concat('d', item_id) ELSE '' END) AS expected_doc_ids",
        "cast(5 + item_id % 3 as int) AS n_results", "CASE WHEN item_id % 4 = 0 THEN 'Phase 1' END AS phase_filter",
    )
    io.write_json(items, path)
    return io.query_set(spark, path).select("id", "query", F.array_join("expected_doc_ids", ",").alias("expected"), "n_results", "phase_filter")


@query("""SELECT conv_id, turn, trim(text) AS claim_text FROM conversations WHERE turn % 4 < 3 AND trim(text) <> '' UNION ALL SELECT conv_id, turn, 'second' FROM conversations WHERE turn % 4 = 1""")
def parsed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare, fenced and labelled arrays with the text of a turn as claim, and prose."""
    said = F.expr("to_json(array(named_struct('claim', concat(' ', text, ' '))))")
    other = F.expr("to_json(array(named_struct('claim_text', text), named_struct('claim_text', 'second'), named_struct('claim_text', ' ')))")
    fence = lambda label, body: F.concat(F.lit(f"Here:\n```{label}\n"), body, F.lit("\n```\nDone."))
    kind = F.col("turn") % 4
    raw = F.when(kind == 0, said).when(kind == 1, fence("json", other)).when(kind == 2, fence("", said)).otherwise("no claims here")
    return io.parse_claims(table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw")))


_GRAPH_RAW = """to_json(named_struct('entities', transform(sequence(1, 12), i -> named_struct('name', CASE WHEN i = 3 THEN ' ' ELSE concat(' ', c_name, ' ', i) END, 'type', CASE WHEN i % 2 = 0 THEN c_mktsegment END)),
'relations', transform(sequence(1, 12), i -> named_struct('source', c_name, 'target', CASE WHEN i = 4 THEN '' ELSE concat('t', i) END, 'relation', CASE WHEN i % 3 = 0 THEN 'owns' END))))"""


@query("""WITH i AS (SELECT c_custkey, c_name, c_mktsegment, unnest(range(1, 11)) AS i FROM customer)
SELECT c_custkey, 'entity' AS kind, c_name || ' ' || i AS name, CASE WHEN i % 2 = 0 THEN c_mktsegment ELSE 'concept' END AS type FROM i WHERE i <> 3
UNION ALL SELECT c_custkey, 'relation', c_name || '>t' || i, CASE WHEN i % 3 = 0 THEN 'owns' ELSE 'related_to' END FROM i WHERE i <> 4""")
def parsed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve of each in a reply, of which ten count; blank names and missing types."""
    replies = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_GRAPH_RAW).alias("raw"))
    entities, relations = io.parse_graph(replies)
    links = relations.select("c_custkey", F.lit("relation").alias("kind"), F.concat_ws(">", "source", "target").alias("name"), F.col("relation").alias("type"))
    return entities.select("c_custkey", F.lit("entity").alias("kind"), "name", "type").unionByName(links)


# -- sinks


@query(f"WITH {CHUNKS} SELECT CASE WHEN chunk_index % 2 = 0 THEN 'own-' || chunk_id ELSE chunk_id END AS chunk_id, doc_id, text, doc_id % 4 AS kb_id FROM chunks")
def written_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, one folder a base; every second chunk has no id of its own."""
    path = _folder(spark, "chunks")
    own = F.when(F.col("chunk_index") % 2 == 0, F.concat(F.lit("own-"), "chunk_id"))
    chunks = chunking.fixed_chunks(table(spark, sf_dir, "documents")).withColumns({"chunk_id": own, "kb_id": F.col("doc_id") % 4})
    io.write_chunks(chunks.where("doc_id % 8 < 4"), path)
    io.write_chunks(chunks.where("doc_id % 8 >= 4"), path)
    return spark.read.parquet(path).select("chunk_id", "doc_id", "text", F.col("kb_id").cast("long").alias("kb_id"))


@query(f"WITH {_PAPER_CHUNKS}, s AS (SELECT doc_id, count(*) AS n_chunks FROM pc GROUP BY doc_id) SELECT doc_id, title, year, phase, topic, doi, chunk_id, n_chunks FROM pc JOIN s USING (doc_id) WHERE chunk_index = 0")
def document_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "documents")
    io.write_documents(_paper_chunks(spark, sf_dir), path)
    return spark.read.parquet(path).select("doc_id", "title", "year", "phase", "topic", "doi", "chunk_id", "n_chunks")


@query(_TABLE_SQL["retrieval_metrics"])
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a report that was written and read again."""
    path = _folder(spark, "report")
    per_query = materialize(stats.retrieval_metrics(_sparse(spark, sf_dir, 5), _truth(spark, sf_dir), 5), "per-query")
    io.write_report(stats.metrics_summary(per_query, text_queries(spark, sf_dir)), per_query, path)
    return spark.read.schema(per_query.schema).json(f"{path}/queries")


@query(f"WITH c AS ({_CORPUS_SQL['citation_table']}) SELECT * REPLACE (nullif(\"Year\", '') AS \"Year\", nullif(\"Title\", '') AS \"Title\", nullif(\"Journal\", '') AS \"Journal\", nullif(\"Phase\", '') AS \"Phase\") FROM c")
def citation_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine columns as a CSV file, read again; what is empty there is null."""
    path = _folder(spark, "citations")
    cited = citation_table(spark, sf_dir)
    io.write_csv(cited, path)
    kept = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    return spark.read.options(**kept).schema(cited.schema).csv(path)


# -- models of the caller


@query("SELECT doc_id, length(text) AS score FROM documents WHERE text IS NOT NULL")
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer that gives the code points of a text."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return io.with_model(docs, lambda frame: frame.assign(score=frame["text"].str.len())[["doc_id", "score"]], "doc_id long, score long")

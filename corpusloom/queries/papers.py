"""Authors, years, sections, plans, merged results and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.operators import chunking, dense, fusion, knowledge
from corpusloom.operators import text as T
from corpusloom.queries.fixtures import PAPERS, papers, query_vectors, table, vectors
from corpusloom.queries.search import _COSINE, _VECTORS
from corpusloom.queries.texts import _HEADED
from corpusloom.queries.views import ORACLES as _VIEW_SQL
from corpusloom.queries.views import related_by_first_chunk
from corpusloom.sources import tables as io

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- metadata

_SIGNED = """CASE doc_id % 5 WHEN 0 THEN 'A report by Karl M. Weber and others. ' WHEN 1 THEN 'Anna Keller* and  Jonas Stein† ' WHEN 2 THEN 'Maria Lang and Peter Brandt wrote. by Maria Lang ' WHEN 3 THEN 'by Review Board and Eva Sommer and Max Winter ' ELSE '' END || text"""
_FULL_NAME = "[A-Z][a-z]{2,12} (?:[A-Z]\\. ?)?[A-Z][a-z]{2,15}"
_BARRED = ", ".join(f"'{w}'" for w in P.NOT_NAMES)


@query(f"""WITH f AS (SELECT doc_id, regexp_replace(substr({_SIGNED}, 1, 2000), '\\s+', ' ', 'g') AS t FROM documents),
n AS (SELECT doc_id, list_concat(list_concat(regexp_extract_all(t, '\\b[Bb]y ({_FULL_NAME})', 1), regexp_extract_all(t, '({_FULL_NAME})[¹²³*†‡§]', 1)),
  flatten(list_transform(list_zip(regexp_extract_all(t, '({_FULL_NAME}) and ({_FULL_NAME})', 1), regexp_extract_all(t, '({_FULL_NAME}) and ({_FULL_NAME})', 2)), lambda z : [z[1], z[2]]))) AS l FROM f)
SELECT doc_id, array_to_string(list_filter(list_filter(l, lambda x, i : list_position(l, x) = i), lambda x : NOT list_has_any(string_split(lower(replace(x, '.', '')), ' '), [{_BARRED}]))[1:4], '; ') AS authors FROM n""")
def author_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = table(spark, sf_dir, "documents").select("doc_id", F.expr(_SIGNED).alias("text"))
    return signed.select("doc_id", F.array_join(T.text_authors(F.col("text")), "; ").alias("authors"))


_DATED = "CASE doc_id % 4 WHEN 0 THEN '© 2004 Press ' WHEN 1 THEN 'seen in 1850, 2099 and 1997 ' WHEN 2 THEN '© 1066 but 2010 ' ELSE '' END || text"


@query(f"""WITH f AS (SELECT doc_id, {_DATED} AS t FROM documents), y AS (SELECT doc_id, TRY_CAST(regexp_extract(t, '©\\s*([0-9]{{4}})', 1) AS INT) AS m,
  list_filter(list_transform(regexp_extract_all(t, '\\b(?:19|20)[0-9]{{2}}\\b'), lambda y : CAST(y AS BIGINT)), lambda y : y <= 2024)[1] AS p FROM f)
SELECT doc_id, CASE WHEN m BETWEEN 1900 AND 2024 THEN CAST(m AS BIGINT) ELSE p END AS year FROM y""")
def plain_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = table(spark, sf_dir, "documents").select("doc_id", F.expr(_DATED).alias("text"))
    return dated.select("doc_id", T.plain_year(F.col("text"), 2024).alias("year"))


@query()
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.expr(_HEADED))
    return chunking.section_chunks(T.sections(docs, P.SECTION_HEADINGS, P.EXPECTED_SECTIONS), P.SECTION_SIZES, overlap=300)


# -- questions

_FENCE = "chr(96) || chr(96) || chr(96)"
_REPLY = f"""CASE conv_id % 4 WHEN 0 THEN '{{"intent_type": "synthesis", "retrieval_strategy": "expanded", "sub_queries": ["a", "b", "c", "d", "e", "f"]}}'
  WHEN 1 THEN {_FENCE} || 'json' || chr(10) || '{{"intent_type": "guess", "sub_queries": []}}' || chr(10) || {_FENCE} WHEN 2 THEN 'no plan' ELSE '{{"retrieval_strategy": "single", "sub_queries": ["a"]}}' END"""


@query("""SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'synthesis' ELSE 'factual' END AS intent,
  CASE conv_id % 4 WHEN 0 THEN 'expanded' WHEN 1 THEN 'multi_query' ELSE 'single' END AS strategy,
  CASE conv_id % 4 WHEN 0 THEN 'a|b|c|d|e' WHEN 3 THEN 'a' ELSE text END AS sub_queries FROM conversations WHERE role = 'user'""")
def normalize_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), F.expr(_REPLY).alias("raw"))
    return io.parse_plans(asked).select("conv_id", "turn", "intent", "strategy", F.array_join("sub_queries", "|").alias("sub_queries"))


@query("""SELECT conv_id, turn, CAST(CASE turn % 3 WHEN 0 THEN 5 WHEN 1 THEN 7 ELSE greatest(2, 5 // greatest(1, conv_id % 4)) END AS BIGINT) AS n_results FROM conversations WHERE role = 'user'""")
def result_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    level = F.when(F.col("turn") % 3 == 0, "simple").when(F.col("turn") % 3 == 1, "medium").otherwise("complex")
    return asked.select("conv_id", "turn", fusion.result_limit(level, 5, F.col("conv_id") % 4).alias("n_results"))


# -- results


@query(f"""WITH {_VECTORS}, {PAPERS}, s AS (SELECT query_id, chunk_id, label, round({_COSINE}, 6) AS distance FROM vectors, qv),
h AS (SELECT query_id, chunk_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label % 2 ORDER BY distance, chunk_id) AS n FROM s) WHERE n <= 10),
r AS (SELECT query_id, chunk_id, topic AS doc_id, round((1 - distance) * CASE WHEN total_pages BETWEEN 1 AND 4 THEN 0.7::DOUBLE ELSE 1 END * CASE WHEN doi IS NULL THEN 1 ELSE 1.05::DOUBLE END, 6) AS score FROM h JOIN papers ON papers.doc_id = chunk_id),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id) AS n FROM r)
SELECT query_id, rank, chunk_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b WHERE n = 1) WHERE rank <= 5""")
def merge_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits among even and among odd labels, merged; the source stands for the document."""
    about = papers(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("topic").alias("doc_id"), "total_pages", "doi")
    hits = lambda odd: dense.dense_topk(query_vectors(spark, sf_dir), vectors(spark, sf_dir).where(f"label % 2 = {odd}").drop("doc_id")).join(about, "chunk_id")
    return fusion.merge_results(hits(0), hits(1)).select("query_id", "rank", "chunk_id", "doc_id", "score")


@query(f"""WITH rel AS ({_VIEW_SQL["related_by_first_chunk"]}), d AS (SELECT doc_id AS related_doc_id, lang, source FROM documents WHERE doc_id % 3 <> 0)
SELECT rel.doc_id, related_doc_id, round(1 - distance, 4) AS score, lang, source, row_number() OVER (PARTITION BY rel.doc_id ORDER BY round(1 - distance, 4) DESC, related_doc_id) AS place FROM rel LEFT JOIN d USING (related_doc_id)""")
def list_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = related_by_first_chunk(spark, sf_dir).select("doc_id", "related_doc_id", F.round(1 - F.col("distance"), 4).alias("score"))
    return dense.list_relations(relations, table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select("doc_id", "lang", "source"))


@query()
def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.text_vectors(table(spark, sf_dir, "documents"), "doc_id")


_RUNS = """SELECT DISTINCT case_id, w || ' ' || w2 || ' ' || w3 AS run FROM (SELECT case_id, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM
  (SELECT case_id, unnest({0}) AS w, generate_subscripts({0}, 1) AS i FROM r) WINDOW o AS (PARTITION BY case_id ORDER BY i)) WHERE w3 IS NOT NULL UNION ALL SELECT case_id, array_to_string({0}, ' ') FROM r WHERE len({0}) BETWEEN 1 AND 2"""


@query(f"""WITH w AS (SELECT doc_id, string_split(text, ' ') AS s FROM documents), c AS (SELECT doc_id, array_to_string(s[3:22], ' ') AS q FROM w),
q AS (SELECT doc_id AS case_id, doc_id, CASE WHEN doc_id % 6 = 3 THEN replace(q, 'e', 'y') ELSE q END AS quote FROM c),
r AS (SELECT case_id, list_filter(regexp_split_to_array(lower(quote), '\\s+'), lambda x : x <> '') AS q, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x : x <> '') AS t FROM q JOIN documents USING (doc_id)),
qr AS ({_RUNS.format("q")}), tr AS ({_RUNS.format("t")}),
s AS (SELECT case_id, count(tr.run) / count(*)::DOUBLE AS s FROM qr LEFT JOIN tr USING (case_id, run) GROUP BY case_id)
SELECT case_id, round(coalesce(s, 0), 6) AS similarity, round(coalesce(s, 0), 6) > 0.6 AS close FROM r LEFT JOIN s USING (case_id)""")
def quote_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty words of every text, some of them with other letters."""
    docs = table(spark, sf_dir, "documents")
    quote = F.array_join(F.slice(F.split("text", " "), 3, 20), " ")
    changed = F.when(F.col("doc_id") % 6 == 3, F.replace(quote, F.lit("e"), F.lit("y"))).otherwise(quote)
    return knowledge.quote_similarity(docs.select(F.col("doc_id").alias("case_id"), "doc_id", changed.alias("quote")), docs)

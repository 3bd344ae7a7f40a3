"""Metadata by priority, expansion, insights, verdicts and lifecycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import chunking, dense, fusion, knowledge, stats, tenancy
from corpusloom.operators import text as T
from corpusloom.queries.fixtures import CHUNKS, PAPERS, papers, table, vectors
from corpusloom.queries.search import _COSINE, _SCORED, _VECTORS, _sparse
from corpusloom.queries.tables import _ANSWERS, _BASES, _BROAD, _EVIDENCE, _TOO_BROAD, _TRUTH, _bases, _evidence, _truth

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- metadata


@query(r"""SELECT doc_id, regexp_replace(list_filter(list_transform(string_split(text, chr(10))[1:20], lambda l : trim(l)), lambda l : length(l) BETWEEN 15 AND 150 AND regexp_matches(l, '^\p{Lu}')
  AND 10 * length(regexp_replace(l, '[^0-9]', '', 'g')) <= 3 * length(l) AND NOT regexp_matches(lower(l), 'page|http|www\.|@|copyright|confidential'))[1], '\s+', ' ', 'g') AS title FROM documents""")
def plain_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.plain_title(F.col("text")).alias("title"))


_WITH_ABSTRACT = "'Some heading' || chr(10) || 'Abstract: ' || text || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'Keywords: a' WHEN 1 THEN 'Introduction' ELSE 'Other' END"


@query(rf"""SELECT doc_id, CASE WHEN length(a) > 50 THEN substr(a, 1, 2000) END AS abstract FROM (
  SELECT doc_id, trim(regexp_replace(regexp_extract({_WITH_ABSTRACT}, '(?is)\b(?:abstract|summary)[\s:-]+(.*?)\n\s*(?:keywords?|introduction|background|1\.)', 1), '\s+', ' ', 'g')) AS a FROM documents)""")
def abstract_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.abstract_block(F.expr(_WITH_ABSTRACT)).alias("abstract"))


_FOUND = [
    "doc_id",
    "CASE WHEN doc_id % 3 = 0 THEN year END AS name_year",
    "CASE WHEN doc_id % 2 = 0 THEN year - 1 END AS text_year",
    "2000 + doc_id % 40 AS file_year",
    "CASE WHEN doc_id % 5 = 0 THEN title END AS file_title",
    "CASE WHEN doc_id % 7 = 0 THEN 'text ' || title END AS text_title",
    "'file ' || doc_id AS name_title",
    "CASE WHEN doc_id % 4 = 0 THEN first_author END AS name_authors",
    "CASE WHEN doc_id % 3 = 1 THEN second_author END AS text_authors",
]


@query(f"""WITH {PAPERS}, f AS (SELECT {", ".join(_FOUND)} FROM papers)
SELECT doc_id, coalesce(name_year, text_year, CASE WHEN file_year < 2024 THEN file_year END) AS year, coalesce(file_title, text_title, name_title) AS title, coalesce(name_authors, text_authors) AS authors FROM f""")
def merge_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.merge_metadata(papers(spark, sf_dir).selectExpr(*_FOUND), 2024)


@query(f"""WITH {PAPERS}, f AS (SELECT doc_id, nullif(CASE WHEN doc_id % 9 = 0 THEN '' ELSE first_author || ', ' || second_author END, '') AS flat FROM papers)
SELECT doc_id, flat, len(list_filter(list_transform(string_split(flat, ','), lambda n : trim(n)), lambda n : n <> '')) AS n FROM f""")
def flat_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists written as strings for export, and how many entries come back."""
    names = F.when(F.col("doc_id") % 9 == 0, F.array().cast("array<string>")).otherwise(F.array("first_author", "second_author"))
    flat = papers(spark, sf_dir).select("doc_id", T.flat_list(names).alias("flat"))
    back = T.split_list(F.col("flat"))
    return flat.select("doc_id", "flat", F.when(back.isNotNull(), F.size(back)).cast("long").alias("n"))


# -- search


@query(f"""WITH {_VECTORS}, asked AS (SELECT v.doc_id AS query_id, arg_min(embedding, chunk_id) AS q FROM vectors v GROUP BY v.doc_id),
near AS (SELECT query_id, doc_id, min(d) AS distance FROM (SELECT query_id, doc_id, {_COSINE} AS d FROM vectors, asked WHERE doc_id <> query_id) GROUP BY ALL)
SELECT query_id AS doc_id, doc_id AS related_doc_id, rank, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM near) WHERE rank <= 5""")
def related_by_first_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return dense.related_by_first_chunk(rows, rows)


@query(f"""WITH {_SCORED}, h AS (SELECT query_id // 4 AS parent_id, query_id % 4 AS sub, rank, chunk_id, source AS doc_id, score FROM sparse JOIN documents ON doc_id = chunk_id),
u AS (SELECT * FROM h WHERE (sub = 0 AND rank <= 8) OR (sub BETWEEN 1 AND 3 AND rank <= 3)),
g AS (SELECT parent_id, doc_id, score, min(chunk_id) AS chunk_id FROM u GROUP BY ALL)
SELECT parent_id, doc_id, score, chunk_id, row_number() OVER (PARTITION BY parent_id ORDER BY score DESC, doc_id) AS rank FROM g""")
def expanded_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four passages in a row are a question and its three sub-queries; the source stands for the document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"))
    hits = _sparse(spark, sf_dir, 8).join(docs, "chunk_id").select(F.floor(F.col("query_id") / 4).alias("parent_id"), (F.col("query_id") % 4).alias("sub"), "rank", "chunk_id", "doc_id", "score")
    return fusion.expanded(hits.where("sub = 0").drop("sub"), hits.where("sub > 0").withColumn("sub", F.col("sub") - 1))


_GRAPH = """occ AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS name FROM documents),
edges AS (SELECT DISTINCT name AS source, substr(name, 1, 4) AS target FROM occ WHERE length(name) > 4)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All words of four letters or more as entities, tied to their stems."""
    names = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), 0))
    occ = table(spark, sf_dir, "documents").select("doc_id", names.alias("name")).distinct()
    return occ, occ.where("length(name) > 4").select(F.col("name").alias("source"), F.substring("name", 1, 4).alias("target")).distinct()


@query(f"""WITH {_SCORED}, {_GRAPH}, seeds AS (SELECT query_id, chunk_id AS doc_id FROM sparse WHERE rank <= 3),
e0 AS (SELECT query_id, name FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY name) AS n FROM (SELECT DISTINCT query_id, name FROM seeds JOIN occ USING (doc_id))) WHERE n <= 30),
e1 AS (SELECT * FROM e0 UNION SELECT query_id, target FROM e0 JOIN edges ON source = name UNION SELECT query_id, source FROM e0 JOIN edges ON target = name)
SELECT query_id, name FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY name) AS n FROM e1) WHERE n <= 12""")
def graph_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ, edges = _graph(spark, sf_dir)
    return knowledge.expand_by_graph(_sparse(spark, sf_dir, 3).select("query_id", F.col("chunk_id").alias("doc_id")), occ, edges)


@query(f"""WITH {_GRAPH}, n AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS name FROM benchmark) SELECT name, doc_id FROM occ WHERE name IN (SELECT name FROM n)""")
def documents_of_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the entities that the benchmark names."""
    names = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("name"))
    return knowledge.documents_of_entities(_graph(spark, sf_dir)[0], names)


# -- insights

_INSIGHTS = f"""{_EVIDENCE}, claims AS (SELECT query_id AS claim_id, query_id // 50 * 3 AS doc_id FROM ev),
gaps AS (SELECT query_id AS claim_id, CASE WHEN best_score < 0.25 THEN 'missing_evidence' WHEN evidence < 2 THEN 'weak_coverage' ELSE 'none' END AS gap FROM ev),
dc AS (SELECT doc_id, doc_id % 7 AS component FROM documents WHERE doc_id % 2 = 0),
view AS (SELECT claim_id, doc_id, component, CAST(coalesce(n_gaps, 0) AS BIGINT) AS n_gaps, kinds FROM claims LEFT JOIN (SELECT claim_id, count(*) AS n_gaps, string_agg(DISTINCT gap, ',' ORDER BY gap) AS kinds FROM gaps WHERE gap <> 'none' GROUP BY claim_id) USING (claim_id) LEFT JOIN dc USING (doc_id))"""


def _insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = knowledge.evidence_gaps(_evidence(spark, sf_dir)).withColumnRenamed("query_id", "claim_id")
    claims = gaps.select("claim_id", (F.expr("claim_id div 50") * 3).alias("doc_id"))
    clusters = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") % 7).alias("component"))
    return knowledge.insights_view(claims, gaps, clusters)


@query(f"WITH {_INSIGHTS} SELECT * FROM view")
def insights_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _insights(spark, sf_dir)


@query(f"WITH {_INSIGHTS} SELECT component, count(*) AS n_claims, count(DISTINCT doc_id) AS n_docs, count(*) FILTER (n_gaps > 0) AS with_gap FROM view GROUP BY component")
def claims_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.claims_by_cluster(_insights(spark, sf_dir))


@query(f"""WITH {_EVIDENCE}, b AS (SELECT query_id, rank, n.chunk_id % 50 AS doc_id, coalesce(p.title, '') AS title, greatest(0.0::DOUBLE, round(1 - distance, 6)) AS score, substr(coalesce(text, ''), 1, 300) AS snippet
  FROM near n LEFT JOIN ({PAPERS.replace("papers AS (", "", 1)[:-1]}) p ON p.doc_id = n.chunk_id WHERE rank <= 2)
SELECT query_id, CAST(to_json(list({{'doc_id': doc_id, 'title': title, 'score': score, 'snippet': snippet}} ORDER BY rank)) AS VARCHAR) AS snippets FROM b GROUP BY query_id""")
def evidence_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = papers(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "title", "text")
    return knowledge.evidence_snippets(_evidence(spark, sf_dir), texts)


_ISSUES = f"""answers AS (SELECT conv_id, turn, {_ANSWERS} AS t, {_BROAD} AS b FROM conversations WHERE role = 'assistant'),
issues AS (SELECT conv_id, turn, 1 AS kind FROM answers WHERE contains(t, 'Nobody (') UNION ALL SELECT conv_id, turn, 2 FROM answers WHERE regexp_matches(lower(b), '{_TOO_BROAD}'))"""


@query(f"""WITH {_ISSUES}, n AS (SELECT conv_id, turn, count(*) AS n FROM issues GROUP BY ALL)
SELECT conv_id, turn, coalesce(n, 0) AS issues, coalesce(n, 0) = 0 AS valid, CASE WHEN coalesce(n, 0) = 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS accuracy, coalesce(n, 0) >= 2 AS hallucination, coalesce(n, 0) = 0 AS passed FROM (SELECT conv_id, turn FROM answers) LEFT JOIN n USING (conv_id, turn)""")
def answer_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.expr(_ANSWERS).alias("t"), F.expr(_BROAD).alias("b"))
    unknown = answers.where("contains(t, 'Nobody (')").select("conv_id", "turn")
    broad = answers.where(knowledge.overgeneral(F.col("b"))).select("conv_id", "turn")
    return knowledge.answer_verdict(answers.select("conv_id", "turn"), unknown.unionByName(broad), ["conv_id", "turn"])


@query(f"""WITH {_ISSUES}, n AS (SELECT conv_id, turn, count(*) AS n FROM issues GROUP BY ALL),
v AS (SELECT conv_id, turn, CAST(coalesce(n, 0) AS BIGINT) AS issues, CASE WHEN turn % 5 <> 0 THEN (turn % 3) / 10.0::DOUBLE + 0.75 END AS score FROM (SELECT conv_id, turn FROM answers) LEFT JOIN n USING (conv_id, turn))
SELECT conv_id, turn, issues, issues = 0 AS valid, (CASE WHEN score IS NOT NULL THEN greatest(0.0, round(score - 0.1 * issues, 6)) WHEN issues = 0 THEN 0.9 ELSE 0.5 END)::DOUBLE AS accuracy, issues >= 2 AS hallucination,
  CASE WHEN score IS NULL THEN issues = 0 ELSE greatest(0.0, round(score - 0.1 * issues, 6)) >= 0.8 AND issues < 2 END AS passed FROM v""")
def scored_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts where a model has scored four answers in five."""
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.expr(_ANSWERS).alias("t"), F.expr(_BROAD).alias("b"))
    unknown = answers.where("contains(t, 'Nobody (')").select("conv_id", "turn")
    broad = answers.where(knowledge.overgeneral(F.col("b"))).select("conv_id", "turn")
    scored = answers.select("conv_id", "turn", F.when(F.col("turn") % 5 != 0, F.col("turn") % 3 / 10 + 0.75).alias("score"))
    return knowledge.answer_verdict(scored, unknown.unionByName(broad), ["conv_id", "turn"], "score")


@query(f"""WITH {PAPERS}, a AS (SELECT conv_id, turn, {_ANSWERS} AS t FROM conversations WHERE role = 'assistant'),
c AS (SELECT DISTINCT conv_id, turn, p[1] AS author, p[2] AS year FROM (SELECT conv_id, turn, unnest(list_zip(regexp_extract_all(t, '([A-Z][A-Za-z0-9]+) \\(([0-9]{{4}})\\)', 1), regexp_extract_all(t, '([A-Z][A-Za-z0-9]+) \\(([0-9]{{4}})\\)', 2))) AS p FROM a)),
s AS (SELECT lower(first_author || ', ' || second_author) AS authors, CAST(year AS VARCHAR) AS y, min(doc_id) AS d FROM papers GROUP BY ALL)
SELECT conv_id, turn, author, c.year, (SELECT min(d) FROM s WHERE contains(authors, lower(c.author)) AND contains(y, c.year)) AS doc_id FROM c""")
def citation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("text", F.expr(_ANSWERS))
    sources = papers(spark, sf_dir).select(F.concat_ws(", ", "first_author", "second_author").alias("authors"), "year", "doc_id")
    return knowledge.look_up_citations(knowledge.cited_pairs(answers, ["conv_id", "turn"]), sources, ["conv_id", "turn"])


# -- statistics


@query(f"""WITH {_SCORED}, {_TRUTH}, cited AS (SELECT query_id, chunk_id FROM sparse WHERE rank <= 3),
c AS (SELECT query_id, count(*) AS c FROM cited JOIN truth USING (query_id, chunk_id) GROUP BY query_id)
SELECT query_id, count(*) AS citations, CASE WHEN query_id IN (SELECT query_id FROM truth) THEN coalesce(any_value(c), 0) END AS correct,
  round(CASE WHEN query_id IN (SELECT query_id FROM truth) THEN coalesce(any_value(c), 0) END / count(*)::DOUBLE, 4) AS correctness FROM cited LEFT JOIN c USING (query_id) GROUP BY query_id""")
def citation_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.citation_correctness(_sparse(spark, sf_dir, 3), _truth(spark, sf_dir))


@query("""WITH m AS (SELECT event_type, avg(value) FILTER (user_id % 2 = 0) AS a, avg(value) FILTER (user_id % 2 <> 0) AS b FROM events GROUP BY event_type)
SELECT event_type, round(a, 6) AS with_feature, round(b, 6) AS without, round(a - b, 6) AS difference, round(100 * (a - b) / nullif(b, 0), 6) AS percent FROM m""")
def ab_overhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.overhead(table(spark, sf_dir, "events"), "event_type", F.col("user_id") % 2 == 0, "value")


@query(f"WITH {PAPERS} SELECT topic, year, count(*) AS n FROM papers GROUP BY topic, year")
def year_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distribution(papers(spark, sf_dir), "topic", "year")


# -- lifecycles


@query(f"""WITH {CHUNKS}, {_BASES}, gone AS (SELECT kb_id FROM bases WHERE status = 'deleted') SELECT chunk_id, doc_id % 4 AS kb_id FROM chunks WHERE doc_id % 4 NOT IN (SELECT kb_id FROM gone)""")
def clear_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.fixed_chunks(table(spark, sf_dir, "documents")).select("chunk_id", (F.col("doc_id") % 4).alias("kb_id"))
    return tenancy.clear_base({"chunks": chunks}, _bases(spark).where("status = 'deleted'"))["chunks"].select("chunk_id", "kb_id")


@query("SELECT c_custkey AS kb_id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'deleted' ELSE c_mktsegment END AS status FROM customer")
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("kb_id"), F.col("c_mktsegment").alias("status"))
    return tenancy.soft_delete(bases, table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("kb_id")))


@query("""SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, arg_min(substr(text, 1, 80), (turn, text)) FILTER (role = 'user') AS title FROM conversations GROUP BY conv_id""")
def chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenancy.sessions(table(spark, sf_dir, "conversations"))


@query("""SELECT conv_id, messages, last_turn, title, row_number() OVER (ORDER BY last_turn DESC, conv_id) AS place FROM (
  SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, arg_min(substr(text, 1, 80), (turn, text)) FILTER (role = 'user') AS title FROM conversations GROUP BY conv_id)
ORDER BY place OFFSET 20 LIMIT 20""")
def chat_session_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second twenty chats, the last updated first."""
    return tenancy.session_page(tenancy.sessions(table(spark, sf_dir, "conversations")), 1, 20)


#: The citations of answers; some are null, empty or broken.
_CITATIONS = """CASE WHEN role <> 'assistant' OR conv_id % 5 = 0 THEN NULL WHEN conv_id % 5 = 1 THEN '' WHEN conv_id % 5 = 2 THEN '[{{"doc_id": "broken' WHEN conv_id % 5 = 3 THEN '[]'
  ELSE concat('[{{"doc_id": "d', conv_id, '", "title": "Title ', turn, '"}}, {{"doc_id": "e', turn, '", "title": "Second", "page": 3}}]') END"""


@query(f"""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, role, text,
  CASE WHEN json_valid(c) THEN array_to_string(CAST(json_extract_string(c, '$[*].doc_id') AS VARCHAR[]), '|') ELSE '' END AS doc_ids,
  CASE WHEN json_valid(c) THEN array_to_string(CAST(json_extract_string(c, '$[*].title') AS VARCHAR[]), '|') ELSE '' END AS titles
FROM (SELECT *, nullif({_CITATIONS.format()}, '') AS c FROM conversations)""")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").withColumn("citations", F.expr(_CITATIONS.format()))
    return tenancy.chat_messages(talk).withColumns({c: F.array_join(c, "|") for c in ("doc_ids", "titles")})

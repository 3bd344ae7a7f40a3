"""File names, plain documents, entities, insights, exports, and whole retrieval plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import plans
from corpusloom.functions import patterns as P
from corpusloom.operators import bm25, chunking, filters, formatting, fusion, knowledge, stats
from corpusloom.operators import text as T
from corpusloom.queries.fixtures import PAPERS, paired_vectors, papers, table, text_queries, vectors
from corpusloom.queries.search import _HYBRID, _SCORED, _fused, _index, _sparse
from corpusloom.queries.tables import _ANSWERS, _CITED, _PAPER_CHUNKS, _TRUTH, _evidence, _paper_chunks, _truth
from corpusloom.queries.tables import ORACLES as _TABLE_SQL
from corpusloom.queries.texts import _NOISY, _TYPED, noisy
from corpusloom.queries.texts import ORACLES as _TEXT_SQL
from corpusloom.queries.views import _GRAPH, _INSIGHTS, _graph, _insights
from corpusloom.session import materialize

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- file names and plain documents

_FILE = """CASE doc_id % 8 WHEN 0 THEN 'in/2012_Keller_Report' WHEN 1 THEN 'Stein-2011' WHEN 2 THEN 'Keller_Stein_2010' WHEN 3 THEN 'brandt2009_x' WHEN 4 THEN '2013-Paper-Winter 2014'
  WHEN 5 THEN 'Review_2003 final' WHEN 6 THEN 'Wolf 1899' ELSE 'notes' END || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '' ELSE '.v2.docx' END"""
_BARRED = "[" + ", ".join(f"'{w}'" for w in P.NOT_NAMES) + "]"
_NAMES = "list_filter([{0}], lambda x : length(x) >= 3 AND NOT list_contains(" + _BARRED + ", lower(x)))"


def _case(pattern: str, *groups: int) -> str:
    found = ", ".join(f"upper(regexp_extract(s, '{pattern}', {g})[1]) || regexp_extract(s, '{pattern}', {g})[2:]" for g in groups)
    return f"CASE WHEN len({_NAMES.format(found)}) > 0 THEN {_NAMES.format(found)} END"


_TWO = "^([A-Z][a-z]{2,20})[_\\-\\s]+([A-Z][a-z]{2,20})[_\\-\\s]+[0-9]{4}"


@query(f"""WITH f AS (SELECT doc_id, {_FILE} AS name FROM documents), n AS (SELECT doc_id, regexp_replace(regexp_extract(name, '([^/]*)$', 1), '\\.[^.]*$', '') AS s FROM f),
y AS (SELECT *, TRY_CAST(regexp_extract(s, '\\b((?:19|20)[0-9]{{2}})\\b', 1) AS BIGINT) AS y FROM n)
SELECT doc_id, CASE WHEN y BETWEEN 1950 AND 2024 THEN y END AS year, array_to_string(coalesce({_case("^[0-9]{4}[_\\-\\s]+([A-Z][a-z]{2,20})", 1)}, {_case("^([A-Z][a-z]{2,20})[_\\-\\s]+[0-9]{4}", 1)},
  {_case(_TWO, 1, 2)}, {_case("^([a-z]{3,20})[0-9]{4}", 1)}), ';') AS authors FROM y""")
def filename_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").select("doc_id", F.expr(_FILE).alias("name"))
    return names.select("doc_id", T.filename_year(F.col("name"), 2024).alias("year"), F.array_join(T.filename_authors(F.col("name")), ";").alias("authors"))


_PLAIN = """'Vol 3' || chr(10) || CASE WHEN doc_id % 4 <> 3 THEN 'A Study of Rivers ' || doc_id || chr(10) ELSE '' END || CASE doc_id % 5 WHEN 0 THEN 'Anna Keller and Jonas Stein2' WHEN 1 THEN 'University of X' || chr(10) || 'Maria  Lang; P. Brandt, Sandra Anders'
  WHEN 2 THEN 'a@b.de' || chr(10) || 'Abstract' || chr(10) || 'By Max Winter & Eva Sommer' WHEN 3 THEN 'Received today' ELSE 'one' END || chr(10) || 'Introduction' || chr(10) || text"""
_TITLE = "'a study of RIVERS ' || doc_id"


@query(f"""WITH l AS (SELECT doc_id, {_TITLE} AS title, list_filter(list_transform(string_split({_PLAIN}, chr(10)), lambda x : trim(x)), lambda x : x <> '') AS lines FROM documents),
s AS (SELECT *, coalesce(list_position(list_transform(lines[1:40], lambda x : contains(lower(x), lower(title))), TRUE), 0) AS start FROM l),
n AS (SELECT *, lines[start + 1:start + 8] AS near FROM s),
k AS (SELECT *, coalesce(list_position(list_transform(near, lambda x : regexp_matches(x, '(?i){P.AUTHOR_STOPS}')), TRUE), 0) AS stop FROM n),
f AS (SELECT *, list_filter(CASE WHEN stop > 0 THEN near[1:stop - 1] ELSE near END, lambda x : NOT contains(x, '@') AND NOT regexp_matches(x, '(?i){P.AFFILIATIONS}') AND length(x) BETWEEN 5 AND 120) AS fits FROM k),
w AS (SELECT doc_id, CASE WHEN len(fits) > 0 THEN array_to_string(fits, ' ') ELSE trim(list_filter(list_transform(lines[1:20], lambda x : regexp_extract(x, '(?i)^by\\s+(.+)$', 1)), lambda x : x <> '')[1]) END AS said FROM f),
a AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(regexp_replace(said, '\\s+', ' ', 'g'), '[0-9]+', '', 'g')), '(?i)\\s*(?:,|;|&|\\band\\b)\\s*'), lambda x : trim(x)),
  lambda x : regexp_matches(x, '\\S\\s+\\S') AND regexp_matches(x, '[A-Za-z]')) AS names FROM w)
SELECT doc_id, CASE WHEN len(names) > 0 THEN array_to_string(names, ';') END AS authors FROM a""")
def plain_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_PLAIN).alias("text"), F.expr(_TITLE).alias("title"))
    return docs.select("doc_id", F.array_join(T.plain_authors(F.col("text"), F.col("title")), ";").alias("authors"))


_GENERIC = "text"
for _p in P.GENERIC_NOISE:
    _GENERIC = f"regexp_replace({_GENERIC}, '(?im){_p}', '', 'g')"


@query(f"""SELECT doc_id, array_to_string(list_filter(string_split({_GENERIC}, chr(10)), lambda l : length(trim(l)) >= 3
  AND length(regexp_replace(trim(l), '[^\\p{{L}}\\p{{N}} ]', '', 'g')) / length(trim(l)) >= 0.5), chr(10)) AS text FROM (SELECT doc_id, {_NOISY} AS text FROM documents)""")
def generic_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy(spark, sf_dir).select("doc_id", T.strip_generic_noise(F.col("text")).alias("text"))


@query(f"WITH d AS ({_TEXT_SQL['detect_doctype']}) SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'academic' WHEN 1 THEN 'business' ELSE doctype END AS kind FROM d")
def extractor_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases that name their extractor, one that says ``auto`` and one that says nothing."""
    kind = F.expr("CASE doc_id % 4 WHEN 0 THEN 'academic' WHEN 1 THEN 'business' WHEN 2 THEN 'auto' END")
    return table(spark, sf_dir, "documents").select("doc_id", T.extractor_kind(kind, F.expr(_TYPED)).alias("kind"))


# -- chunks


@query("SELECT doc_id, text, TRUE AS fits FROM documents WHERE length(text) > 0")
def chunk_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every document from its overlapping chunks, and whether all of them have the size asked for."""
    cut = chunking.recursive_chunks(table(spark, sf_dir, "documents"), ["doc_id"], size=1000, overlap=200)
    own = cut.select("doc_id", "position", F.expr("substring(chunk, shared + 1)").alias("own"), (F.length("chunk") <= 1000).alias("fits"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "own"))), lambda x: x["own"]), "")
    return own.groupBy("doc_id").agg(whole.alias("text"), F.min("fits").alias("fits"))


@query("SELECT doc_id, text, level FROM documents, (VALUES (0), (1), (2)) AS l(level) WHERE length(text) > 0")
def level_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every document from the chunks of each of three levels."""
    cut = chunking.level_chunks(table(spark, sf_dir, "documents"))
    place = F.transform(F.split("chunk_id", "_"), lambda n: n.cast("int"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("place"), "text"))), lambda x: x["text"]), "")
    return cut.groupBy("doc_id", "level").agg(whole.alias("text"))


@query("SELECT doc_id, doc_id % 3 = 0 AS by_section FROM documents WHERE length(trim(text)) >= 100")
def routed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are cut by section and which by level."""
    docs = table(spark, sf_dir, "documents").where("length(trim(text)) >= 100").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "section_aware").alias("method"))
    sections = docs.select("doc_id", F.lit(1).alias("section_no"), F.lit("abstract").alias("section_type"), F.col("text").alias("content"))
    cut = chunking.routed_chunks(docs, sections, P.SECTION_SIZES)
    return cut.groupBy("doc_id").agg(F.min(F.contains("chunk_id", F.lit("_section_"))).alias("by_section"))


# -- filters and statistics


@query(f"WITH {PAPERS} SELECT doc_id FROM papers WHERE contains(lower(concat_ws(' ', title, first_author, topic)), 'author3 src1')")
def citation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).where(filters.keyword_search("Author3 SRC1", "title", "first_author", "topic")).select("doc_id")


@query(f"WITH {PAPERS} SELECT doc_id FROM papers WHERE doi IS NOT NULL AND title <> '' AND year BETWEEN 1995 AND 2010")
def declared_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).where(filters.where({"doi": {"$exists": True}, "title": {"$exists": True}, "year": {"$gte": 1995, "$lte": 2010}})).select("doc_id")


@query(f"WITH {_PAPER_CHUNKS} SELECT coalesce(phase, 'Unknown') AS phase, count(*) AS n_chunks FROM pc GROUP BY 1")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counts_by(_paper_chunks(spark, sf_dir), "phase")


@query(f"WITH k AS ({_TABLE_SQL['kb_stats']}) SELECT CAST(sum(n_docs) AS BIGINT) AS n_docs, CAST(sum(n_chunks) AS BIGINT) AS n_chunks FROM k")
def base_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases = _paper_chunks(spark, sf_dir).groupBy("kb_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_chunks"))
    return stats.total_of(bases, "n_docs", "n_chunks")


@query(f"WITH {PAPERS} SELECT doc_id, title, year, topic FROM papers WHERE length(text) > 0")
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.document_metadata(_paper_chunks(spark, sf_dir), ["title", "year", "topic"])


@query("SELECT DISTINCT source AS topic FROM documents WHERE source IS NOT NULL")
def available_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.available(papers(spark, sf_dir), "topic")


@query(f"WITH r AS ({_TABLE_SQL['retrieval_metrics']}) SELECT (SELECT count(*) FROM benchmark) AS queries, count(*) AS labelled, round(coalesce(avg(precision), 0), 6) AS macro_precision, round(coalesce(sum(found) / sum(expected)::DOUBLE, 0), 6) AS micro_recall FROM r")
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = stats.retrieval_metrics(_sparse(spark, sf_dir, 5), _truth(spark, sf_dir), 5)
    return stats.metrics_summary(per, text_queries(spark, sf_dir))


_PLACES = {"North": ["nd", "th"], "South": ["que", "los"], "East": ["sch", "ein"]}
_FOCUS = "[" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{s}')" for s in subs) + f" THEN '{name}' END" for name, subs in _PLACES.items()) + "]"


@query(f"""WITH f AS (SELECT source AS topic, doc_id, list_filter({_FOCUS}, lambda x : x IS NOT NULL) AS l FROM documents)
SELECT topic, focus, count(DISTINCT doc_id) AS n_docs FROM (SELECT topic, doc_id, unnest(CASE WHEN len(l) > 0 THEN l ELSE ['Elsewhere'] END) AS focus FROM f) GROUP BY topic, focus""")
def topic_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = papers(spark, sf_dir).where("text is not null").withColumn("focus", T.geographic_focus(F.col("text"), _PLACES, "Elsewhere"))
    return stats.focus_statistics(docs, "topic", "focus")


# -- entities

_MENTIONS = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) + 1 AS paragraph FROM documents),
caps AS (SELECT doc_id, paragraph, array_to_string(list_transform(string_split(substr(l, 1, 60), ' '), lambda w : translate(w[1], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || lower(w[2:])), ' ') || substr(l, 61) AS l FROM lines),
mentions AS (SELECT DISTINCT doc_id, paragraph, unnest(regexp_extract_all(l, '[A-Z][a-z]+(?: [A-Z][a-z]+)+')) AS name FROM caps)"""
#: The queries of these names are registered beside the other tables.
ORACLES["entity_mentions"] = f"WITH {_MENTIONS} SELECT doc_id, paragraph, name FROM mentions"
ORACLES["entity_upsert"] = f"WITH {_MENTIONS} SELECT name, count(*) AS mentions, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM mentions GROUP BY name"
ORACLES["cooccurrence_edges"] = f"WITH {_MENTIONS} SELECT a.name AS source, b.name AS target, count(*) AS weight FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.paragraph = b.paragraph AND a.name < b.name GROUP BY ALL"

_ROWS = """SELECT event_id, user_id % 40 AS kb_id, event_type AS name, CASE event_id % 3 WHEN 0 THEN 'concept' WHEN 1 THEN 'place' END AS type, CASE WHEN event_id % 5 = 0 THEN 'c' || (event_id % 7) END AS cluster FROM events"""


@query(f"WITH r AS ({_ROWS}) SELECT kb_id, name, arg_min(type, event_id) FILTER (type IS NOT NULL) AS type, arg_max(cluster, event_id) FILTER (cluster IS NOT NULL) AS cluster, count(*) AS n FROM r GROUP BY kb_id, name")
def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first type and the last cluster of every name in a base."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id % 40 AS kb_id", "event_type AS name", "CASE event_id % 3 WHEN 0 THEN 'concept' WHEN 1 THEN 'place' END AS type", "CASE WHEN event_id % 5 = 0 THEN concat('c', event_id % 7) END AS cluster"
    )
    return knowledge.merge_entities(rows, ["kb_id", "name"], ["event_id"])


_KEPT = "kept AS (SELECT name FROM occ GROUP BY name HAVING count(*) >= 2)"


def _kept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occurrences and edges of :func:`_graph`, and the names of two documents or more."""
    occ, edges = _graph(spark, sf_dir)
    return occ, edges, occ.groupBy("name").agg(F.count("*").alias("n")).where("n >= 2").select("name")


@query(f"WITH {_GRAPH}, {_KEPT} SELECT doc_id, name FROM occ WHERE name IN (SELECT name FROM kept)")
def entity_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ, _, kept = _kept(spark, sf_dir)
    return knowledge.occurrences(occ, kept, ["name"]).select("doc_id", "name")


@query(f"WITH {_GRAPH}, {_KEPT} SELECT source, target, 1.0::DOUBLE AS weight FROM edges WHERE source IN (SELECT name FROM kept) AND target IN (SELECT name FROM kept)")
def known_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, kept = _kept(spark, sf_dir)
    return knowledge.known_edges(edges, kept).select("source", "target", "weight")


@query(f"WITH {_GRAPH} SELECT source, target FROM edges ORDER BY source, target LIMIT 2000")
def graph_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ, edges = _graph(spark, sf_dir)
    return knowledge.graph_listing(occ.select("name").distinct(), edges, _stems(occ))[1].select("source", "target")


def _stems(occ: DataFrame) -> DataFrame:
    """Names by their first letters, which is what ties them."""
    return occ.select(F.substring("name", 1, 4).alias("component"), "name").distinct()


@query(f"WITH {_GRAPH} SELECT DISTINCT name FROM occ ORDER BY name LIMIT 1000")
def graph_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ, edges = _graph(spark, sf_dir)
    return knowledge.graph_listing(occ.select("name").distinct(), edges, _stems(occ))[0]


@query(f"WITH {_GRAPH} SELECT substr(name, 1, 4) AS component, count(DISTINCT name) AS size FROM occ GROUP BY 1 ORDER BY size DESC, component LIMIT 100")
def graph_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest clusters first."""
    occ, edges = _graph(spark, sf_dir)
    return knowledge.graph_listing(occ.select("name").distinct(), edges, _stems(occ), groups=100)[2]


@query(f"""WITH {_GRAPH}, k AS (SELECT DISTINCT name FROM (SELECT source AS name FROM edges UNION SELECT target FROM edges) ORDER BY name LIMIT 200)
SELECT source, target FROM edges WHERE source IN (SELECT name FROM k) AND target IN (SELECT name FROM k) ORDER BY source, target LIMIT 400""")
def graph_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = _graph(spark, sf_dir)
    nodes = edges.select(F.col("source").alias("name")).unionByName(edges.select(F.col("target").alias("name")))
    return knowledge.induced_subgraph(nodes, edges)


@query("""WITH e AS (SELECT c_custkey AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS cluster FROM customer)
SELECT name, coalesce(cluster, (SELECT min(o_orderpriority) FROM orders WHERE o_custkey = name)) AS cluster FROM e""")
def filled_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("cluster"))
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.min("o_orderpriority").alias("cluster"))
    return knowledge.fill_clusters(entities, found)


@query("""WITH r AS (SELECT DISTINCT 'cluster_' || (o_custkey % 20) AS cluster, o_orderpriority AS relation FROM orders UNION SELECT DISTINCT 'cluster_' || (o_orderkey % 20), o_orderpriority FROM orders)
SELECT cluster, string_agg(relation, ', ' ORDER BY relation) AS relations FROM r GROUP BY cluster""")
def cluster_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    edges = orders.select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"), F.col("o_orderpriority").alias("relation"))
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    return knowledge.cluster_relations(nodes.withColumn("cluster", F.concat(F.lit("cluster_"), F.col("node") % 20)), edges)


# -- insights


@query("""WITH recent AS (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 50), c AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS claim_no, unnest(string_split(text, chr(10))) AS claim FROM documents)
SELECT doc_id, claim_no, claim FROM c WHERE doc_id IN (SELECT doc_id FROM recent) AND claim_no < 8""")
def claims_to_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as claims, the longest documents as the newest."""
    docs = table(spark, sf_dir, "documents")
    claims = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("claim_no", "claim")).withColumn("claim_no", F.col("claim_no").cast("long"))
    return knowledge.claims_to_check(claims, docs.withColumn("added", F.col("n_chars")))


@query(f"WITH {_INSIGHTS} SELECT (SELECT count(*) FROM documents) AS documents_processed, (SELECT count(*) FROM claims) AS claims_extracted, (SELECT count(*) FROM gaps WHERE gap <> 'none') AS gaps_detected")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = knowledge.evidence_gaps(_evidence(spark, sf_dir))
    return knowledge.run_summary(table(spark, sf_dir, "documents"), gaps, gaps)


@query(f"WITH {_INSIGHTS} SELECT count(DISTINCT claim_id) FILTER (gap = 'missing_evidence') AS missing, count(DISTINCT claim_id) FILTER (gap = 'weak_coverage') AS weak FROM gaps")
def gap_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.gap_counters(knowledge.evidence_gaps(_evidence(spark, sf_dir)).withColumnRenamed("query_id", "claim_id"))


@query(f"""WITH {_INSIGHTS}, g AS (SELECT component, count(*) AS n_claims, string_agg(CAST(claim_id AS VARCHAR), ',' ORDER BY claim_id) AS claims FROM view WHERE component IS NOT NULL GROUP BY component)
SELECT *, row_number() OVER (ORDER BY n_claims DESC, component) AS place FROM g""")
def claim_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.claim_groups(_insights(spark, sf_dir))


# -- exports


@query(f"""WITH {_SCORED}, {PAPERS} SELECT query_id, rank, doc_id, title, CAST(round(CAST(score AS DECIMAL(18, 6)), 4) AS DOUBLE) AS score, substr(coalesce(text, ''), 1, 500) AS content FROM sparse JOIN papers ON doc_id = chunk_id WHERE rank <= 5""")
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _sparse(spark, sf_dir, 5).join(papers(spark, sf_dir), F.col("chunk_id") == F.col("doc_id"))
    return formatting.result_rows(hits, ["doc_id", "title"])


@query(f"""WITH {PAPERS} SELECT doc_id, first_author || ', ' || second_author AS "Author", coalesce(CAST(year AS VARCHAR), '') AS "Year", title AS "Title", 'article' AS "Source_Type", coalesce(doi, '') AS "Journal",
CAST(total_pages AS VARCHAR) AS "Pages", coalesce(phase, '') AS "Phase", 'd' || doc_id || '.pdf' AS "Filename", {_CITED} AS "APA_Citation" FROM papers""")
def citation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = papers(spark, sf_dir).withColumns({"authors": F.array("first_author", "second_author"), "source_type": F.lit("article"), "journal": F.col("doi"), "filename": F.concat(F.lit("d"), "doc_id", F.lit(".pdf"))})
    return formatting.citation_table(docs)


@query()
def page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for pages."""
    pages = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return formatting.page_map(pages.select("doc_id", (F.col("pos") + 1).alias("page_no"), "text"))


@query(f"""WITH m AS ({_TABLE_SQL["chat_markdown"]}), c AS (SELECT conv_id, p[1] || ' (' || p[2] || ')' AS entry, min(turn) AS turn FROM (
  SELECT conv_id, turn, unnest(list_zip(regexp_extract_all(t, '([A-Z][A-Za-z0-9]+) \\(([0-9]{{4}})\\)', 1), regexp_extract_all(t, '([A-Z][A-Za-z0-9]+) \\(([0-9]{{4}})\\)', 2))) AS p
  FROM (SELECT conv_id, turn, {_ANSWERS} AS t FROM conversations WHERE role = 'assistant')) GROUP BY ALL),
l AS (SELECT conv_id, string_agg(n || '. ' || entry, chr(10) ORDER BY n) AS listed FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, entry) AS n FROM c) GROUP BY conv_id)
SELECT conv_id, markdown || coalesce(chr(10) || chr(10) || '## References' || chr(10) || chr(10) || listed, '') AS markdown FROM m LEFT JOIN l USING (conv_id)""")
def chat_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    cited = knowledge.cited_pairs(turns.where("role = 'assistant'").withColumn("text", F.expr(_ANSWERS)), ["conv_id", "turn"])
    return formatting.chat_with_references(turns, cited.select("conv_id", "turn", F.concat("author", F.lit(" ("), "year", F.lit(")")).alias("entry")))


# -- whole plans: chunks are documents, as in the hybrid queries

_SINCE = _HYBRID.replace("JOIN documents ON doc_id = vec_id)", "JOIN documents ON doc_id = vec_id WHERE doc_id % 11 <> 0 AND 1990 + doc_id % 35 >= 2000)")
_FIRST = f"{_SINCE}, {PAPERS}, first AS (SELECT query_id, rank, chunk_id, CAST(score AS DOUBLE) AS score, p.* EXCLUDE (doc_id), doc_id FROM rrf JOIN papers p ON doc_id = chunk_id WHERE rank <= 10 AND year >= 2000)"


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks = papers(spark, sf_dir).withColumn("chunk_id", F.col("doc_id"))
    corpus = vectors(spark, sf_dir).select("chunk_id", "embedding").join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return chunks, corpus, text_queries(spark, sf_dir).join(paired_vectors(spark, sf_dir), "query_id")


@query(f"""WITH {_FIRST}, r AS (SELECT query_id, chunk_id, round((1 - (1 - score)) * CASE WHEN total_pages > 0 AND total_pages < 5 THEN 0.7::DOUBLE ELSE 1 END * CASE WHEN doi IS NOT NULL THEN 1.05::DOUBLE ELSE 1 END, 9) AS score FROM first)
SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM r) WHERE rank <= 5""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, corpus, asked = _parts(spark, sf_dir)
    return plans.hybrid_search(chunks, corpus, asked, 5, {"year": {"$gte": 2000}}, _index(spark, sf_dir)).select("query_id", "rank", "chunk_id", "score")


@query(f"WITH {_FIRST} SELECT query_id, n AS rank, chunk_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM first) WHERE n <= 5")
def base_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, corpus, asked = _parts(spark, sf_dir)
    return plans.base_search(chunks, corpus, asked, 5, {"year": {"$gte": 2000}}, _index(spark, sf_dir)).select("query_id", "rank", "chunk_id", "score")


@query(f"""WITH {_HYBRID}, s AS (SELECT query_id, rank, chunk_id, source AS doc_id, round(least(score / 12.0::DOUBLE, 1.0), 6) AS score FROM sparse JOIN documents ON doc_id = chunk_id WHERE rank <= 10),
c AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'medium' ELSE 'complex' END AS complexity, item_id % 4 AS n_sub FROM benchmark),
kept AS (SELECT s.*, complexity FROM s JOIN c USING (query_id) WHERE rank <= CASE complexity WHEN 'simple' THEN 5 WHEN 'medium' THEN 7 ELSE greatest(2, 5 // greatest(1, n_sub)) END),
q AS (SELECT query_id, round(least(avg(score) + 0.2, 1.0), 6) AS relevance, round(count(DISTINCT doc_id) / count(*)::DOUBLE, 6) AS diversity, round(least(count(*) / 5.0::DOUBLE, 1.0), 6) AS coverage FROM kept WHERE complexity = 'complex' GROUP BY query_id),
failed AS (SELECT query_id FROM q WHERE round(0.5 * relevance + 0.3 * diversity + 0.2 * coverage, 7) < 0.9)
SELECT query_id, rank, chunk_id, score, FALSE AS retried FROM kept WHERE query_id NOT IN (SELECT query_id FROM failed)
UNION ALL SELECT query_id, rank, chunk_id, CAST(score AS DOUBLE), TRUE FROM rrf WHERE rank <= 8 AND query_id IN (SELECT query_id FROM failed)""")
def routed_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source stands for the document; a complex question whose sparse hits do not suffice gets fused ones."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"))
    hits = _sparse(spark, sf_dir, 10).withColumn("score", F.round(F.least(F.col("score") / 12, F.lit(1.0)), 6)).join(docs, "chunk_id")
    more = _fused(spark, sf_dir, 20).join(docs, "chunk_id")
    kind = F.expr("CASE query_id % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'medium' ELSE 'complex' END")
    classes = text_queries(spark, sf_dir).select("query_id", kind.alias("complexity"), (F.col("query_id") % 4).alias("n_sub"))
    found = fusion.routed(hits, lambda failed, k: more, classes, 5, 0.9, retries=1)
    return found.select("query_id", "rank", "chunk_id", "score", (F.col("retries") > 0).alias("retried"))


def _fails(of: str, among: str) -> str:
    """Questions of ``among`` whose hits in ``of`` do not suffice at 0.75."""
    return f"""(SELECT a.query_id FROM {among} a LEFT JOIN (SELECT query_id, round(least(avg(score) + 0.2, 1.0), 6) AS relevance, round(count(DISTINCT doc_id) / count(*)::DOUBLE, 6) AS diversity, round(least(count(*) / 5.0::DOUBLE, 1.0), 6) AS coverage FROM {of} GROUP BY query_id) q USING (query_id)
  WHERE coalesce(round(0.5 * relevance + 0.3 * diversity + 0.2 * coverage, 7) < 0.75, TRUE))"""


@query(f"""WITH {_HYBRID}, s AS (SELECT query_id, rank, chunk_id, source AS doc_id, round(least(score / 90.0::DOUBLE, 1.0), 6) AS score FROM sparse JOIN documents ON doc_id = chunk_id WHERE rank <= 10),
h AS (SELECT query_id, rank, chunk_id, source AS doc_id, round(CAST(score AS DOUBLE) * 15, 6) AS score FROM rrf JOIN documents ON doc_id = chunk_id WHERE rank <= 20),
c AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 'simple' ELSE 'complex' END AS complexity, item_id % 3 AS n_sub FROM benchmark), x AS (SELECT query_id FROM c WHERE complexity = 'complex'),
k AS (SELECT s.* FROM s JOIN c USING (query_id) WHERE rank <= CASE complexity WHEN 'simple' THEN 5 ELSE greatest(2, 5 // greatest(1, n_sub)) END),
f1 AS {_fails("k", "x")}, r1 AS (SELECT * FROM h WHERE rank <= 8 AND query_id IN (SELECT query_id FROM f1)), f2 AS {_fails("r1", "f1")},
r2 AS (SELECT * FROM s WHERE rank <= 8 AND query_id IN (SELECT query_id FROM f2))
SELECT query_id, rank, chunk_id, score, retries FROM (
  SELECT *, 0 AS retries FROM k WHERE query_id NOT IN (SELECT query_id FROM f1) UNION ALL SELECT *, 1 FROM r1 WHERE query_id NOT IN (SELECT query_id FROM f2) UNION ALL SELECT *, 2 FROM r2)""")
def routed_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complex questions are widened twice at most: to fused hits, then to more sparse ones."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"))
    hits = materialize(_sparse(spark, sf_dir, 10).withColumn("score", F.round(F.least(F.col("score") / 90, F.lit(1.0)), 6)).join(docs, "chunk_id"), "hits")
    fused = _fused(spark, sf_dir, 20).withColumn("score", F.round(F.col("score") * 15, 6)).join(docs, "chunk_id").select(*hits.columns)
    kind = F.expr("CASE query_id % 4 WHEN 0 THEN 'simple' ELSE 'complex' END")
    classes = text_queries(spark, sf_dir).select("query_id", kind.alias("complexity"), (F.col("query_id") % 3).alias("n_sub"))
    found = fusion.routed(hits, lambda failed, k: fused if k == 1 else hits, classes, 5, 0.75)
    return found.select("query_id", "rank", "chunk_id", "score", "retries")


@query("""WITH r AS (SELECT doc_id, source AS topic, lower(substr(text, 1, 200)) AS low FROM documents), t AS (SELECT topic, doc_id, CASE WHEN contains(low, 'method') OR contains(low, 'data') THEN 'methodology' WHEN contains(low, 'case stud') THEN 'case_study'
  WHEN contains(low, 'theoretical') OR contains(low, 'framework') THEN 'theoretical' ELSE 'empirical' END AS research_type FROM (SELECT doc_id, topic, low || CASE doc_id % 4 WHEN 0 THEN ' a method' WHEN 1 THEN ' a case study' WHEN 2 THEN ' a framework' ELSE '' END AS low FROM r))
SELECT topic, research_type, count(DISTINCT doc_id) AS n_docs, max(n_of_all) AS n_of_all FROM t JOIN (SELECT topic, count(DISTINCT doc_id) AS n_of_all FROM t GROUP BY topic) USING (topic) GROUP BY topic, research_type""")
def topic_research_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("concat(substr(text, 1, 200), CASE doc_id % 4 WHEN 0 THEN ' a method' WHEN 1 THEN ' a case study' WHEN 2 THEN ' a framework' ELSE '' END)")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("topic"), said.alias("said"))
    return stats.type_statistics(docs, "topic", T.research_type(F.col("said")))


@query(f"""WITH {_SCORED}, {_TRUTH} SELECT * FROM truth""")
def passage_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage word for word, found through the index."""
    return _truth(spark, sf_dir)


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def index_remove_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"))
    return bm25.remove_chunks(chunks, table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("chunk_id")))

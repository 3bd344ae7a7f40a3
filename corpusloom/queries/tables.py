"""Statistics, graphs, claims, formats, tenants and usage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.operators import anchors, bm25, chunking, dense, formatting, knowledge, stats, tenancy
from corpusloom.queries.fixtures import CHUNKS, PAPERS, papers, query_vectors, table, text_queries, vectors
from corpusloom.queries.search import _COSINE, _SCORED, _index, _sparse
from corpusloom.queries.search import ORACLES as ORACLES_OF_SEARCH
from corpusloom.session import workspace
from corpusloom.sources import tables as io
from corpusloom.streaming import ingest, usage

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_PAPER_CHUNKS = f"{PAPERS}, {CHUNKS}, pc AS (SELECT c.chunk_id, c.chunk_index, p.* FROM chunks c JOIN papers p USING (doc_id))"


def _paper_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.fixed_chunks(table(spark, sf_dir, "documents")).select("doc_id", "chunk_id", "chunk_index")
    return chunking.with_metadata(chunks, papers(spark, sf_dir))


# -- statistics


@query(f"WITH {_PAPER_CHUNKS} SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, coalesce(min(year), 0) AS year_min, coalesce(max(year), 0) AS year_max FROM pc")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.corpus_stats(_paper_chunks(spark, sf_dir))


@query(f"WITH {PAPERS} SELECT coalesce(nullif(phase, 'fr'), 'Unknown') AS phase, count(DISTINCT doc_id) AS n_docs FROM papers GROUP BY 1")
def docs_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.docs_by(papers(spark, sf_dir).withColumn("phase", F.nullif("phase", F.lit("fr"))), "phase")


@query(f"WITH {_PAPER_CHUNKS} SELECT kb_id, count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks, min(year) AS year_min, max(year) AS year_max FROM pc GROUP BY kb_id")
def kb_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters are always recomputed, never kept as mutable state."""
    return stats.kb_counters(_paper_chunks(spark, sf_dir))


@query(f"WITH {_PAPER_CHUNKS} SELECT doc_id, chunk_id, title, year FROM pc WHERE chunk_index = 0 AND year >= 2000")
def unique_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paper_chunks(spark, sf_dir).where("year >= 2000")
    return stats.unique_documents(rows, ["chunk_index"]).select("doc_id", "chunk_id", "title", "year")


@query(f"WITH {PAPERS} SELECT topic, count(*) AS current, CAST(30 AS BIGINT) AS recommended, 30 - count(*) AS gap FROM papers WHERE phase = 'de' GROUP BY topic HAVING count(*) < 30")
def topic_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.coverage_gaps(papers(spark, sf_dir).where("phase = 'de'"), "topic", 30)


@query(f"WITH {PAPERS} SELECT topic, count(*) AS n_docs, round(avg(year), 6) AS avg_year, min(year) AS year_min, max(year) AS year_max FROM papers GROUP BY topic")
def topic_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.topic_stats(papers(spark, sf_dir), "topic")


@query(f"""WITH plans(tier, max_docs, max_bases, max_bytes, max_calls) AS (VALUES ('free', 50, 3, 104857600, 500), ('pro', 500, 20, 5368709120, 10000), ('enterprise', NULL, NULL, NULL, NULL)),
c AS (SELECT user_id % 97 AS owner, count(*) AS n_calls FROM events GROUP BY 1),
u AS (SELECT o_custkey % 97 AS owner, o_custkey AS kb_id, CASE (o_custkey % 97) % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'enterprise' END AS tier, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders),
g AS (SELECT owner, tier, count(DISTINCT kb_id) AS n_bases, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS n_bytes FROM u GROUP BY ALL), j AS (SELECT g.*, coalesce(n_calls, 0) AS n_calls FROM g LEFT JOIN c USING (owner))
SELECT owner, tier, n_bases, n_docs, n_bytes, n_calls, {", ".join(f"round(100.0::DOUBLE * n_{k} / max_{k}, 6) AS {k}_percent" for k in ("bases", "docs", "bytes", "calls"))},
  max_bases IS NULL OR n_bases < max_bases AS may_add_base, max_docs IS NULL OR n_docs < max_docs AS may_add, max_calls IS NULL OR n_calls < max_calls AS may_call FROM j LEFT JOIN plans USING (tier)""")
def usage_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for knowledge bases, orders for documents and events for calls."""
    plans = spark.createDataFrame(P.PLANS, "tier string, max_docs long, max_bases long, max_bytes long, max_calls long")
    calls = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 97).alias("owner")).agg(F.count("*").alias("n_calls"))
    owner = F.col("o_custkey") % 97
    tier = F.element_at(F.array(F.lit("free"), F.lit("pro"), F.lit("enterprise")), (owner % 3 + 1).cast("int"))
    items = table(spark, sf_dir, "orders").select(owner.alias("owner"), F.col("o_custkey").alias("kb_id"), tier.alias("tier"), F.floor("o_totalprice").cast("long").alias("size"))
    return stats.usage_report(items, plans, calls)


_TRUTH = "truth AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage word for word."""
    return anchors.holders(text_queries(spark, sf_dir), table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "chunk_id"))


@query(f"""WITH {_SCORED}, {_TRUTH}, e AS (SELECT query_id, count(*) AS expected FROM truth GROUP BY query_id),
f AS (SELECT query_id, count(*) AS found FROM sparse JOIN truth USING (query_id, chunk_id) WHERE rank <= 5 GROUP BY query_id)
SELECT query_id, expected, coalesce(found, 0) AS found, round(coalesce(found, 0) / 5.0::DOUBLE, 6) AS precision, round(coalesce(found, 0) / expected::DOUBLE, 6) AS recall FROM e LEFT JOIN f USING (query_id)""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.retrieval_metrics(_sparse(spark, sf_dir, 5), _truth(spark, sf_dir), 5)


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS stdev, min(value) AS least, max(value) AS most,
  round(CASE WHEN count(value) >= 20 THEN list_sort(list(value))[CAST(floor(0.95 * count(value)) AS INT) + 1] END, 6) AS p95 FROM events GROUP BY event_type""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.latency_summary(table(spark, sf_dir, "events"), "event_type", "value")


_STOPS = "[" + ", ".join(f"'{w}'" for w in P.EVAL_STOPS) + "]"
#: Topics whose names share words with texts, have short and stop words, or only these; half of the documents have an abstract.
_NAMED = "CASE CAST(substr(topic, 4) AS INT) % 4 WHEN 0 THEN topic WHEN 1 THEN 'The_' || substr(title, 1, 12) || '_of' WHEN 2 THEN 'a_study' ELSE topic || '_case' END"


def _kept_words(text: str, apart: str) -> str:
    plain = f"list_transform(regexp_split_to_array(translate(coalesce({text}, ''), '{apart}', '{' ' * len(apart)}'), '\\s+'), lambda w : lower(regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')))"
    return f"list_filter({plain}, lambda w : length(w) >= 4 AND NOT list_contains({_STOPS}, w))"


def _first_words(name: str, n: int) -> str:
    return f"list_transform(list_filter(range(1, len({name}) + 1), lambda i : list_position({name}, {name}[i]) = i)[1:{n}], lambda i : {name}[i])"


@query(f"""WITH {PAPERS}, t AS (SELECT doc_id, title, phase, {_NAMED} AS topic, CASE WHEN doc_id % 2 = 0 THEN text END AS abstract FROM papers),
g AS (SELECT topic, phase, count(*) AS n_docs, array_to_string(list_sort(list(doc_id))[1:3], ',') AS expected, min(doc_id) AS first FROM t GROUP BY ALL),
w AS (SELECT g.*, {_kept_words("abstract", "-/")} AS a, {_kept_words("title", "-/")} AS b, {_kept_words("g.topic", "_")} AS w FROM g JOIN t ON doc_id = first ORDER BY n_docs DESC, g.topic, g.phase LIMIT 20),
k AS (SELECT *, CASE WHEN len(a) > 0 THEN {_first_words("a", 4)} ELSE {_first_words("b", 3)} END AS k FROM w),
s AS (SELECT *, list_filter(k, lambda x : list_contains(w, x)) AS s FROM k)
SELECT topic, phase, n_docs, expected, trim(array_to_string(list_concat(CASE WHEN len(w) > 0 THEN w[1:3] ELSE [replace(topic, '_', ' ')] END, CASE WHEN len(s) > 0 THEN s ELSE k END), ' ')) AS query FROM s""")
def eval_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = papers(spark, sf_dir).withColumn("topic", F.expr(_NAMED)).withColumn("abstract", F.when(F.col("doc_id") % 2 == 0, F.col("text")))
    return stats.eval_set(docs)


@query(f"WITH {PAPERS} SELECT topic, phase, sum(total_pages)::BIGINT AS pages, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w : w <> '')))::BIGINT AS words FROM papers GROUP BY ALL")
def page_and_word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.page_and_word_totals(papers(spark, sf_dir), ["topic", "phase"])


# -- graph

_PHRASE = "[A-Z][a-z]+(?: [A-Z][a-z]+)+"
#: Every word of the first 60 characters in capitals gives phrases to work with.
_CAPS = "array_join(transform(split(text, '\n'), l -> concat(array_join(transform(split(substring(l, 1, 60), ' '), w -> concat(translate(substring(w, 1, 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), lower(substring(w, 2, 60)))), ' '), substring(l, 61, length(l)))), '\n')"


@query()
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.expr(_CAPS))
    return knowledge.entity_mentions(docs)


@query()
def entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.upsert_entities(entity_mentions(spark, sf_dir), ["doc_id", "paragraph"])


@query()
def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.cooccurrence_edges(entity_mentions(spark, sf_dir))


_EDGES = """lines AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
edges AS (SELECT DISTINCT l.doc_id AS src, f.first AS dst FROM lines l JOIN (SELECT line, min(doc_id) AS first FROM lines WHERE line <> '' GROUP BY line) f USING (line) WHERE l.doc_id <> f.first)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and the first that has one of its lines."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where("line <> ''")
    keyed = lines.select("doc_id", F.xxhash64("line").alias("line"))
    first = keyed.groupBy("line").agg(F.min("doc_id").alias("first"))
    return keyed.join(first, "line").where("doc_id <> first").select(F.col("doc_id").alias("src"), F.col("first").alias("dst")).distinct()


_REACH = f"""WITH RECURSIVE {_EDGES}, pairs AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges),
reach(node, seen) AS (SELECT u, u FROM pairs UNION SELECT r.node, b.v FROM reach r JOIN pairs b ON b.u = r.seen),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
named AS (SELECT *, 'cluster_' || dense_rank() OVER (ORDER BY component) AS cluster FROM comp)"""


@query(f"{_REACH} SELECT * FROM named")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.clusters(_edges(spark, sf_dir), "src", "dst")


@query(f"{_REACH} SELECT component, cluster, count(*) AS n_nodes, array_to_string(list_sort(list(node))[1:6], ', ') AS covers FROM named GROUP BY component, cluster")
def cluster_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.cluster_table(connected_components(spark, sf_dir))


@query(f"""{_REACH}, m AS (SELECT node % 50 AS doc_id, component, count(*) AS n FROM named GROUP BY ALL)
SELECT doc_id, component FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, component) AS r FROM m) WHERE r = 1""")
def doc_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.majority_cluster(connected_components(spark, sf_dir).withColumn("doc_id", F.col("node") % 50))


@query(f"""WITH {_EDGES}, n AS (SELECT src AS v FROM edges UNION SELECT dst FROM edges), top AS (SELECT v FROM n ORDER BY v LIMIT 400),
b AS (SELECT v FROM n ORDER BY v DESC LIMIT 400), k AS (SELECT v FROM top UNION SELECT v FROM b)
SELECT src, dst FROM edges WHERE src IN (SELECT v FROM k) AND dst IN (SELECT v FROM k)""")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among the first and last 400 nodes, as the graph view shows them."""
    edges = _edges(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct()
    kept = nodes.orderBy("v").limit(400).union(nodes.orderBy(F.desc("v")).limit(400)).distinct()
    return edges.join(kept.withColumnRenamed("v", "src"), "src", "left_semi").join(kept.withColumnRenamed("v", "dst"), "dst", "left_semi")


# -- claims

_CLAIMS = """vectors AS (SELECT vec_id AS chunk_id, vec_id % 50 AS doc_id, embedding FROM embeddings),
qv AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)"""
_EVIDENCE = f"""{_CLAIMS}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, {_COSINE} AS distance FROM vectors, qv)) WHERE rank <= 5),
ev AS (SELECT query_id, greatest(0.0, round(max(1 - distance), 6)) AS best_score, count(*) FILTER (1 - distance >= 0.35) AS evidence FROM near GROUP BY query_id)"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.dense_topk(query_vectors(spark, sf_dir), vectors(spark, sf_dir), 5)


@query(f"WITH {_EVIDENCE} SELECT query_id, rank, chunk_id, distance FROM near")
def claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("query_id", "rank", "chunk_id", "distance")


@query(f"WITH {_EVIDENCE} SELECT *, CASE WHEN best_score < 0.25 THEN 'missing_evidence' WHEN evidence < 2 THEN 'weak_coverage' ELSE 'none' END AS gap FROM ev")
def claim_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.evidence_gaps(_evidence(spark, sf_dir))


@query(f"""WITH {CHUNKS}, t AS (SELECT doc_id, substr(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index), 1, 12000) AS text FROM chunks GROUP BY doc_id),
l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10) || chr(10))), '^\\s+|\\s+$', '', 'g') AS paragraph, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS pos FROM t),
n AS (SELECT doc_id, paragraph, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS no FROM l WHERE paragraph <> '') SELECT * FROM n WHERE no <= 12""")
def doc_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve paragraphs of the first 12,000 characters of a document's chunks, which is what claims are drawn from."""
    return knowledge.paragraphs(chunking.fixed_chunks(table(spark, sf_dir, "documents")))


_ANSWERS = "text || CASE conv_id % 3 WHEN 0 THEN ' as Author1 (1991) says' WHEN 1 THEN ' as Nobody (2020) and Author2 (2001) say, 42%' ELSE '' END"


@query(f"""WITH {PAPERS}, a AS (SELECT conv_id, turn, {_ANSWERS} AS t FROM conversations WHERE role = 'assistant'),
c AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(t, '([A-Z][A-Za-z0-9]+) \\([0-9]{{4}}\\)', 1)) AS author FROM a)
SELECT * FROM c WHERE author NOT IN (SELECT first_author FROM papers)""")
def cited_not_in_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("text", F.expr(_ANSWERS))
    cited = knowledge.cited_pairs(answers, ["conv_id", "turn"]).select("conv_id", "turn", "author").distinct()
    return cited.join(papers(spark, sf_dir).select(F.col("first_author").alias("author")).distinct(), "author", "left_anti")


#: Each answer gets one figure that its source (document ``conv_id``) has or lacks, written in one of the three ways.
_FIGURES = "text || CASE conv_id % 4 WHEN 0 THEN ' grew 42%.' WHEN 1 THEN ' fell by 17.5 percent' WHEN 2 THEN ' at 99  percentage points' ELSE ' rose 3 per cent' END"
_SOURCES = "text || CASE WHEN doc_id % 8 < 4 THEN ' in all 42 of 17.5 and 99' ELSE '' END"


@query(f"""WITH a AS (SELECT conv_id, turn, {_FIGURES} AS t FROM conversations WHERE role = 'assistant'), p AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(t, '([0-9]+(?:\\.[0-9]+)?)\\s*(?:%|percent|percentage)', 1)) AS stat FROM a),
s AS (SELECT doc_id, {_SOURCES} AS source FROM documents) SELECT p.conv_id, turn, stat FROM p LEFT JOIN s ON doc_id = conv_id WHERE NOT contains(coalesce(source, ''), stat)""")
def unverified_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of an answer is the document that has the number of the conversation."""
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.expr(_FIGURES).alias("answer"))
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.expr(_SOURCES).alias("source"))
    return knowledge.unverified_statistics(answers, sources, ["conv_id", "turn"], ["conv_id"])


_BROAD = """text || CASE conv_id % 7 WHEN 0 THEN ' All Studies show it.' WHEN 1 THEN ' so every researcher knows' WHEN 2 THEN ' They UNIVERSALLY agree.'
  WHEN 3 THEN ' This is always the case.' WHEN 4 THEN ' It always holds.' WHEN 5 THEN ' as all researchers found' ELSE ' all studies of it' END"""
_TOO_BROAD = "|".join(P.OVERGENERAL)


@query(f"SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND regexp_matches(lower({_BROAD}), '{_TOO_BROAD}')")
def overgeneralisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("answer", F.expr(_BROAD))
    return rows.where(knowledge.overgeneral(F.col("answer"))).select("conv_id", "turn")


@query(f"""WITH {PAPERS}, c AS (SELECT doc_id AS case_id, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE doc_id END AS doc_id, doc_id % 5 AS page, CASE WHEN doc_id % 2 = 0 THEN substr(text, 5, 30) ELSE 'never said' END AS quote FROM papers)
SELECT case_id, CASE WHEN text IS NULL THEN 'not_found' WHEN page NOT BETWEEN 1 AND total_pages THEN 'page_out_of_range'
  WHEN contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), lower(regexp_replace(quote, '\\s+', ' ', 'g'))) THEN 'verified' ELSE 'page_exists' END AS verdict FROM c LEFT JOIN papers USING (doc_id)""")
def quote_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = papers(spark, sf_dir)
    cases = docs.select(
        F.col("doc_id").alias("case_id"),
        F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.col("doc_id")).alias("doc_id"),
        (F.col("doc_id") % 5).alias("page"),
        F.when(F.col("doc_id") % 2 == 0, F.substring("text", 5, 30)).otherwise("never said").alias("quote"),
    )
    return knowledge.quote_check(cases, docs)


# -- formats


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = papers(spark, sf_dir).withColumn("chunk_id", F.col("doc_id")).withColumn("authors", F.array("first_author", "second_author"))
    return _sparse(spark, sf_dir, 3).join(docs, "chunk_id")


_CITED = "first_author || ', ' || second_author || ' (' || coalesce(CAST(year AS VARCHAR), 'n.d.') || '). ' || title"


@query(f"""WITH {_SCORED}, {PAPERS}, h AS (SELECT * FROM sparse JOIN papers ON doc_id = chunk_id WHERE rank <= 3)
SELECT query_id, string_agg('[' || {_CITED} || ']' || chr(10) || 'Phase: ' || phase || ' | Topic: ' || topic || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY query_id""")
def context_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.context_blocks(_hits(spark, sf_dir))


@query(f"""WITH {_SCORED}, {PAPERS}, h AS (SELECT * FROM sparse JOIN papers ON doc_id = chunk_id WHERE rank <= 3)
SELECT query_id, string_agg('[' || rank || '] = ' || {_CITED}, chr(10) ORDER BY rank) AS guide FROM h GROUP BY query_id""")
def citation_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.numbered(_hits(spark, sf_dir))


@query(f"WITH {PAPERS} SELECT {_CITED} || coalesce('. https://doi.org/' || doi, '') AS entry, min(doc_id) AS doc_id FROM papers GROUP BY 1")
def bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.bibliography(papers(spark, sf_dir).withColumn("authors", F.array("first_author", "second_author")))


@query(f"""WITH {PAPERS} SELECT phase, n AS "position", n || '. **' || first_author || '** ' || title AS line FROM (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY first_author, doc_id) AS n FROM papers)""")
def markdown_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.markdown_by_group(papers(spark, sf_dir).withColumn("author", F.col("first_author")), "phase")


@query("""SELECT conv_id, string_agg('## ' || upper(role[1]) || role[2:] || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn, role, text) AS markdown FROM conversations GROUP BY conv_id""")
def chat_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.chat_markdown(table(spark, sf_dir, "conversations"))


# -- tenants

_BASES = "bases(kb_id, owner, status) AS (VALUES (0, 1, 'active'), (1, 1, 'deleted'), (2, 2, 'active'), (3, 1, 'active'))"


def _bases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 1, "active"), (1, 1, "deleted"), (2, 2, "active"), (3, 1, "active")], "kb_id long, owner long, status string")


@query(f"WITH {_BASES} SELECT doc_id, doc_id % 4 AS kb_id FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 4 IN (SELECT kb_id FROM bases WHERE owner = 1 AND status = 'active')")
def tenant_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4).alias("kb_id"), F.when(F.col("doc_id") % 13 == 0, "failed").otherwise("indexed").alias("status"))
    return tenancy.owned_documents(docs, _bases(spark), 1).select("doc_id", "kb_id")


@query(f"""WITH {_BASES} SELECT event_id AS request_id, CASE WHEN owner IS NULL THEN 'missing' WHEN owner <> user_id % 3 THEN 'denied' WHEN status = 'deleted' THEN 'deleted' ELSE 'ok' END AS decision
FROM events LEFT JOIN bases ON kb_id = event_id % 5""")
def access_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 3).alias("user_id"), (F.col("event_id") % 5).alias("kb_id"))
    return tenancy.access_check(asked, _bases(spark))


_LINES = "SELECT doc_id, doc_id || '-' || i AS claim_id FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH {CHUNKS}, gone AS (SELECT doc_id FROM labels WHERE toxic = 1), c AS (SELECT doc_id, chunk_id FROM chunks WHERE doc_id NOT IN (SELECT * FROM gone)),
l AS ({_LINES}), k AS (SELECT * FROM l WHERE doc_id NOT IN (SELECT * FROM gone))
SELECT 'chunks' AS name, chunk_id AS id FROM c
UNION ALL SELECT 'relations', doc_id || '-' || (doc_id + 1) FROM documents WHERE doc_id NOT IN (SELECT * FROM gone) AND doc_id + 1 NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'postings', chunk_id || ' the' FROM chunks WHERE contains(lower(text), 'the') AND chunk_id IN (SELECT chunk_id FROM c)
UNION ALL SELECT 'claims', claim_id FROM k UNION ALL SELECT 'gaps', claim_id || ' weak' FROM l WHERE doc_id % 3 = 0 AND claim_id IN (SELECT claim_id FROM k)""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are claims, of which every third document's have a gap; postings are those of one term."""
    docs = table(spark, sf_dir, "documents")
    chunks = chunking.fixed_chunks(docs)
    claims = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", F.concat("doc_id", F.lit("-"), "i").alias("claim_id"))
    tables = {
        "chunks": chunks.select("doc_id", "chunk_id", F.col("chunk_id").alias("id")),
        "relations": docs.select("doc_id", (F.col("doc_id") + 1).alias("related_doc_id")).withColumn("id", F.concat("doc_id", F.lit("-"), "related_doc_id")),
        "postings": chunks.where(F.contains(F.lower("text"), F.lit("the"))).select("chunk_id", F.concat("chunk_id", F.lit(" the")).alias("id")),
        "claims": claims.withColumn("id", F.col("claim_id")),
        "gaps": claims.where("doc_id % 3 = 0").select("claim_id", F.concat("claim_id", F.lit(" weak")).alias("id")),
    }
    left = tenancy.delete_document(tables, table(spark, sf_dir, "labels").where("toxic = 1"), {"postings": ("chunks", "chunk_id"), "gaps": ("claims", "claim_id")})
    return reduce(DataFrame.union, [df.select(F.lit(name).alias("name"), "id") for name, df in left.items()])


@query("""SELECT doc_id, doc_id + 1 AS related_doc_id, 0.5::DOUBLE AS score FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id, doc_id + 2, 0.75::DOUBLE FROM documents WHERE doc_id % 10 = 0""")
def replace_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id")
    old = ids.select("doc_id", (F.col("doc_id") + 1).alias("related_doc_id"), F.lit(0.5).alias("score"))
    new = ids.where("doc_id % 10 = 0").select("doc_id", (F.col("doc_id") + 2).alias("related_doc_id"), F.lit(0.75).alias("score"))
    return tenancy.replace_relations(old, new)


# -- usage


@query("""SELECT user_id, w AS window_start, count(*) AS n FROM (
  SELECT user_id, unnest(generate_series(time_bucket(INTERVAL 6 SECOND, ts) - INTERVAL 54 SECOND, time_bucket(INTERVAL 6 SECOND, ts), INTERVAL 6 SECOND)) AS w FROM events) GROUP BY ALL""")
def sliding_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.sliding_requests(table(spark, sf_dir, "events"))


_POLICIES = [("/api/", 4), ("/api/p", 2), ("/api/purchase", 1)]


@query("""WITH p(prefix, cap) AS (VALUES ('/api/', 4), ('/api/p', 2), ('/api/purchase', 1)),
r AS (SELECT event_id, user_id % 2 = 0 AS member, '/api/' || event_type AS path, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECOND PRECEDING AND CURRENT ROW) AS n FROM events),
m AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY length(prefix) DESC) AS k FROM r JOIN p ON starts_with(path, prefix))
SELECT event_id AS request_id, prefix AS policy, CAST(cap * CASE WHEN member THEN 2 ELSE 1 END AS BIGINT) AS allowed, n >= cap * CASE WHEN member THEN 2 ELSE 1 END AS throttled FROM m WHERE k = 1""")
def throttle_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of the last hour against the limit of their path."""
    events = table(spark, sf_dir, "events")
    counts = usage.recent_requests(events.withColumnRenamed("event_id", "request_id"), 3600)
    asked = events.select(F.col("event_id").alias("request_id"), (F.col("user_id") % 2 == 0).alias("member"), F.concat(F.lit("/api/"), "event_type").alias("path"))
    return usage.throttle(counts, asked, spark.createDataFrame(_POLICIES, "prefix string, limit int"), 10)


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS calls, count(*) > 5 AS over_limit FROM events GROUP BY ALL")
def daily_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.daily_calls(table(spark, sf_dir, "events"), 5)


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(avg(value), 6) AS mean, round(list_sort(list(value))[CAST(ceil(0.95 * count(value)) AS INT)], 6) AS p95, round(max(value), 6) AS most FROM events GROUP BY ALL")
def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.request_metrics(table(spark, sf_dir, "events"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS since FROM events GROUP BY user_id")
def latest_task_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.latest_state(table(spark, sf_dir, "events"))


@query(f"WITH {CHUNKS} SELECT * FROM chunks")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the streaming job, then read back."""
    import uuid

    base = f"{workspace(spark)}/ingest-{uuid.uuid4().hex}"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    ingest.ingest(spark, f"{sf_dir}/documents.parquet", f"{base}/chunks", f"{base}/state", schema).awaitTermination()
    return spark.read.parquet(f"{base}/chunks").drop("bucket")


@query(ORACLES_OF_SEARCH["bm25_stats"])
def saved_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of an index that was saved and read again."""
    import uuid

    base = f"{workspace(spark)}/index-{uuid.uuid4().hex}"
    bm25.write_index(bm25.build_index(table(spark, sf_dir, "documents"), "doc_id"), base)
    return bm25.index_stats(bm25.read_index(spark, base)).withColumn("avg_length", F.round("avg_length", 6))

"""Chunks, both indexes, and search."""

from __future__ import annotations

from hashlib import md5
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import blockmax, bm25, chunking, dense, filters, fusion, segments
from corpusloom.queries.fixtures import CHUNKS, PAPERS, TEXT_QUERIES, TOKENS, paired_vectors, papers, query_vectors, table, text_queries, vectors
from corpusloom.session import materialize, state_of, workspace

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- chunks


@query(f"WITH {CHUNKS} SELECT * FROM chunks")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_chunks(table(spark, sf_dir, "documents"))


_PRINT = "substr(trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g')), 1, 100)"


@query(f"""SELECT doc_id, kb_id FROM (
  SELECT doc_id, doc_id % 4 AS kb_id, row_number() OVER (PARTITION BY doc_id % 4, {_PRINT} ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def chunk_fingerprint_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("kb_id", F.col("doc_id") % 4)
    return chunking.fingerprint_dedupe(rows, ["kb_id"], ["doc_id"]).select("doc_id", "kb_id")


@query()
def hierarchical_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.hierarchical_chunks(table(spark, sf_dir, "documents"))


@query()
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.recursive_chunks(table(spark, sf_dir, "documents"), ["doc_id"], size=1000)


@query("""WITH sized AS (SELECT doc_id, text, greatest(1, length(text) // 4) > 1000 AS large FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CAST(NULL AS VARCHAR) AS parent_chunk_id, text FROM sized WHERE NOT large
UNION ALL SELECT doc_id || '_part_' || i, CAST(doc_id AS VARCHAR), substr(text, CAST(i * 3800 + 1 AS BIGINT), 4000)
FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(ceil((length(text) - 200) / 3800.0) AS BIGINT) - 1)) AS i FROM sized WHERE large)""")
def oversize_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_oversize(table(spark, sf_dir, "documents"), "doc_id", max_tokens=1000, size=4000)


@query("SELECT doc_id, CAST(greatest(1, floor(length(text) / 4)) AS BIGINT) AS n_tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", chunking.token_estimate(F.col("text")).alias("n_tokens"))


# -- sparse

_INDEX = f"""rows AS (SELECT doc_id AS chunk_id, {TOKENS.format("text")} AS t FROM documents),
lens AS (SELECT chunk_id, CAST(len(t) AS BIGINT) AS length FROM rows WHERE len(t) > 0),
postings AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM rows) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
raw AS (SELECT term, df, ln((SELECT count(*) FROM lens) - df + 0.5) - ln(df + 0.5) AS r FROM terms),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""

_SCORED = f"""{TEXT_QUERIES}, {_INDEX},
qterms AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format("query")}) AS term FROM text_queries) GROUP BY ALL),
scored AS (
  SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / (SELECT avg(length) FROM lens)))), 6) AS score
  FROM postings JOIN qterms USING (term) JOIN idf USING (term) JOIN lens USING (chunk_id) GROUP BY query_id, chunk_id),
sparse AS (
  SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score
                 FROM scored WHERE score > 0))"""


def _index(spark: SparkSession, sf_dir: str) -> bm25.SparseIndex:
    """The index of all documents: built on its first use in a session, then read from the shared folder as long as the table's files stay the same."""
    key = f"{sf_dir} {state_of(spark, f'{sf_dir}/documents.parquet')}"
    saved = f"{workspace(spark)}/index-{spark.sparkContext.applicationId}-{md5(key.encode()).hexdigest()}"
    return bm25.ensure_index(spark, saved, table(spark, sf_dir, "documents"), "doc_id")


def _sparse(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The hits, written once: k rows a question, which joins send to the documents."""
    return bm25.few(materialize(bm25.bm25_topk(_index(spark, sf_dir), text_queries(spark, sf_dir), k), "hits"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits with their scores, written once."""
    return materialize(bm25.bm25_scores(_index(spark, sf_dir), text_queries(spark, sf_dir)), "scores")


@query(f"WITH {_SCORED} SELECT * FROM sparse WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir, 10)


@query(f"WITH {_SCORED.replace('SELECT item_id AS query_id, text AS query,', "SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:12], ' ') AS query,")} SELECT * FROM sparse WHERE rank <= 10")
def short_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of twelve words, as a user types them."""
    short = F.array_join(F.slice(F.split("query", " "), 1, 12), " ")
    return bm25.bm25_topk(_index(spark, sf_dir), text_queries(spark, sf_dir).withColumn("query", short))


@query(f"WITH {_INDEX} SELECT count(*) AS n_docs, CAST(sum(length) AS BIGINT) AS n_tokens, round(avg(length), 6) AS avg_length FROM lens")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.index_stats(_index(spark, sf_dir)).withColumn("avg_length", F.round("avg_length", 6))


@query(f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.term_idf(_index(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query(f"WITH {_INDEX} SELECT chunk_id, term, tf FROM postings")
def sparse_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new index, whatever is saved."""
    return bm25.build_index(table(spark, sf_dir, "documents"), "doc_id").postings.select("chunk_id", "term", "tf")


@query(f"WITH {_SCORED} SELECT * FROM sparse WHERE rank <= 10")
def bm25_blockmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``bm25_topk``, from as few postings as that takes."""
    return blockmax.blockmax_topk(blockmax.build_blocks(_index(spark, sf_dir)), text_queries(spark, sf_dir))


def _changed(spark: SparkSession, sf_dir: str) -> segments.StoredIndex:
    """An index of the documents of two ids in three, then without the toxic ones and every seventh id, then with the rest and every 14th id, then without a source."""
    docs, base = table(spark, sf_dir, "documents"), f"{workspace(spark)}/segments-{uuid4().hex}"
    stored = segments.add(segments.create(spark, base), docs.where("doc_id % 3 < 2"), "doc_id")
    stored = segments.remove_chunks(stored, table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    stored = segments.remove_chunks(stored, docs.where("doc_id % 7 = 0"), "doc_id")
    stored = segments.add(stored, docs.where("doc_id % 3 = 2 or doc_id % 14 = 0"), "doc_id")
    return segments.remove_documents(stored, docs.where("source = 'src3'"))


_CHANGED = """changed AS (SELECT * FROM documents WHERE source IS DISTINCT FROM 'src3' AND (doc_id % 3 = 2 OR doc_id % 14 = 0
  OR (doc_id % 7 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))))"""


@query(f"WITH {_CHANGED}, {_SCORED.replace('FROM documents)', 'FROM changed)')} SELECT * FROM sparse WHERE rank <= 10")
def segmented_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in an index after additions and removals; its terms, lengths and scores are those of a new one."""
    return bm25.bm25_topk(_changed(spark, sf_dir).index(), text_queries(spark, sf_dir))


@query(f"WITH {_CHANGED}, {_INDEX.replace('FROM documents)', 'FROM changed)')} SELECT term, df, round(idf, 6) AS idf FROM idf")
def segmented_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.term_idf(_changed(spark, sf_dir).index()).withColumn("idf", F.round("idf", 6))


@query(f"""WITH {_CHANGED}, {_INDEX.replace('FROM documents)', 'FROM changed)')}
SELECT chunk_id, term, tf, length, (SELECT count(*) FROM lens) AS n_chunks, (SELECT CAST(sum(length) AS BIGINT) FROM lens) AS n_tokens FROM postings JOIN lens USING (chunk_id)""")
def merged_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of the changed index once its segments are one, with the counts that its entries carry."""
    stored = segments.merge(_changed(spark, sf_dir))
    return stored.postings().select("chunk_id", "term", "tf", "length", F.lit(stored.n_chunks).alias("n_chunks"), F.lit(stored.n_tokens).alias("n_tokens"))


@query(f"WITH {CHUNKS} SELECT chunk_id, doc_id FROM chunks")
def index_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks, added to an index that has those of every second document."""
    chunks = chunking.fixed_chunks(table(spark, sf_dir, "documents")).select("chunk_id", "doc_id")
    return bm25.add_chunks(chunks.where("doc_id % 2 = 0"), chunks)


@query(f"WITH {CHUNKS} SELECT chunk_id, doc_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def index_remove_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.fixed_chunks(table(spark, sf_dir, "documents")).select("chunk_id", "doc_id")
    return bm25.remove_documents(chunks, table(spark, sf_dir, "labels").where("toxic = 1"))


# -- dense

_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z : CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_VECTORS = """vectors AS (SELECT vec_id AS chunk_id, vec_id % 50 AS doc_id, label, embedding FROM embeddings),
qv AS (SELECT vec_id AS query_id, label AS query_label, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)"""
_COSINE = f"round(1 - {_DOT.format('q', 'embedding')} / (sqrt({_DOT.format('q', 'q')}) * sqrt({_DOT.format('embedding', 'embedding')})), 6) + 0::DOUBLE"
_L2 = "round(list_sum(list_transform(list_zip(q, embedding), lambda z : (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))), 6)"


def _nearest(measure: str, where: str = "TRUE") -> str:
    return f"""dense AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank, chunk_id, doc_id, distance
  FROM (SELECT query_id, chunk_id, doc_id, {measure} AS distance FROM vectors, qv WHERE {where}))"""


@query(f"WITH {_VECTORS}, {_nearest(_COSINE)} SELECT query_id, rank, chunk_id, distance, round(1 - distance, 4) AS score FROM dense WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = dense.dense_topk(query_vectors(spark, sf_dir), vectors(spark, sf_dir))
    return hits.select("query_id", "rank", "chunk_id", "distance", F.round(1 - F.col("distance"), 4).alias("score"))


@query(f"WITH {_VECTORS}, {_nearest(_COSINE, 'label >= 3 AND label = query_label')} SELECT query_id, rank, chunk_id, distance FROM dense WHERE rank <= 5")
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = vectors(spark, sf_dir).where(filters.where({"label": {"$gte": 3}}))
    return dense.dense_topk(query_vectors(spark, sf_dir), corpus, 5, match=("label", "query_label")).select("query_id", "rank", "chunk_id", "distance")


@query(f"WITH {_VECTORS}, {_nearest(_L2)} SELECT query_id, rank, chunk_id, distance FROM dense WHERE rank <= 10")
def dense_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.dense_topk(query_vectors(spark, sf_dir), vectors(spark, sf_dir), metric="l2sq").select("query_id", "rank", "chunk_id", "distance")


_CENTROIDS = """parts AS (SELECT doc_id, pos, avg(CAST(x AS DOUBLE)) AS x FROM (
  SELECT doc_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM vectors) GROUP BY doc_id, pos)"""


@query(f"WITH {_VECTORS}, {_CENTROIDS} SELECT doc_id, CAST(pos AS BIGINT) AS pos, round(x, 6) AS x FROM parts")
def doc_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = dense.doc_centroids(vectors(spark, sf_dir)).select("doc_id", F.posexplode("embedding").alias("pos", "x"))
    return means.select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"""WITH v0 AS (SELECT vec_id AS chunk_id, vec_id % 50 AS doc_id, embedding FROM embeddings), vectors AS (SELECT * FROM v0), {_CENTROIDS},
qv AS (SELECT doc_id AS query_id, list(x ORDER BY pos) AS q FROM parts GROUP BY doc_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS r FROM (
  SELECT query_id, chunk_id, doc_id, {_COSINE} AS distance FROM vectors, qv)) WHERE r <= 15 AND doc_id <> query_id),
best AS (SELECT query_id, doc_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY distance, chunk_id) AS n FROM near) WHERE n = 1)
SELECT query_id AS doc_id, doc_id AS related_doc_id, rank, greatest(0.0, round(1 - distance, 4)) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM best) WHERE rank <= 5""")
def related_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.related_documents(vectors(spark, sf_dir))


@query()
def lsh_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.lsh_topk(query_vectors(spark, sf_dir), vectors(spark, sf_dir))


# -- hybrid: the passages in order pair with the query vectors in order, over and over; a chunk is a document with a vector

_HYBRID = f"""{_SCORED}, vectors AS (SELECT vec_id AS chunk_id, vec_id AS doc_id, embedding FROM embeddings JOIN documents ON doc_id = vec_id),
qv AS (SELECT item_id AS query_id, embedding AS q FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS n FROM benchmark) JOIN embeddings ON vec_id = n % (SELECT count(*) FILTER (vec_id % 50 = 0) FROM embeddings) * 50), {_nearest(_COSINE)},
s50 AS (SELECT * FROM sparse WHERE rank <= 50), d50 AS (SELECT * FROM dense WHERE rank <= 50),
fused AS (SELECT query_id, chunk_id, min(sr) AS sparse_rank, min(dr) AS dense_rank FROM (
  SELECT query_id, chunk_id, rank AS sr, NULL AS dr FROM s50 UNION ALL SELECT query_id, chunk_id, NULL, rank FROM d50) GROUP BY ALL),
rrf AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sparse_rank NULLS LAST, dense_rank NULLS LAST, chunk_id) AS rank, chunk_id, score
  FROM (SELECT *, round(coalesce(1.0::DOUBLE / (60 + sparse_rank), 0) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0), 6) AS score FROM fused))"""


def _legs(spark: SparkSession, sf_dir: str, k: int = 50) -> tuple[DataFrame, DataFrame]:
    sparse = _sparse(spark, sf_dir, k)
    with_text = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"))
    corpus = vectors(spark, sf_dir).join(with_text, "chunk_id")
    return sparse, dense.dense_topk(paired_vectors(spark, sf_dir), corpus, k).select("query_id", "rank", "chunk_id", "distance")


def _fused(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return fusion.rrf(*_legs(spark, sf_dir), n).select("query_id", "rank", "chunk_id", "score")


@query(f"WITH {_HYBRID} SELECT query_id, rank, chunk_id, score FROM rrf WHERE rank <= 10")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, 10)


@query(f"""WITH {_HYBRID},
s AS (SELECT query_id, chunk_id, 0.3::DOUBLE * (score - min(score) OVER w) / CASE WHEN max(score) OVER w > min(score) OVER w THEN max(score) OVER w - min(score) OVER w ELSE 1 END AS s FROM s50 WINDOW w AS (PARTITION BY query_id)),
d AS (SELECT query_id, chunk_id, 0.7::DOUBLE * (1 - (distance - min(distance) OVER w) / CASE WHEN max(distance) OVER w > min(distance) OVER w THEN max(distance) OVER w - min(distance) OVER w ELSE 1 END) AS d FROM d50 WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT query_id, chunk_id, round(coalesce(s, 0) + coalesce(d, 0), 6) AS score FROM s FULL JOIN d USING (query_id, chunk_id))
SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b) WHERE rank <= 10""")
def hybrid_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.weighted(*_legs(spark, sf_dir))


_RESCORED = f"""{_HYBRID}, {PAPERS},
rescored AS (SELECT query_id, chunk_id, doc_id, kb_id, topic, text, round((1 - (1 - score)) * CASE WHEN total_pages > 0 AND total_pages < 5 THEN 0.7::DOUBLE ELSE 1 END * CASE WHEN doi IS NOT NULL THEN 1.05::DOUBLE ELSE 1 END, 9) AS score
  FROM (SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score FROM rrf WHERE rank <= 20) JOIN papers ON doc_id = chunk_id)"""


def _rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _fused(spark, sf_dir, 20).withColumn("distance", 1 - F.col("score"))
    rows = hits.join(papers(spark, sf_dir), F.col("chunk_id") == F.col("doc_id"))
    return rows.withColumn("score", F.round(fusion.quality_score(), 9))


@query(f"WITH {_RESCORED} SELECT query_id, chunk_id, score FROM rescored")
def quality_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rescored(spark, sf_dir).select("query_id", "chunk_id", "score")


@query(f"""WITH {_RESCORED}, firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, topic ORDER BY score DESC, chunk_id) AS n FROM rescored)
SELECT query_id, rank, chunk_id, topic, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM firsts WHERE n = 1) WHERE rank <= 5""")
def best_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source stands for the document here, as each text is one chunk."""
    return fusion.best_per_document(_rescored(spark, sf_dir), 5, doc="topic").select("query_id", "rank", "chunk_id", "topic", "score")


_ASKED = f"list_distinct({TOKENS.format('query')})"


@query(f"""WITH {_RESCORED}, o AS (SELECT query_id, chunk_id, round(len(list_intersect({_ASKED}, {TOKENS.format("text")})) / greatest(1, len({_ASKED}))::DOUBLE, 6) AS score
  FROM rescored JOIN text_queries USING (query_id))
SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM o) WHERE rank <= 5""")
def overlap_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rescored(spark, sf_dir).join(text_queries(spark, sf_dir), "query_id")
    return fusion.overlap_rerank(rows).select("query_id", "rank", "chunk_id", "score")


@query(f"""WITH {_SCORED}, sized AS (SELECT query_id // 4 AS parent_id, query_id, rank, chunk_id, score, source, substr(text, 1, 50) AS head FROM sparse JOIN documents ON doc_id = chunk_id WHERE rank <= 10),
per AS (SELECT parent_id, greatest(2, 10 // count(DISTINCT query_id)) AS each FROM sized GROUP BY parent_id),
once AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY parent_id, source, head ORDER BY query_id, rank) AS n FROM sized s JOIN per USING (parent_id) WHERE rank <= each) WHERE n = 1)
SELECT parent_id, rank, chunk_id, query_id, score FROM (SELECT parent_id, chunk_id, query_id, score, row_number() OVER (PARTITION BY parent_id ORDER BY score DESC, chunk_id) AS rank FROM once) WHERE rank <= 10""")
def multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source stands for the document; passages of one with the same first characters count once."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", F.substring("text", 1, 50).alias("head"))
    hits = _sparse(spark, sf_dir, 10).withColumn("parent_id", F.floor(F.col("query_id") / 4)).join(docs, "chunk_id")
    return fusion.multi_query(hits, same=("source", "head")).select("parent_id", "rank", "chunk_id", "query_id", "score")


@query(f"""WITH {_SCORED}, strict AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM scored JOIN documents ON doc_id = chunk_id WHERE score > 0 AND lang = 'de' AND n_chars < 400)
SELECT *, FALSE AS fallback FROM strict WHERE rank <= 3
UNION ALL SELECT *, TRUE FROM sparse WHERE rank <= 3 AND query_id NOT IN (SELECT query_id FROM strict)""")
def language_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in short German documents; queries without a hit search all.  Both use the statistics of the whole index."""
    docs = table(spark, sf_dir, "documents").where("lang = 'de' AND n_chars < 400").select(F.col("doc_id").alias("chunk_id"))
    strict = materialize(bm25.bm25_topk(_index(spark, sf_dir), text_queries(spark, sf_dir), 3, among=docs), "strict")
    return fusion.with_fallback(text_queries(spark, sf_dir), strict, _sparse(spark, sf_dir, 3))


@query(f"""WITH {_SCORED} SELECT query_id, topic, rank, chunk_id, score FROM (
  SELECT query_id, source AS topic, chunk_id, score, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS rank
  FROM scored JOIN documents ON doc_id = chunk_id WHERE score > 0 AND source IN ('src1', 'src2', 'src3')) WHERE rank <= 2""")
def synthesis_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best documents of every query in each of three topics."""
    docs = table(spark, sf_dir, "documents").where(F.col("source").isin("src1", "src2", "src3"))
    return fusion.topic_hits(_scores(spark, sf_dir), docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("topic")))


@query(f"""WITH {_RESCORED}, s AS (SELECT query_id, round(least(avg(score) + 0.2, 1.0), 6) AS relevance, round(count(DISTINCT topic) / count(*)::DOUBLE, 6) AS diversity, round(least(count(*) / 5.0::DOUBLE, 1.0), 6) AS coverage FROM rescored GROUP BY query_id)
SELECT *, round(0.5 * relevance + 0.3 * diversity + 0.2 * coverage, 7) AS overall, round(0.5 * relevance + 0.3 * diversity + 0.2 * coverage, 7) >= 0.7 AS sufficient FROM s""")
def retrieval_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rescored(spark, sf_dir).drop("doc_id").withColumnRenamed("topic", "doc_id")
    return fusion.sufficiency(rows)


@query(f"""WITH {PAPERS} SELECT doc_id FROM papers WHERE (year >= 2000 AND year <= 2015 AND phase IS DISTINCT FROM 'en') OR (topic = 'src3' AND contains(title, 'th')) OR doi IN ('10.1000/3', '10.1000/9')""")
def filter_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = {"$or": [{"$and": [{"year": {"$gte": 2000, "$lte": 2015}}, {"phase": {"$ne": "en"}}]}, {"topic": "src3", "title": {"$contains": "th"}}, {"doi": {"$in": ["10.1000/3", "10.1000/9"]}}]}
    return papers(spark, sf_dir).where(filters.where(tree)).select("doc_id")


@query(f"""WITH {PAPERS} SELECT doc_id, title FROM papers WHERE contains(lower(title), 'the') OR contains(lower(first_author), 'author3') OR contains(lower(topic), 'src1') ORDER BY doc_id LIMIT 20 OFFSET 40""")
def text_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page three of a free-text search, twenty rows a page."""
    found = papers(spark, sf_dir)
    hits = found.where(filters.text_search("the", "title") | filters.text_search("AUTHOR3", "first_author") | filters.text_search("src1", "topic"))
    return filters.page_of(hits.select("doc_id", "title"), ["doc_id"], 2, 20)

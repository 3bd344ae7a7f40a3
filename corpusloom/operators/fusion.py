"""Fusing ranked lists, rescoring, and what follows retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.bm25 import tokens, top_k
from corpusloom.session import materialize


def rrf(sparse: DataFrame, dense: DataFrame, n: int = 10, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two lists ``query_id, rank, chunk_id``."""
    legs = sparse.select("query_id", "chunk_id", F.col("rank").alias("sparse_rank"), F.lit(None).cast("long").alias("dense_rank")).unionByName(
        dense.select("query_id", "chunk_id", F.lit(None).cast("long").alias("sparse_rank"), F.col("rank").alias("dense_rank"))
    )
    share = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    fused = legs.groupBy("query_id", "chunk_id").agg(F.min("sparse_rank").alias("sparse_rank"), F.min("dense_rank").alias("dense_rank"))
    fused = fused.withColumn("score", F.round(share("sparse_rank") + share("dense_rank"), 6))
    return top_k(fused, n, [F.desc("score"), F.asc_nulls_last("sparse_rank"), F.asc_nulls_last("dense_rank"), "chunk_id"])


def _scaled(col: str, by: str = "query_id") -> Column:
    w = Window.partitionBy(by)
    low, high = F.min(col).over(w), F.max(col).over(w)
    return (F.col(col) - low) / F.when(high > low, high - low).otherwise(1.0)


def weighted(sparse: DataFrame, dense: DataFrame, n: int = 10, sparse_weight: float = 0.3) -> DataFrame:
    """Weighted fusion of scaled scores (sparse) and distances (dense)."""
    s = sparse.select("query_id", "chunk_id", (sparse_weight * _scaled("score")).alias("s"))
    d = dense.select("query_id", "chunk_id", ((1 - sparse_weight) * (1 - _scaled("distance"))).alias("d"))
    both = s.join(d, ["query_id", "chunk_id"], "full").withColumn("score", F.round(F.coalesce("s", F.lit(0.0)) + F.coalesce("d", F.lit(0.0)), 6))
    return top_k(both, n, [F.desc("score"), "chunk_id"]).select("query_id", "rank", "chunk_id", "score")


def quality_score(distance: str = "distance", pages: str = "total_pages", doi: str = "doi") -> Column:
    """1 - distance, times 0.7 for under five pages and 1.05 with a DOI."""
    short = F.when((F.col(pages) > 0) & (F.col(pages) < 5), 0.7).otherwise(1.0)
    return (1 - F.col(distance)) * short * F.when(F.col(doi).isNotNull(), 1.05).otherwise(1.0)


def best_per_document(scored: DataFrame, n: int = 5, score: str = "score", doc: str = "doc_id", chunk: str = "chunk_id") -> DataFrame:
    """The best chunk of each document, then the n best; rows without document all stay."""
    own = F.coalesce(F.col(doc).cast("string"), F.concat(F.lit("chunk "), F.col(chunk)))
    best = Window.partitionBy("query_id", "__doc").orderBy(F.desc(score), chunk)
    rows = scored.withColumn("__doc", own).withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n", "__doc", "rank")
    return top_k(rows, n, [F.desc(score), chunk])


def overlap_rerank(candidates: DataFrame, n: int = 5, query: str = "query", text: str = "text") -> DataFrame:
    """Reorder candidates by the share of distinct query words that the text holds."""
    asked = F.array_distinct(tokens(F.col(query)))
    held = F.size(F.array_intersect(asked, tokens(F.col(text))))
    scored = candidates.withColumn("score", F.round(held / F.greatest(F.lit(1), F.size(asked)), 6)).drop("rank")
    return top_k(scored, n, [F.desc("score"), "chunk_id"])


def multi_query(hits: DataFrame, n: int = 10, parent: str = "parent_id", same: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """Hits of sub-queries as one list a parent: max(n // sub-queries, 2) each; of equal ``same`` the first sub-query's.

    ``same`` may be the document and the start of the text, so that a passage that was indexed twice counts once.
    """
    each = F.greatest(F.lit(2), F.floor(F.lit(n) / F.size(F.collect_set("query_id").over(Window.partitionBy(parent)))))
    kept = hits.withColumn("__each", each).where(F.col("rank") <= F.col("__each")).drop("__each")
    once = Window.partitionBy(parent, *same).orderBy("query_id", "rank")
    rows = kept.withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n", "rank")
    return top_k(rows, n, [F.desc("score"), "chunk_id"], parent)


def with_fallback(queries: DataFrame, strict: DataFrame, loose: DataFrame) -> DataFrame:
    """The strict hits; for queries that have none, the loose ones."""
    without = queries.select("query_id").join(strict.select("query_id"), "query_id", "left_anti")
    return strict.withColumn("fallback", F.lit(False)).unionByName(loose.join(without, "query_id", "left_semi").withColumn("fallback", F.lit(True)))


def sufficiency(hits: DataFrame, passing: float = 0.7) -> DataFrame:
    """How good a query's hits are: relevance, diversity, coverage, and whether to go on."""
    stats = hits.groupBy("query_id").agg(F.avg("score").alias("m"), F.countDistinct("doc_id").alias("d"), F.count("*").alias("n"))
    out = stats.select(
        "query_id",
        F.round(F.least(F.col("m") + 0.2, F.lit(1.0)), 6).alias("relevance"),
        F.round(F.col("d") / F.col("n"), 6).alias("diversity"),
        F.round(F.least(F.col("n") / 5, F.lit(1.0)), 6).alias("coverage"),
    )
    overall = F.round(0.5 * F.col("relevance") + 0.3 * F.col("diversity") + 0.2 * F.col("coverage"), 7)
    return out.withColumn("overall", overall).withColumn("sufficient", F.col("overall") >= passing)


def expanded(first: DataFrame, more: DataFrame, n: int = 5, extra: int = 3, sub_queries: int = 3, parent: str = "parent_id") -> DataFrame:
    """A second, wider pass for ``parent`` questions: n + ``extra`` hits of the question and ``extra`` of each of its
    first sub-queries, one row per document and score.

    ``more`` has ``sub``, the number of the sub-query from 0.
    """
    wide = first.where(F.col("rank") <= n + extra)
    subs = more.where((F.col("sub") < sub_queries) & (F.col("rank") <= extra)).drop("sub")
    rows = wide.unionByName(subs).groupBy(parent, "doc_id", "score").agg(F.min("chunk_id").alias("chunk_id"))
    order = Window.partitionBy(parent).orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long"))


def merge_results(first: DataFrame, second: DataFrame, n: int = 5) -> DataFrame:
    """Two result lists as one: every chunk once at its least distance, rescored, the best chunk of each document.

    Both have ``query_id, chunk_id, doc_id, distance, total_pages, doi``.
    """
    columns = ["query_id", "chunk_id", "doc_id", "distance", "total_pages", "doi"]
    either = first.select(*columns).unionByName(second.select(*columns))
    once = either.groupBy("query_id", "chunk_id").agg(F.min_by(F.struct(*columns[2:]), "distance").alias("r")).select("query_id", "chunk_id", "r.*")
    return best_per_document(once.withColumn("score", F.round(quality_score(), 6)).withColumn("rank", F.lit(0)), n)


def result_limit(complexity: Column, n: int = 5, sub_queries: Column | None = None) -> Column:
    """How many results a question of this class asks for: n, two more (at most ten) or, for a complex one, at least two a sub-query."""
    each = F.greatest(F.lit(2), F.floor(F.lit(n) / F.greatest(F.lit(1), sub_queries if sub_queries is not None else F.lit(1))))
    return F.when(complexity == "simple", n).when(complexity == "medium", min(n + 2, 10)).otherwise(each).cast("long")


def candidate_sizes(n: int, mode: str = "hybrid", rerank: int | None = None, sparse: int = 50) -> dict[str, int]:
    """How many candidates each leg gives, and how many the fusion keeps, for ``n`` results.

    ``dense``: one leg, as many as are reranked.  ``hybrid``: both legs, with room for
    reranking.  ``base``: hybrid search in one knowledge base, without reranking.
    """
    top = rerank if rerank is not None else n
    if mode == "dense":
        return {"sparse": 0, "dense": max(n, top) if rerank is not None else n, "fused": max(n, top) if rerank is not None else n}
    if mode == "base":
        return {"sparse": sparse, "dense": max(sparse, 3 * n), "fused": 2 * n}
    return {"sparse": sparse, "dense": max(sparse, 2 * top, 3 * n), "fused": max(2 * n, top)}


def routed(hits: DataFrame, widen: Callable[[DataFrame, int], DataFrame], classes: DataFrame, n: int = 5, passing: float = 0.7, retries: int = 2) -> DataFrame:
    """The hits of every question as its class wants them, with ``retries``: how often the search was widened for it.

    ``classes`` has ``query_id, complexity, n_sub``; ``hits`` are ranked, with ``doc_id``
    and ``score``.  Simple questions keep n hits, medium ones two more, complex ones at
    least two a sub-query.  For complex ones whose hits do not suffice, ``widen`` (the
    questions, the round from 1) gives ranked hits with the same columns, of which
    n + 3 take their place, and so on for those that still fail.  A question whose
    last round gave nothing keeps the hits it had, as does one that never suffices.
    Rounds end when none fails.
    """
    kept = hits.join(classes, "query_id").where(F.col("rank") <= result_limit(F.col("complexity"), n, F.col("n_sub")))
    columns = [*hits.columns, "retries"]
    now = materialize(kept.withColumn("retries", F.lit(0)).select(*columns, "complexity"), "routed")
    complex_ones = classes.where("complexity = 'complex'").select("query_id").distinct()
    for k in range(1, retries + 1):
        passed = sufficiency(now.where("complexity = 'complex'"), passing).where("sufficient").select("query_id")
        failed = materialize(complex_ones.join(passed, "query_id", "left_anti"), "failed")
        if failed.isEmpty():
            break
        again = widen(failed, k).join(failed, "query_id", "left_semi").where(F.col("rank") <= n + 3)
        again = materialize(again.withColumn("retries", F.lit(k)).withColumn("complexity", F.lit("complex")).select(*columns, "complexity"), "widened")
        now = materialize(now.join(again.select("query_id").distinct(), "query_id", "left_anti").select(*columns, "complexity").unionByName(again), "routed")
    return now.select(*columns)


def topic_hits(scored: DataFrame, topics: DataFrame, each: int = 2) -> DataFrame:
    """``query_id, topic, rank, chunk_id, score``: the best chunks of every question in each topic; ``topics`` has ``chunk_id, topic``."""
    pair = scored.join(topics, "chunk_id").withColumn("pair", F.struct("query_id", "topic"))
    return top_k(pair, each, [F.desc("score"), "chunk_id"], "pair").select("query_id", "topic", "rank", "chunk_id", "score")


def rerank_by(candidates: DataFrame, scores: DataFrame, n: int = 5) -> DataFrame:
    """Candidates in the order of a model's scores ``query_id, chunk_id, score``; those without one come last."""
    scored = candidates.drop("rank", "score").join(scores.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"], "left")
    return top_k(scored, n, [F.desc_nulls_last("score"), "chunk_id"])

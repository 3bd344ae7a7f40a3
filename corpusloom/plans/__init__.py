"""Whole retrieval plans, composed of operators."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import bm25, dense, filters, fusion


def _fused(index: bm25.SparseIndex, vectors: DataFrame, queries: DataFrame, sizes: dict[str, int], kept: DataFrame) -> DataFrame:
    """Both legs, fused; the dense one searches the kept chunks, the sparse one all, as it has no filter of its own."""
    sparse = bm25.bm25_topk(index, queries.select("query_id", "query"), sizes["sparse"])
    near = vectors.join(kept.select("chunk_id"), "chunk_id", "left_semi")
    leg = dense.dense_topk(queries.select("query_id", "embedding"), near, sizes["dense"]).select("query_id", "rank", "chunk_id", "distance")
    return fusion.rrf(sparse, leg, sizes["fused"]).select("query_id", "chunk_id", "score", "rank")


def hybrid_search(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, n: int = 5, tree: dict[str, Any] | None = None, index: bm25.SparseIndex | None = None, rerank: int | None = None) -> DataFrame:
    """Filtered hybrid search: both legs, fused, filtered, rescored, best chunk per document.

    ``chunks``: chunk_id, doc_id, text, total_pages, doi and filter columns;
    ``vectors``: chunk_id, embedding; ``queries``: query_id, query, embedding.
    ``index`` is of all chunks; it is built where it is not given.
    """
    kept = chunks.where(filters.where(tree or {}))
    hits = _fused(index or bm25.build_index(chunks), vectors, queries, fusion.candidate_sizes(n, "hybrid", rerank), kept)
    scored = hits.withColumn("distance", 1 - F.col("score")).join(kept, "chunk_id").withColumn("score", F.round(fusion.quality_score(), 9))
    return fusion.best_per_document(scored, n)


def base_search(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, n: int = 5, tree: dict[str, Any] | None = None, index: bm25.SparseIndex | None = None) -> DataFrame:
    """Hybrid search in one knowledge base: the first ``n`` fused chunks that pass the filter, a document may have several."""
    kept = chunks.where(filters.where(tree or {}))
    hits = _fused(index or bm25.build_index(chunks), vectors, queries, fusion.candidate_sizes(n, "base"), kept)
    found = hits.join(kept, "chunk_id").withColumnRenamed("rank", "fused_rank")
    return bm25.top_k(found, n, ["fused_rank"]).withColumn("score", F.round("score", 4)).drop("fused_rank")

"""Ranked sparse search that leaves out what cannot reach the first k.

Chunks that are read together are a shard, and the runs of ``WIDTH`` chunks of a
shard are its blocks.  A shard has the postings of a term in one row, block after
block, and a block says how much any of its postings of the term can add to a score.
So the postings of terms that no query asks for stay where they are, a query scores
the most promising blocks of a shard first, and of the others only those that could
still hold one of its k best.  The rows are those of a full search.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import bm25
from corpusloom.operators.bm25 import SparseIndex, bm25_topk, query_terms, term_idf, top_k
from corpusloom.session import materialize

#: Chunks of a block.
WIDTH = 8
#: Postings of a shard, if it is more than one chunk.
SHARD = 2_000_000
#: Scores are rounded to six places, so what is under the threshold by less may still tie with it.
MARGIN = 2e-6
_LISTS = ("blocks", "sizes", "max_tfs", "min_lengths", "places", "tfs", "lengths")


@dataclass(frozen=True)
class BlockIndex:
    """rows: shard, term; blocks, sizes, max_tfs and min_lengths of the term's blocks; places, tfs and lengths of its postings, in the order of the blocks.

    The row of a shard without a term has the ``chunk_ids`` of its places.
    """

    rows: DataFrame
    index: SparseIndex


def _shards(batches):
    """The index rows of one task, by shard and term."""
    task, number = TaskContext.get().partitionId(), count()
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch.column("chunk_id")))  # places are in the order of the ids
        sizes = pc.list_value_length(batch.column("words")).to_numpy()
        for at, to in bm25._cuts(sizes, batch.num_rows, SHARD):
            part, shard = batch.slice(at, to - at), (task << 32) + next(number)
            words = pc.list_flatten(part.column("words")).dictionary_encode()
            order = np.argsort(words.indices.to_numpy(), kind="stable")
            term, place = words.indices.to_numpy()[order], np.repeat(np.arange(to - at), sizes[at:to])[order]
            tf, length = pc.list_flatten(part.column("tfs")).to_numpy()[order], part.column("length").to_numpy()[place]
            first = np.flatnonzero(np.diff(term, prepend=-1))
            entry = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(place // WIDTH, prepend=-1) != 0))
            of_blocks = place[entry] // WIDTH, np.diff(entry, append=len(term)), np.maximum.reduceat(tf, entry), np.minimum.reduceat(length, entry)
            ends = {len(entry): np.append(np.searchsorted(entry, first), len(entry)), len(term): np.append(first, len(term))}
            lists = [pa.ListArray.from_arrays(pa.array(ends[len(x)], pa.int32()), pa.array(x, pa.int64())) for x in of_blocks]
            lists += [pa.ListArray.from_arrays(pa.array(ends[len(term)], pa.int32()), pa.array(x, pa.int64())) for x in (place, tf, length)]
            ids = pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), part.column("chunk_id"))
            named = words.dictionary.take(pa.array(term[first]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), shard)), named, pa.nulls(len(first), ids.type), *lists], ["shard", "term", "chunk_ids", *_LISTS])
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.nulls(1, pa.string()), ids, *[pa.nulls(1, x.type) for x in lists]], ["shard", "term", "chunk_ids", *_LISTS])


def build_blocks(index: SparseIndex) -> BlockIndex:
    """Shards of at most ``SHARD`` postings, made where the index rows are read; nothing is shuffled."""
    rows = index.rows if index.rows is not None else bm25._by_chunk(index.postings).join(index.lengths, "chunk_id")
    rows = rows.select("chunk_id", "length", "words", "tfs")
    kind = rows.schema["chunk_id"].dataType.simpleString()
    schema = f"shard long, term string, chunk_ids array<{kind}>, " + ", ".join(f"{c} array<long>" for c in _LISTS)
    return BlockIndex(materialize(rows.mapInArrow(_shards, schema), "blocks"), index)


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each of ``first`` on, as many as ``sizes`` says, one range after the other."""
    return np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def _best_in_shard(sent, k: int, mean: float, k1: float, b: float):
    """A function over the rows of a shard, of the terms that are asked for: the k best places of each query, and how many postings it took.

    ``sent`` is one of ``bm25.sent_blocks``.
    """

    def gain(tf, length):
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))

    def run(rows):
        ids, terms, starts, asked, weights = sent.value
        shard = rows.column("shard")[0].as_py()
        term = pc.index_in(rows.column("term").combine_chunks(), value_set=terms).to_numpy()
        block, size, max_tf, min_length, place, tf, length = (pc.list_flatten(rows.column(c).combine_chunks()).to_numpy() for c in _LISTS)
        bound, first = gain(max_tf, min_length), np.cumsum(size) - size
        n_entries = pc.list_value_length(rows.column("blocks").combine_chunks()).to_numpy()
        entry = np.cumsum(n_entries) - n_entries
        each = starts[term + 1] - starts[term]
        pair, row = _ranges(starts[term], each), np.repeat(np.arange(len(term)), each)
        order = np.argsort(asked[pair], kind="stable")
        pair, row = pair[order], row[order]
        cuts = np.flatnonzero(np.diff(asked[pair], prepend=-1))
        n_blocks, out = int(block.max()) + 1, []
        for at, to in zip(cuts, [*cuts[1:], len(pair)], strict=True):
            own = n_entries[row[at:to]]
            entries, weight = _ranges(entry[row[at:to]], own), np.repeat(weights[pair[at:to]], own)
            most = np.bincount(block[entries], weights=weight * bound[entries], minlength=n_blocks)

            def scored(these, entries=entries, weight=weight):
                """Score of every place of some blocks, and how many postings they have."""
                met = these[block[entries]]
                posting, n = _ranges(first[entries[met]], size[entries[met]]), size[entries[met]]
                score = np.bincount(place[posting], weights=np.repeat(weight[met], n) * gain(tf[posting], length[posting]), minlength=n_blocks * WIDTH)
                return np.floor(score * 1e6 + 0.5) / 1e6, n.sum()

            probe = np.zeros(n_blocks, bool)
            probe[np.argsort(-most, kind="stable")[:k]] = True
            score, read = scored(probe)
            found = np.sort(score[score > 0])[::-1]
            rest = (most >= (found[k - 1] - MARGIN if len(found) >= k else 0.0)) & (most > 0) & ~probe
            if rest.any():
                others, n = scored(rest)
                score, read = score + others, read + n
            best = np.flatnonzero(score > 0)
            best = best[np.lexsort((best, -score[best]))[:k]]
            out.append((asked[pair[at]], best, score[best], read, size[entries].sum()))
        query = np.concatenate([np.full(len(best) + 1, q) for q, best, *_ in out])
        columns = [np.concatenate([np.append(-1, best) for _, best, *_ in out]), np.concatenate([np.append(0.0, score) for _, _, score, *_ in out])]
        counted = [np.concatenate([np.append(x[c], np.zeros(len(x[1]), np.int64)) for x in out]) for c in (3, 4)]
        return pa.table([pa.array(np.full(len(query), shard)), pa.array(ids).take(pa.array(query)), *map(pa.array, columns + counted)], ["shard", "query_id", "place", "score", "read", "held"])

    return run


def blockmax_topk(stored: BlockIndex, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, text_col: str = "query", counts: dict | None = None) -> DataFrame:
    """``query_id, rank, chunk_id, score``: the same rows as ``bm25_topk``.

    The rows of asked terms are shuffled by their shard, once for a block of about
    ``bm25.QUERY_BLOCK`` queries, and a shard hands on k places a query.
    ``counts``, if given, gets the number of postings ``read`` for the queries and
    of ``all`` in the lists of their terms.  A term of negative weight makes a bound useless;
    the index is then searched in full.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    wanted = materialize(query_terms(queries, text_col).join(term_idf(stored.index), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")), "asked")
    if not wanted.where("weight < 0").isEmpty():
        return bm25_topk(stored.index, queries, k, k1, b, text_col)
    mean = stored.index.lengths.agg(F.avg("length")).first()[0] or 1.0
    parts, sent_kind = [], "string" if kind == "string" else "long"
    for part, sent in bm25.sent_blocks(wanted):
        rows = stored.rows.join(bm25.few(part.select("term").distinct()), "term", "left_semi").select("shard", "term", *_LISTS)
        parts.append(rows.groupBy("shard").applyInArrow(_best_in_shard(sent, k, mean, k1, b), f"shard long, query_id {sent_kind}, place long, score double, read long, held long"))
    chunks = stored.rows.where("term is null").select("shard", F.posexplode("chunk_ids").alias("place", "chunk_id"))
    if not parts:
        return chunks.limit(0).select(F.lit(None).cast(kind).alias("query_id"), F.lit(0).cast("long").alias("rank"), "chunk_id", F.lit(0.0).alias("score"))
    found = materialize(reduce(DataFrame.unionByName, parts), "best-of-shards")
    if counts is not None:
        counts["read"], counts["all"] = (x or 0 for x in found.agg(F.sum("read"), F.sum("held")).first())
    found = found.where("place >= 0").join(chunks, ["shard", "place"]).select(F.col("query_id").cast(kind).alias("query_id"), "chunk_id", "score")
    return top_k(found, k, [F.desc("score"), "chunk_id"]).select("query_id", "rank", "chunk_id", "score")

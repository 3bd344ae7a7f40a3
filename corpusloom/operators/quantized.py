"""Approximate nearest vectors from cells and product-quantised codes, kept on storage.

A vector is indexed by its cell, the nearest of some centres, and by a code: its
difference from the centre, cut in parts, each as the number of the nearest of 256
codewords.  A search adds up, from a table of the query's distances to all codewords,
what the codes of the cells it looks into say, keeps the best of them, and measures
only those at full width.  The model is learnt once; further vectors are encoded
with it and appended.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.bm25 import top_k
from corpusloom.operators.dense import dot, whole, whole_vectors
from corpusloom.operators.sampling import hash_sample
from corpusloom.session import exists, listed

#: Vectors that the model is learnt from, at most; codewords of a part; centres at most.
SAMPLE, WORDS, MOST_CELLS = 20_000, 256, 4096
#: Queries whose tables a task holds at once, and vectors whose distances it holds at once.
QUERIES, ROWS = 128, 4096
#: Survivors (query and id) that are sent to the vectors; more are joined.
MAX_SENT = 1_000_000


@dataclass(frozen=True)
class Quantizer:
    """centres: cells x dimensions; words: parts x WORDS x dimensions of a part (the last part may be padded)."""

    centres: np.ndarray
    words: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.words)

    def _cut(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), self.parts * self.words.shape[2]), dtype=np.float32)
        wide[:, : x.shape[1]] = x
        return wide.reshape(len(x), self.parts, -1)

    def cells(self, unit: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest cells of each unit vector, nearest first."""
        return np.argsort(-(unit @ self.centres.T), axis=1, kind="stable")[:, :n]

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of each unit vector."""
        cell = self.cells(unit)[:, 0]
        rest = self._cut(unit - self.centres[cell])
        code = np.stack([((rest[:, p, None] - self.words[p][None]) ** 2).sum(axis=2).argmin(axis=1) for p in range(self.parts)], axis=1)
        return cell, code.astype(np.uint8)

    def table(self, unit: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with all codewords: queries x parts x WORDS."""
        return np.einsum("qpd,pwd->qpw", self._cut(unit), self.words)


def _kmeans(x: np.ndarray, k: int, draw: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[draw.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([((centres**2).sum(axis=1) - 2 * x[a : a + 2048] @ centres.T).argmin(axis=1) for a in range(0, len(x), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def fit_quantizer(corpus: DataFrame, parts: int | None = None, seed: int = 17) -> Quantizer:
    """Learn from at most ``SAMPLE`` vectors, chosen by a hash of the id; the cells grow with the root of the corpus.

    ``parts`` is half the dimensions if not given, so a code takes an eighth of the
    vector's bytes as floats.  Vectors with null or not finite entries, or of another
    length than most, are not indexed.
    """
    rows = whole(corpus).select(F.col("chunk_id").alias("id"), "embedding")
    total = rows.count()
    chosen = rows.join(F.broadcast(hash_sample(rows.select("id"), SAMPLE)), "id").groupBy("id").agg(F.min("embedding").alias("embedding")).orderBy("id")
    found = [r.embedding for r in chosen.collect()]
    if not found:
        return Quantizer(np.zeros((1, 0), np.float32), np.zeros((1, 1, 1), np.float32))
    x, draw = _unit(np.array(found, dtype=np.float32)), np.random.default_rng(seed)
    centres = _kmeans(x, min(len(x), MOST_CELLS, max(1, round(total**0.5))), draw).astype(np.float32)
    parts = min(x.shape[1], parts or -(-x.shape[1] // 2))
    width = -(-x.shape[1] // parts)
    parts = -(-x.shape[1] // width)
    near = np.concatenate([(x[a : a + 2048] @ centres.T).argmax(axis=1) for a in range(0, len(x), 2048)])
    rest = np.zeros((len(x), parts * width), dtype=np.float32)
    rest[:, : x.shape[1]] = x - centres[near]
    rest = rest.reshape(len(x), parts, width)
    words = np.zeros((parts, WORDS, width), dtype=np.float32)
    for p in range(parts):
        own = _kmeans(rest[:, p], min(WORDS, len(x)), draw)
        words[p] = np.concatenate([own, np.repeat(own[:1], WORDS - len(own), axis=0)])
    return Quantizer(centres, words)


def _vectors(batch, dimensions: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows of a batch (chunk_id, embedding) that have a whole vector, and these at length 1."""
    whole = whole_vectors(batch, dimensions)
    flat = np.asarray(whole.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float32)
    return whole, _unit(flat.reshape(whole.num_rows, -1)) if whole.num_rows else np.zeros((0, 0), np.float32)


def save_index(corpus: DataFrame, path: str, model: Quantizer | None = None) -> None:
    """Encode ``corpus`` (``chunk_id, embedding``) under ``path``: with a new model if there is none yet, else with that of the index, as an addition.

    Every row with a vector is indexed.  Codes are dealt by cell, so that a search
    of a few cells reads a few files; a large cell is several files.
    """
    spark = corpus.sparkSession
    if not exists(spark, f"{path}/model/_SUCCESS"):
        learnt = model or fit_quantizer(corpus)
        spark.createDataFrame([(bytearray(pickle.dumps((learnt.centres, learnt.words))),)], "model binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    sent = spark.sparkContext.broadcast(load_model(spark, path))  # at most MOST_CELLS + WORDS vectors

    def run(batches):
        for batch in batches:
            whole, unit = _vectors(batch, sent.value.centres.shape[1])
            for a in range(0, whole.num_rows, 1024):
                cell, code = sent.value.encode(unit[a : a + 1024])
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(a, 1024), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], ["chunk_id", "cell", "code"])

    rows = corpus.select("chunk_id", "embedding")
    kind = rows.schema["chunk_id"].dataType.simpleString()
    coded = rows.mapInArrow(run, f"chunk_id {kind}, cell int, code binary")
    coded.repartition(F.col("cell"), F.pmod(F.xxhash64("chunk_id"), F.lit(4))).sortWithinPartitions("cell").write.mode("append").parquet(f"{path}/codes")


def load_model(spark: SparkSession, path: str) -> Quantizer:
    """The model of an index that :func:`save_index` has written."""
    return Quantizer(*pickle.loads(bytes(spark.read.parquet(f"{path}/model").first().model)))


def _best_codes(model: Quantizer, ids: list, unit: np.ndarray, look: np.ndarray, keep: int):
    """A function over Arrow batches (chunk_id, cell, code): the ``keep`` best codes of each query, of one task."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, model.parts)
            cells = batch.column(1).to_numpy()
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            for first in range(0, len(ids), QUERIES):
                some = slice(first, first + QUERIES)
                table = model.table(unit[some])
                centred = unit[some] @ model.centres.T
                for cell in np.unique(cells):
                    asking = np.flatnonzero((look[some] == cell).any(axis=1))
                    rows = np.flatnonzero(cells == cell)
                    for a in range(0, len(rows) if len(asking) else 0, ROWS):
                        part = rows[a : a + ROWS]
                        near = np.repeat(centred[asking, cell][:, None], len(part), axis=1)
                        for p in range(model.parts):
                            near += table[asking, p][:, codes[part, p]]
                        for j, q in enumerate(asking):
                            best = np.argpartition(-near[j], keep - 1)[:keep] if len(part) > keep else np.arange(len(part))
                            held.setdefault(first + q, []).append((near[j][best], names[part[best]]))
                            if len(held[first + q]) > 8:
                                held[first + q] = [_cut_back(held[first + q], keep)]
        rows = [(ids[q], name, float(s)) for q, found in held.items() for s, name in zip(*_cut_back(found, keep), strict=True)]
        return list(zip(*rows, strict=True)) or [[], [], []]

    return run


def _cut_back(found: list, keep: int) -> tuple[np.ndarray, np.ndarray]:
    near, names = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    best = np.argsort(-near, kind="stable")[:keep]
    return near[best], names[best]


def survivors(spark: SparkSession, path: str, queries: DataFrame, share: float = 0.8, keep: int = 100) -> DataFrame:
    """``query_id, chunk_id``: the ``keep`` vectors of each query that their codes call nearest, from the nearest ``share`` of the cells.

    How many of the true nearest are among them depends on the vectors: where they
    fall in groups a tenth of the cells will do, where they are nearly random most
    cells have some (README).
    """
    model = load_model(spark, path)
    codes = spark.read.parquet(f"{path}/codes").select("chunk_id", "cell", "code")
    kinds = [queries.schema["query_id"].dataType.simpleString(), codes.schema["chunk_id"].dataType.simpleString()]
    asked = queries.where(F.size("embedding") == model.centres.shape[1]).select("query_id", "embedding")
    look = max(1, round(share * len(model.centres)))
    sent = spark.sparkContext.broadcast(model)

    def block(rows):
        ids = [r.query_id for r in rows]
        unit = _unit(np.array([r.embedding for r in rows], dtype=np.float32))
        given = spark.sparkContext.broadcast((ids, unit, model.cells(unit, look)))

        def run(batches):
            columns = _best_codes(sent.value, *given.value, keep)(batches)
            types = [pa.from_numpy_dtype(np.int64) if k in ("bigint", "int", "smallint", "tinyint") else pa.string() for k in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], types[0]), pa.array(columns[1], types[1]), pa.array(columns[2], pa.float64())], ["query_id", "chunk_id", "near"])

        simple = ["long" if k in ("bigint", "int", "smallint", "tinyint") else "string" for k in kinds]
        return codes.mapInArrow(run, f"query_id {simple[0]}, chunk_id {simple[1]}, near double")

    out, held = None, []
    for row in asked.toLocalIterator():  # a block of queries is at the driver at once
        held.append(row)
        if len(held) == 4096:
            out, held = (block(held) if out is None else out.unionByName(block(held))), []
    if held or out is None:
        last = block(held) if held else codes.limit(0).select(F.lit(None).cast(kinds[0]).alias("query_id"), "chunk_id", F.lit(0.0).alias("near"))
        out = last if out is None else out.unionByName(last)
    return top_k(out, keep, [F.desc("near"), "chunk_id"]).select("query_id", "chunk_id")


def quantized_topk(path: str, queries: DataFrame, corpus: DataFrame, k: int = 10, share: float = 0.8, keep: int = 100) -> DataFrame:
    """``query_id, rank, chunk_id, distance``: the k nearest by cosine, of those that the index at ``path`` lets through.

    ``corpus`` (``chunk_id, embedding``) gives the vectors of the survivors, the only
    ones that are measured.  Queries without a vector have no row; ids of the index
    that the corpus lacks are left out; ties go to the smaller id.
    """
    spark = queries.sparkSession
    found = survivors(spark, path, queries, share, keep)
    few = found.limit(MAX_SENT + 1).count() <= MAX_SENT
    met = corpus.select("chunk_id", F.col("embedding").alias("x")).join(F.broadcast(found) if few else found, "chunk_id")
    both = met.join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    size = F.sqrt(dot(F.col("x"), F.col("x"))) * F.sqrt(dot(F.col("q"), F.col("q")))
    measured = both.select("query_id", "chunk_id", F.round(1 - F.when(size > 0, dot(F.col("q"), F.col("x")) / size).otherwise(0.0), 6).alias("distance")).distinct()
    return top_k(measured, k, ["distance", "chunk_id"]).select("query_id", "rank", "chunk_id", "distance")


def stored_parts(spark: SparkSession, path: str) -> list[str]:
    """Names of the code files; an addition makes new ones and leaves the old as they are."""
    return [n for n in listed(spark, f"{path}/codes") if n.startswith("part-")]

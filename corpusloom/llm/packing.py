"""Best-fit packing of documents into sequences of a fixed number of tokens.

Only the lengths matter for a packing, and there are at most ``capacity`` of
them.  So Spark tokenizes and counts pieces by length, the driver plans on that
histogram (its size does not grow with the corpus), and Spark hands every piece
the place that its rank among the pieces of its length has in the plan.

The plan first applies dominance reduction in the manner of Martello and Toth:
where one small set of lengths provably serves at least as well as every other
way to fill up a sequence, it is fixed for as many sequences as the counts give.
Best-fit decreasing packs what remains.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tokens import default_path, encoder
from corpusloom.operators.ranking import distributed_rank
from corpusloom.session import materialize

CAPACITY = 4096
END_ID = 1
PIECES = "id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that one task numbers.
BUCKET_ROWS = 20_000


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row per piece: ``id, piece, start, length, ids_crc32``.

    A document is its token ids and then ``end_id``; only one that is longer than
    ``capacity`` is cut, and its last piece may be shorter.
    """
    path = path or default_path()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i, raw in zip(ids, encoder(path).encode(batch.column(1).to_pylist()), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, crc32(part)))
            names = ["id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


class _Plan:
    """Which ranks of each length go into which sequences, at which offset."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.left = counts.astype(object)
        self.capacity = capacity
        self.used = dict.fromkeys(np.flatnonzero(counts).tolist(), 0)
        self.sequences = 0
        #: length, first rank, ranks after the last, pieces a sequence, first sequence, offset
        self.rows: list[tuple[int, int, int, int, int, int]] = []

    def put(self, length: int, each: int, bins: int, first: int, offset: int) -> None:
        start = self.used[length]
        self.used[length] = end = start + each * bins
        self.left[length] -= each * bins
        self.rows.append((length, start, end, each, first, offset))

    def fix(self, *lengths: int) -> int:
        """Fill as many new sequences as possible with these lengths."""
        need = {n: lengths.count(n) for n in lengths}
        bins, offset = min(self.left[n] // k for n, k in need.items()), 0
        for n in sorted(need, reverse=True):
            self.put(n, need[n], bins, self.sequences, offset)
            offset += n * need[n]
        self.sequences += bins
        return bins


def _dominant(plan: _Plan, there: list[int], length: int) -> tuple[int, ...] | None:
    """A set with ``length`` that is at least as good as any other, if one is known."""
    room = plan.capacity - length

    def free(n: int) -> int:
        return plan.left[n] - (n == length)

    fits = [n for n in there[: bisect_left(there, room + 1)] if free(n)]
    if not fits:
        return (length,)  # nothing fits beside it
    best = fits[-1]
    if best == room:
        return (length, best)  # filled up by one
    two = fits[0] * 2 if free(fits[0]) > 1 else sum(fits[:2]) if len(fits) > 1 else room + 1
    if two > room:
        return (length, best)  # no two fit, so the largest one is best
    smallest = [n for n in fits[:3] for _ in range(min(3, free(n)))][:3]
    if len(smallest) < 3 or sum(smallest) > room:  # at most two fit
        pair, low, high = 0, 0, len(fits) - 1
        while low <= high:
            total = fits[low] + fits[high]
            if total > room or (low == high and free(fits[low]) < 2):
                high -= 1
            else:
                pair, low = max(pair, total), low + 1
        if best >= pair:
            return (length, best)  # one is as large as any two
        beside = [n for n in fits[: bisect_left(fits, room - best + 1)] if free(n) > (n == best)]
        if beside:
            larger = [n for n in fits[bisect_left(fits, beside[-1] + 1) :][:2] for _ in range(min(2, free(n)))][:2]
            if len(larger) < 2 or sum(larger) > room:
                return (length, best, beside[-1])  # no two fit of which the smaller is larger than the one beside the largest
    return None


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int, int]:
    """Plan for ``counts[n]`` pieces of each length n from 1 to ``capacity``.

    Returns the rows of the plan, the number of sequences, and how many of them
    dominance fixed.  Work and size depend on the number of lengths alone.
    """
    plan = _Plan(counts, capacity)
    there = sorted(plan.used)
    for length in reversed(list(there)):
        while plan.left[length]:
            lengths = _dominant(plan, there, length)
            if lengths is None or not plan.fix(*lengths):
                break
        there = [n for n in there if plan.left[n]]
    fixed = plan.sequences

    rooms: list[int] = []  # free room of the open groups, sorted
    groups: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, sequences)

    def keep(room: int, first: int, bins: int) -> None:
        if room and bins:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((first, bins))

    def fill(length: int, room: int, first: int, bins: int) -> None:
        """Into sequences with this room, one after the other as long as it fits."""
        each = room // length
        full = min(bins, plan.left[length] // each)
        if full:
            plan.put(length, each, full, first, capacity - room)
            keep(room - each * length, first, full)
        some = min(plan.left[length], each) if full < bins else 0
        if some:
            plan.put(length, some, 1, first + full, capacity - room)
            keep(room - some * length, first + full, 1)
        keep(room, first + full + bool(some), bins - full - bool(some))

    for length in reversed(there):
        while plan.left[length]:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, bins = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
                fill(length, room, first, bins)
            else:
                bins = -(-plan.left[length] // (capacity // length))
                plan.sequences += bins
                fill(length, capacity, plan.sequences - bins, bins)
    return plan.rows, plan.sequences, fixed


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``id, piece, start, length, ids_crc32``.

    Offsets in a sequence are gapless from 0.  ``pieces`` is read three times.
    """
    spark = pieces.sparkSession
    histogram = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram:
        counts[length] = n
    rows, _, _ = plan_packing(counts, capacity)
    # bounded by the number of lengths, so it may be broadcast
    plan = (
        spark.createDataFrame([tuple(map(int, r)) for r in rows], "length long, from_rank long, to_rank long, each long, first long, at long")
        .groupBy("length")
        .agg(F.sort_array(F.collect_list(F.struct("from_rank", "to_rank", "each", "first", "at"))).alias("steps"))
    )
    buckets = max(16, int(counts.sum()) // BUCKET_ROWS)
    ranked = distributed_rank(pieces, ["length"], F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)), ["id", "piece", "start", "ids_crc32"])
    step = F.filter("steps", lambda s: (s["from_rank"] <= F.col("rank")) & (F.col("rank") < s["to_rank"]))[0]
    placed = ranked.join(F.broadcast(plan), "length").withColumn("step", step)
    within = F.col("rank") - F.col("step.from_rank")
    return placed.select(
        "id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("step.first") + F.floor(within / F.col("step.each"))).cast("long").alias("sequence_id"),
        (F.col("step.at") + within % F.col("step.each") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Tokenize and pack every row of ``df``; one row per piece.

    A null or empty text is the end id alone.  Null ids and repeated rows are
    packed like any other; an empty table gives an empty result; further columns
    are ignored.
    """
    pieces = materialize(token_pieces(df, id_col, text_col, capacity, end_id, path), "pieces")
    return pack(pieces, capacity).withColumnRenamed("id", id_col)

"""Which texts hold which passages word for word, for many of both at once.

A window of fixed length slides over a text, and of each run of windows the one with
the least hash is an anchor.  Two texts that share a stretch as long as a run share
its anchor, so a passage meets the texts that hold it by equality of one anchor, its
rarest, and only those that meet are searched.  Passages of about one length (a
power of two) share the length of the window, so short ones are found as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize

#: Anchors of passages, and texts to be searched with their passages, that are sent to the texts; more are joined.
MAX_SENT, MAX_PAIRS = 2_000_000, 100_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _window_hashes(text: str, c: int) -> np.ndarray:
    """Hashes of all windows of 2**c characters, by doubling."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) * _A
    h ^= h >> np.uint64(29)
    for k in range(c):
        step = 1 << k
        if len(h) <= step:
            return h[:0]
        h = (h[:-step] ^ (h[:-step] >> np.uint64(31))) * _B + h[step:] * _A
        h ^= h >> np.uint64(29)
    return h


def text_anchors(text: str | None, classes: list[int]) -> list[np.ndarray]:
    """For each class of lengths, the different anchors of a text.

    Passages of class ``c`` have 2**c to 2**(c + 1) - 1 characters; windows have half
    of the least length, and a run of them covers just that length.
    """
    out = []
    for c in classes:
        h = _window_hashes(text or "", max(0, c - 1))
        run = (1 << c) - (1 << max(0, c - 1)) + 1
        if len(h) < run:
            out.append(h[:0])
            continue
        low, width = h, 1
        while 2 * width <= run:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        out.append(np.unique(np.minimum(low[: len(h) - run + 1], low[run - width :])))
    return out


def _anchored(rows: DataFrame, classes: list[int], own: bool) -> DataFrame:
    """``id, class, anchor`` of texts, in all classes or (``own``) in the class of their length."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                place, kinds, anchors = [], [], []
                for k, value in enumerate(part.column(1)):
                    text = value.as_py() or ""
                    some = [len(text).bit_length() - 1] if own and text else [] if own else classes
                    for c, found in zip(some, text_anchors(text, some), strict=True):
                        place.append(np.full(len(found), k))
                        kinds.append(np.full(len(found), c))
                        anchors.append(found.view(np.int64))
                joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (place, kinds, anchors)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(joined[0])), pa.array(joined[1].astype(np.int32)), pa.array(joined[2].astype(np.int64))], ["id", "class", "anchor"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, class int, anchor long")


def holders(passages: DataFrame, texts: DataFrame, passage_id: str = "query_id", text_id: str = "chunk_id", passage: str = "passage", text: str = "text") -> DataFrame:
    """``passage_id, text_id`` of every text that holds a passage, as ``contains`` has it.

    Null and empty passages are in no text.  Repeated rows count once; rows whose id is null have no place in the result.
    No text meets a passage that it does not share an anchor with; the anchor is the
    one of the passage that fewest texts have.
    """
    asked = materialize(passages.select(F.col(passage_id).alias("id"), F.col(passage).alias("passage")).where("length(passage) > 0").distinct().withColumn("number", F.monotonically_increasing_id()), "passages")
    classes = sorted(r.c for r in asked.select(F.floor(F.log2(F.char_length("passage"))).cast("int").alias("c")).distinct().collect())  # some twenty
    wanted = materialize(_anchored(asked.select(F.col("number").alias("id"), "passage"), classes, own=True).withColumnRenamed("id", "number"), "passage-anchors")
    keys = wanted.select("class", "anchor").distinct()
    few = keys.limit(MAX_SENT + 1).count() <= MAX_SENT
    rows = texts.select(F.col(text_id).alias("id"), F.col(text).alias("text")).where("length(text) > 0")
    found = _anchored(rows, classes, own=False)
    met = materialize(found.join(F.broadcast(keys) if few else keys, ["class", "anchor"], "left_semi").withColumnRenamed("id", "__text"), "met-anchors")
    counts = met.groupBy("class", "anchor").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("number").orderBy(F.coalesce("n", F.lit(0)), "class", "anchor")
    one = wanted.join(counts, ["class", "anchor"], "left").withColumn("k", F.row_number().over(rarest)).where("k = 1 and n > 0").select("number", "class", "anchor")
    pairs = materialize(met.join(one, ["class", "anchor"]).select("number", "__text").distinct(), "pairs")
    met_pairs = pairs.join(asked, "number")
    met_pairs = F.broadcast(met_pairs) if pairs.count() <= MAX_PAIRS else met_pairs
    held = met_pairs.join(rows.withColumnRenamed("id", "__text"), "__text")
    return held.where(F.contains("text", "passage")).select(F.col("id").alias(passage_id), F.col("__text").alias(text_id)).distinct()

"""Incremental ingestion of document files into a chunk table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.chunking import fixed_chunks
from corpusloom.session import exists, materialize, scratch


#: Folders of a chunk table; a batch reads only the ids in the folders that its own ids fall into.
BUCKETS = 256


def lacking(batch: DataFrame, path: str, id_col: str = "chunk_id", key: str = "doc_id") -> DataFrame | None:
    """The rows of a batch whose id the table at ``path`` lacks, one of each id, with the ``bucket`` they belong to; None if it lacks none.

    The table is kept in folders by a hash of ``key``, so that a small batch is
    compared with the ids in a few of them.  Ids alone are compared; whole rows are
    shuffled only if some of the ids are there, or come twice, and others are new.
    To be called in a ``scratch``, as ids are written on the way.
    """
    spark = batch.sparkSession
    rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    ids = new = materialize(rows.groupBy("bucket", id_col).agg(F.count("*").alias("n")), "ids")
    if exists(spark, path):
        met = [r.bucket for r in ids.select("bucket").distinct().collect()]  # at most BUCKETS
        there = spark.read.schema(ids.select("bucket", id_col).schema).parquet(path).where(F.col("bucket").isin(met))
        # by merge: a small file of ids may be many rows, and Spark would send them all to the driver and each task
        new = materialize(ids.join(there.hint("merge"), ["bucket", id_col], "left_anti"), "new-ids")
    found, most = new.agg(F.count("*"), F.max("n")).first()
    if not found:
        return None
    if new is not ids and found < ids.count():
        rows = rows.join(new.select("bucket", id_col).hint("merge"), ["bucket", id_col], "left_semi").select(*rows.columns)
    return rows.dropDuplicates([id_col]) if most > 1 else rows


def append(rows: DataFrame, path: str) -> None:
    """Append what ``lacking`` gave to the table at ``path``: one file a folder, however many tasks have rows of it."""
    rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def append_new(batch: DataFrame, path: str, id_col: str = "chunk_id", key: str = "doc_id") -> None:
    """Append the rows of a batch whose id the table at ``path`` lacks."""
    with scratch(batch.sparkSession):
        rows = lacking(batch, path, id_col, key)
        if rows is not None:
            append(rows, path)


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, size: int = 1000, overlap: int = 200, ts: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Chunk every document that arrives under ``source`` and append its new chunks to ``target``.

    A replayed batch adds nothing, since ids that are there are skipped.  Where the
    documents have a time in ``ts``, one that comes again within ``late`` is dropped
    on the stream by its id, with a state that the watermark bounds.
    """
    docs = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
    if ts:
        docs = docs.withWatermark(ts, late).dropDuplicatesWithinWatermark(["doc_id"])
    chunks = fixed_chunks(docs, "doc_id", "text", size, overlap)
    write = chunks.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return write.foreachBatch(lambda batch, _: append_new(batch, target)).start()


#: Progress of a document, and what is said of it.
STEPS = {10: "announced", 20: "text accepted", 70: "chunks and vectors made", 90: "appended", 100: "completed"}
_UPDATES = "doc_id long, progress int, status string, text string"
#: Groups of documents by a hash of their id.
GROUPS = 16384
_STATE = "docs array<long>, done array<long>, until array<long>"


def track(events: DataFrame, patience: str = "1 hour", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """``doc_id, progress, status, text`` for a stream of ``doc_id, ts, text``: what each event changes for its document.

    A document may be announced without a text and get it later; the first text
    counts.  The state of a document is how far it has come, so an event that comes
    again says nothing.  One that has no text ``patience`` after its last event, in
    event time, has failed, and may be announced anew.  Events later than ``late``
    are dropped, and a completed document is forgotten after as long.

    Documents are followed in ``GROUPS`` groups, as a call of Python takes milliseconds
    however few they are: what a group holds is its part of a batch and three numbers
    of each document that is not forgotten.
    """
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        docs, done, until = (np.array(x, np.int64) for x in (state.get if state.exists else ([], [], [])))
        now, parts = state.getCurrentWatermarkMs(), [] if state.hasTimedOut else list(parts)
        came, at, said = (np.concatenate([p[c].to_numpy() for p in parts]) if parts else np.zeros(0, np.int64) for c in ("doc_id", ts, "text"))
        order = np.argsort(at, kind="stable")
        came, at, said = came[order].astype(np.int64), at[order].astype("datetime64[ms]").astype(np.int64), said[order]
        told = np.flatnonzero([bool(t) for t in said])
        here, last = np.unique(came[::-1], return_index=True)
        texted, first = np.unique(came[told], return_index=True)
        every = np.union1d(docs, here)
        was, end, seen, has = (np.zeros(len(every), np.int64) for _ in range(4))
        known, place = np.searchsorted(every, docs), np.searchsorted(every, here)
        was[known], end[known] = done, until
        end[place], seen[place], has[np.searchsorted(every, texted)] = np.maximum(at[::-1][last] + wait, now + 1), 1, 1
        text = np.full(len(every), None, object)
        text[has > 0] = said[told[first]]
        gone = (seen == 0) & (end < now)
        steps = ((seen > 0) & (was < 10), 10, "processing"), ((has > 0) & (was < 20), 20, "processing"), (gone & (was < 20), None, "failed")
        rows = [(every[w], was[w] if p is None else np.full(w.sum(), p), np.full(w.sum(), what, object), text[w] if p == 20 else np.full(w.sum(), None)) for w, p, what in steps if w.any()]
        stays, far = ~gone, np.maximum(was, np.where(has > 0, 20, np.where(seen > 0, 10, 0)))
        if stays.any():
            state.update((every[stays].tolist(), far[stays].tolist(), end[stays].tolist()))
            state.setTimeoutTimestamp(int(end[stays].min()))
        else:
            state.remove()
        if rows:
            yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(("doc_id", "progress", "status", "text"), zip(*rows, strict=True), strict=True)})

    group = F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)).alias("group")
    keyed = events.where("doc_id is not null").withWatermark(ts, late).select(group, "doc_id", ts, "text").groupBy("group")
    return keyed.applyInPandasWithState(step, _UPDATES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _report(rows: DataFrame, target: str) -> None:
    """Append the rows ``doc_id, progress, status`` that are not there, each with its message."""
    said = F.create_map(*[F.lit(x) for item in STEPS.items() for x in item])
    shown = rows.withColumn("message", F.when(F.col("status") == "failed", "no text came").otherwise(said[F.col("progress")]))
    append_new(shown.withColumn("step_id", F.concat_ws("-", "doc_id", "progress", "status")), f"{target}/progress", "step_id")


def ingest_uploads(events: DataFrame, target: str, checkpoint: str, vectors: Callable[[DataFrame], DataFrame], size: int = 1000, overlap: int = 200, patience: str = "1 hour", late: str = "1 hour") -> StreamingQuery:
    """Chunks with vectors under ``target/chunks`` and progress under ``target/progress``, for a stream of ``doc_id, ts, text``.

    ``vectors`` gives ``chunk_id, embedding`` for chunks that are not in the table, or
    the chunks with all their columns and ``embedding``, which saves a join.  A
    document's steps are reported as they are reached: 10 and 20 before, 70, 90 and
    100 after its chunks are in the table.  A batch that fails in between is run again
    and adds what is missing, since chunks and steps that are there are skipped.
    """

    def write(batch: DataFrame, _: int) -> None:
        with scratch(batch.sparkSession):
            changed = materialize(batch, "updates")
            if changed.isEmpty():  # a batch that only moves the watermark on
                return
            _report(changed.select("doc_id", "progress", "status"), target)
            accepted = changed.where("text is not null").select("doc_id", "text")
            chunks = lacking(fixed_chunks(accepted, "doc_id", "text", size, overlap), f"{target}/chunks")
            if chunks is not None:
                found = vectors(chunks)
                append(found if set(chunks.columns) <= set(found.columns) else chunks.join(found, "chunk_id", "left"), f"{target}/chunks")
            after = F.explode(F.array(*[F.struct(F.lit(p).alias("progress"), F.lit("completed" if p == 100 else "processing").alias("status")) for p in (70, 90, 100)]))
            _report(accepted.select("doc_id", after.alias("at")).select("doc_id", "at.progress", "at.status"), target)

    return track(events, patience, late).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()

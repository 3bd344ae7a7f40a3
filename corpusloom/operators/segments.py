"""A sparse index on storage that takes additions and deletions without being built anew.

The index is a row of immutable entries, each in a folder of its own: a segment
holds postings, lengths and document frequencies of chunks that were added
together; a removal holds the ids that went, and how far the frequencies fall.
An entry cancels only what came before it, so a chunk may go and come again.  The
folder ``versions`` says which entries make up the index; a version is written
once and whole, readers keep to the one they opened, and of two writers at the
same time one fails.  :func:`merge` makes one segment of many.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.bm25 import SparseIndex, count_terms, count_words
from corpusloom.session import discard, listed, materialize, remove

#: Removed ids that are sent to the postings rather than shuffled.
MAX_REMOVED = 1_000_000
#: Entries from which :func:`add` and the removals merge.
MAX_ENTRIES = 64


@dataclass(frozen=True)
class Entry:
    """A segment or a removal, its place in the order, its chunks and tokens (negative for a removal)."""

    name: str
    kind: str
    place: int
    chunks: int
    tokens: int


@dataclass(frozen=True)
class StoredIndex:
    """One version of the index at ``path``; ``kinds`` are the types of chunk and document ids."""

    spark: SparkSession
    path: str
    version: int
    entries: tuple[Entry, ...]
    kinds: tuple[str, str]

    def _all(self, kind: str, table: str, schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{e.name}/{table}").withColumn("place", F.lit(e.place)) for e in self.entries if e.kind == kind]
        out = self.spark.createDataFrame([], f"{schema}, place int")
        for p in parts:
            out = out.unionByName(p)
        return out

    def _alive(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``chunk_id`` and ``place``) that no later entry has removed."""
        if not any(e.kind == "removal" for e in self.entries):
            return rows.drop("place")
        gone = self._all("removal", "chunks", f"chunk_id {self.kinds[0]}").groupBy("chunk_id").agg(F.max("place").alias("gone"))
        few = -sum(e.chunks for e in self.entries if e.kind == "removal") <= MAX_REMOVED
        met = rows.join(F.broadcast(gone) if few else gone, "chunk_id", "left")
        return met.where("gone is null or place > gone").drop("place", "gone")

    def lengths(self) -> DataFrame:
        """``chunk_id, doc_id, length`` of the chunks there are."""
        return self._alive(self._all("segment", "lengths", f"chunk_id {self.kinds[0]}, doc_id {self.kinds[1]}, length long"))

    def postings(self) -> DataFrame:
        return self._alive(self._all("segment", "postings", f"chunk_id {self.kinds[0]}, term string, tf long, length long"))

    def terms(self) -> DataFrame:
        """Document frequencies: those of the segments less those of the removals."""
        both = self._all("segment", "terms", "term string, df long").unionByName(self._all("removal", "terms", "term string, df long"))
        return both.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def index(self) -> SparseIndex:
        """The index as searches take it."""
        return SparseIndex(self.postings(), self.lengths().select("chunk_id", "length"), self.terms())

    @property
    def n_chunks(self) -> int:
        return sum(e.chunks for e in self.entries)

    @property
    def n_tokens(self) -> int:
        return sum(e.tokens for e in self.entries)


_ENTRIES = "name string, kind string, place int, chunks long, tokens long, chunk_kind string, doc_kind string"


def open_index(spark: SparkSession, path: str, version: int | None = None) -> StoredIndex:
    """The newest version of the index at ``path``, or the one asked for."""
    if version is None:
        found = [int(n) for n in listed(spark, f"{path}/versions") if n.isdigit() and "_SUCCESS" in listed(spark, f"{path}/versions/{n}")]
        if not found:
            raise FileNotFoundError(f"no index at {path}")
        version = max(found)
    rows = spark.read.schema(_ENTRIES).parquet(f"{path}/versions/{version}").orderBy("place").collect()  # one row an entry
    return StoredIndex(spark, path, version, tuple(Entry(*r[:5]) for r in rows if r.kind != "empty"), (rows[0].chunk_kind, rows[0].doc_kind))


def _commit(old: StoredIndex, entries: tuple[Entry, ...]) -> StoredIndex:
    """Write the next version; it fails if another writer has."""
    rows = [(e.name, e.kind, e.place, e.chunks, e.tokens, *old.kinds) for e in entries] or [("", "empty", 0, 0, 0, *old.kinds)]
    old.spark.createDataFrame(rows, _ENTRIES).coalesce(1).write.parquet(f"{old.path}/versions/{old.version + 1}")
    return StoredIndex(old.spark, old.path, old.version + 1, entries, old.kinds)


def create(spark: SparkSession, path: str, chunk_kind: str = "bigint", doc_kind: str = "bigint") -> StoredIndex:
    """An empty index at ``path``, where there must be none; the types are those of chunk and document ids."""
    return _commit(StoredIndex(spark, path, 0, (), (chunk_kind, doc_kind)), ())


def _write_segment(stored: StoredIndex, postings: DataFrame, docs: DataFrame) -> Entry | None:
    """A segment of ``postings`` (materialized) and the documents of its chunks."""
    name, place = f"segment-{uuid.uuid4().hex}", 1 + max((e.place for e in stored.entries), default=0)
    to = f"{stored.path}/{name}"
    lengths = postings.groupBy("chunk_id").agg(F.first("length").alias("length")).join(docs, "chunk_id", "left")
    lengths.select("chunk_id", "doc_id", "length").write.parquet(f"{to}/lengths")
    chunks, tokens = stored.spark.read.parquet(f"{to}/lengths").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    if not chunks:
        remove(stored.spark, to)
        return None
    postings.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{to}/postings")
    count_terms(postings).write.parquet(f"{to}/terms")
    return Entry(name, "segment", place, chunks, tokens)


def add(stored: StoredIndex, chunks: DataFrame, id_col: str = "chunk_id", doc_col: str = "doc_id", text_col: str = "text", most: int = MAX_ENTRIES) -> StoredIndex:
    """Index the chunks whose id the index lacks, as one more segment; all that is written is theirs.

    Chunks without a token or an id are left out, and so are those whose id is there;
    of chunks that share an id the one with the least text counts.  Nothing to add
    makes no version.
    """
    rows = chunks.select(F.col(id_col).cast(stored.kinds[0]).alias("chunk_id"), F.col(doc_col).cast(stored.kinds[1]).alias("doc_id"), F.col(text_col).alias("text"))
    new = rows.where("chunk_id is not null").join(stored.lengths().select("chunk_id"), "chunk_id", "left_anti")
    once = materialize(new.groupBy("chunk_id").agg(F.min(F.struct("text", "doc_id")).alias("one")).select("chunk_id", "one.text", "one.doc_id"), "added")
    postings = materialize(count_words(once, "chunk_id", "text"), "added-postings")
    entry = _write_segment(stored, postings, once.select("chunk_id", "doc_id"))
    discard(once)
    discard(postings)
    return merged_beyond(_commit(stored, (*stored.entries, entry)) if entry else stored, most)


def _remove(stored: StoredIndex, gone: DataFrame, most: int) -> StoredIndex:
    """``gone``: chunk_id and length of chunks of the index."""
    name, place = f"removal-{uuid.uuid4().hex}", 1 + max((e.place for e in stored.entries), default=0)
    to = f"{stored.path}/{name}"
    gone.write.parquet(f"{to}/chunks")
    written = stored.spark.read.parquet(f"{to}/chunks")
    chunks, tokens = written.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    if not chunks:
        remove(stored.spark, to)
        return stored
    ids = written.select("chunk_id")
    lost = stored.postings().select("chunk_id", "term").join(F.broadcast(ids) if chunks <= MAX_REMOVED else ids, "chunk_id", "left_semi")
    lost.groupBy("term").agg((-F.count("*")).alias("df")).write.parquet(f"{to}/terms")
    return merged_beyond(_commit(stored, (*stored.entries, Entry(name, "removal", place, -chunks, -tokens))), most)


def remove_chunks(stored: StoredIndex, ids: DataFrame, id_col: str = "chunk_id", most: int = MAX_ENTRIES) -> StoredIndex:
    """Without the chunks of these ids; unknown ids change nothing, and none of them known makes no version."""
    wanted = ids.select(F.col(id_col).cast(stored.kinds[0]).alias("chunk_id")).distinct()
    return _remove(stored, stored.lengths().select("chunk_id", "length").join(wanted, "chunk_id", "left_semi"), most)


def remove_documents(stored: StoredIndex, docs: DataFrame, doc_col: str = "doc_id", most: int = MAX_ENTRIES) -> StoredIndex:
    """Without the chunks of these documents."""
    wanted = docs.select(F.col(doc_col).cast(stored.kinds[1]).alias("doc_id")).distinct()
    return _remove(stored, stored.lengths().join(wanted, "doc_id", "left_semi").select("chunk_id", "length"), most)


def merge(stored: StoredIndex) -> StoredIndex:
    """One segment of what is left; the folders of the old entries stay until :func:`purge`."""
    if len(stored.entries) < 2:
        return stored
    docs = stored.lengths().select("chunk_id", "doc_id")
    entry = _write_segment(stored, stored.postings(), docs)
    return _commit(stored, (entry,) if entry else ())


def merged_beyond(stored: StoredIndex, most: int) -> StoredIndex:
    return merge(stored) if len(stored.entries) > most else stored


def purge(stored: StoredIndex) -> int:
    """Delete older versions and the folders that this version has no use for; how many folders went.

    For when nobody reads or writes another version.
    """
    used = {e.name for e in stored.entries} | {"versions"}
    gone = [n for n in listed(stored.spark, stored.path) if n not in used and n.startswith(("segment-", "removal-"))]
    for n in gone:
        remove(stored.spark, f"{stored.path}/{n}")
    for n in listed(stored.spark, f"{stored.path}/versions"):
        if n.isdigit() and int(n) < stored.version:
            remove(stored.spark, f"{stored.path}/versions/{n}")
    return len(gone)

"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Radius 3 is odd, so the ball is halved in two exact steps over distinct
fingerprints:

1. Every fingerprint emits the 65 variants within one bit.  Two fingerprints
   share a variant if and only if they differ in at most two bits, so a shared
   variant needs no further check and its (at most 65) owners form a star.
2. For the pairs at exactly three bits, a third of the bits is set aside in
   turn.  One of the thirds holds a differing bit, so at most two differ in the
   rest, and the one-bit variants of the rest meet.  Colliding pairs are verified
   on all 64 bits; fingerprints that step 1 has joined are not compared.

Copies share a fingerprint and count once, so a group of any size costs one ball.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.operators.components import connected_components
from corpusloom.session import materialize

BITS = 64
#: First bit and width of each third.
THIRDS = ((0, 22), (22, 21), (43, 21))
#: A fingerprint is hot if more than one in so many rows has it.
HOT = 5000
#: Shingles that are counted at once, to bound memory on very long texts.
BLOCK = 65536


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def fingerprint_of(text: str | None, width: int, seed: int) -> int:
    """The signed 64-bit SimHash of one text; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(b" ".join(words[i : i + width]), seed) for i in range(at, min(at + BLOCK, n))], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``(id, fingerprint long)`` of every row; null or blank text has fingerprint 0.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of
    fewer words than ``width`` is one shingle.
    """

    def run(batches):
        for batch in batches:
            prints = [fingerprint_of(t, width, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["id", "fp"])

    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "id long, fp long")


def _ball_edges(prints: DataFrame) -> DataFrame:
    """Stars over shared one-bit variants: all pairs of at most two bits."""
    bit = F.col("bit")
    near = prints.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(BITS - 1))).alias("bit")).select(
        "fp", F.when(bit < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.expr("shiftleft(1L, bit)"))).alias("variant")
    )
    owners = Window.partitionBy("variant")
    return (
        near.withColumn("low", F.min("fp").over(owners)).where("fp <> low").select(F.col("fp").alias("src"), F.col("low").alias("dst")).distinct()
    )


def _variants_of_rest() -> list[tuple[int, int, int]]:
    """(third, mask of the kept bits, bit to flip or 0) of every step-2 variant."""
    out = []
    for third, (first, size) in enumerate(THIRDS):
        kept = ((1 << BITS) - 1) & ~(((1 << size) - 1) << first)
        out.append((third, _signed(kept), 0))
        out += [(third, _signed(kept), _signed(1 << b)) for b in range(BITS) if kept >> b & 1]
    return out


def _three_bit_edges(labelled: DataFrame) -> DataFrame:
    """Pairs of components that hold fingerprints exactly three bits apart."""
    moves = F.array(*[F.struct(F.lit(t).cast("byte").alias("third"), F.lit(k).cast("long").alias("kept"), F.lit(f).cast("long").alias("flip")) for t, k, f in _variants_of_rest()])
    emitted = labelled.select("fp", "component", F.explode(moves).alias("m")).select(
        "fp", "component", F.col("m.third").alias("third"), F.col("fp").bitwiseAND(F.col("m.kept")).bitwiseXOR(F.col("m.flip")).alias("variant")
    )
    # a pair three bits apart has one fingerprint of even and one of odd weight
    even = emitted.where("bit_count(fp) % 2 = 0").alias("a")
    odd = emitted.where("bit_count(fp) % 2 = 1").alias("b")
    close = (
        (F.col("a.third") == F.col("b.third"))
        & (F.col("a.variant") == F.col("b.variant"))
        & (F.col("a.component") != F.col("b.component"))
        & F.expr("bit_count(a.fp ^ b.fp) <= 3")
    )
    # Spark sizes the rows of the explode like those before it, so without the hint it broadcasts more than the driver can hold
    return even.hint("merge").join(odd.hint("merge"), close).select(F.col("a.component").alias("src"), F.col("b.component").alias("dst")).distinct()


def link_fingerprints(prints: DataFrame) -> DataFrame:
    """``(fp, component)`` for a DataFrame of fingerprints ``fp``; component is a
    fingerprint of the same group.  Exact for a radius of three bits."""
    distinct = materialize(prints.select("fp").where("fp is not null").distinct(), "prints")
    first = connected_components(_ball_edges(distinct))
    labelled = materialize(
        distinct.join(first, distinct.fp == first.node, "left").select("fp", F.coalesce("component", "fp").alias("component")), "labelled"
    )
    second = connected_components(_three_bit_edges(labelled)).withColumnRenamed("component", "merged")
    return labelled.join(second, labelled.component == second.node, "left").select("fp", F.coalesce("merged", "component").alias("component"))


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: ``id_col``, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id that chains of links of at most three
    differing bits reach.

    Null, blank and one-word texts count like any other; null ids are kept and
    do not become a component id unless a group has no other.  Repeated rows
    stay repeated; an empty table gives an empty result; further columns are
    ignored.
    """
    prints = materialize(fingerprints(df, id_col, text_col, width, seed), "simhash")
    lowest = prints.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    groups = link_fingerprints(prints).join(lowest, "fp")
    of_group = groups.groupBy("component").agg(F.min("low").alias("component_id"))
    of_print = materialize(groups.join(of_group, "component").select("fp", "copies", "component_id"), "of-print")
    # fewer than HOT fingerprints can have more than a HOT-th of the rows: theirs go to every task, so no key of the shuffle is hot
    hot = F.broadcast(of_print.where(F.col("copies") > prints.count() / HOT).select("fp", "component_id"))
    rest = prints.join(hot.select("fp"), "fp", "left_anti").join(of_print.select("fp", "component_id"), "fp")
    return prints.join(hot, "fp").unionByName(rest).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id.

    All columns of ``df`` are kept.  Groups are of rows, not of ids: rows that
    share an id, or have none, are told apart by a number of their own, so two
    texts under one id both stay if they are no near-duplicates, and of equal rows
    one stays.  Of rows with the smallest id of a group the one with the least hash
    of its text counts; null ids come last.  An empty table gives an empty result.

    Which rows stay is decided on numbers and fingerprints; the texts are shuffled
    once, by the number of the row, which no two rows share.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            prints = [fingerprint_of(t.as_py(), width, seed) for t in texts]
            yield batch.append_column("__fp", pa.array(prints, pa.int64()))

    printed = df.mapInArrow(run, StructType([*df.schema.fields, StructField("__fp", LongType())]))
    rows = materialize(printed.withColumn("__row", F.monotonically_increasing_id()), "near-dedup")
    groups = link_fingerprints(rows.select(F.col("__fp").alias("fp")))
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text"), F.col("__row").alias("row"))
    # the least row of each fingerprint first, so that copies do not meet in one task
    least = rows.select(F.col("__fp").alias("fp"), order.alias("at")).groupBy("fp").agg(F.min("at").alias("at"))
    kept = least.join(groups, "fp").groupBy("component").agg(F.min("at").alias("at")).select(F.col("at.row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])

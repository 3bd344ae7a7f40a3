"""Cutting documents into chunks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def fixed_chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Windows of ``size`` characters that share ``overlap``; empty texts give none."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text_col) - overlap) / step) - 1).cast("int")
    rows = df.where(F.length(text_col) > 0).select(F.col(id_col), F.col(text_col), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return rows.select(
        id_col,
        F.col("i").cast("long").alias("chunk_index"),
        F.concat(F.col(id_col), F.lit("_chunk_"), F.col("i")).alias("chunk_id"),
        F.substring(F.col(text_col), F.col("i") * step + 1, F.lit(size)).alias("text"),
    )


def with_metadata(chunks: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chunks with what is known of their documents, as they are indexed; names of the chunks go before those of the documents."""
    return chunks.join(docs.drop(*[c for c in chunks.columns if c != id_col]), id_col)


def pack_units(units: Column, size: int) -> Column:
    """Greedy chunks of whole units: an array of joined texts of at most ``size`` characters where units allow it."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, unit: Column) -> Column:
        fits = (F.length(acc["open"]) + F.length(unit)) <= size
        return F.when(fits | (acc["open"] == ""), F.struct(acc["done"].alias("done"), F.concat(acc["open"], unit).alias("open"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), unit.alias("open"))
        )

    return F.aggregate(units, start, step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["open"])), lambda c: c != ""))


def _units(text: Column, size: int, separators: tuple[str, ...]) -> Column:
    """Split at the coarsest separator; only units that are still too long are split again, at last by length."""
    if not separators:
        count = F.ceil(F.length(text) / size).cast("int")
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), count)), lambda i: F.substring(text, (i - 1) * size + 1, F.lit(size)))
    parts = F.split(text, f"(?<={separators[0]})")
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(_units(p, size, separators[1:]))))


#: Coarsest first, as regular expressions.
SEPARATORS = ("\n\n", "\n", r"\. ", " ")


def _shared(overlap: int) -> Column:
    """What the chunk at ``position`` repeats of the one before in ``__parts``."""
    before = F.when(F.col("position") > 0, F.element_at("__parts", F.greatest(F.col("position"), F.lit(1)))).otherwise("")
    tail = F.regexp_replace(F.substring(before, -overlap, overlap), r"^\S*\s?", "")
    return F.when(F.length(before) <= overlap, before).otherwise(tail)


def recursive_chunks(df: DataFrame, id_cols: list[str], text_col: str = "text", size: int = 2048, separators: tuple[str, ...] = SEPARATORS, overlap: int = 0) -> DataFrame:
    """Chunks of whole paragraphs, lines, sentences or words, as large as ``size`` allows.

    Every chunk but the first begins with at most the last ``overlap`` characters of
    the one before, from a word on.  Without that, joined in order, they give the
    text again.  Adds ``position``, ``chunk`` and ``shared``, the characters that it
    has from the one before.
    """
    packed = pack_units(_units(F.col(text_col), size - overlap, separators), size - overlap)
    cut = df.where(F.length(text_col) > 0).select(*id_cols, packed.alias("__parts"))
    if not overlap:
        # outer explodes here: a plain one has a filter on its array inferred, which is pushed down and packs the text again
        return cut.select(*id_cols, F.posexplode_outer("__parts").alias("position", "chunk")).where("chunk is not null").withColumn("shared", F.lit(0))
    rows = cut.select(*id_cols, "__parts", F.posexplode_outer("__parts").alias("position", "__own")).where("__own is not null")
    return rows.withColumn("__shared", _shared(overlap)).select(*id_cols, "position", F.concat("__shared", "__own").alias("chunk"), F.length("__shared").alias("shared"))


def level_chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, ...] = (2048, 1024, 512), overlap: int = 0) -> DataFrame:
    """``id, chunk_id, parent_id, level, text`` of every level; a chunk is cut from its parent on the level above.

    A chunk's id is its parent's and its number there: ``{doc}_0_2_1``.
    """
    level = df.select(F.col(id_col), F.col(id_col).cast("string").alias("parent_id"), F.col(text_col).alias("text"))
    out = []
    for k, size in enumerate(sizes):
        cut = recursive_chunks(level, [id_col, "parent_id"], "text", size, overlap=overlap)
        level = cut.select(id_col, F.concat("parent_id", F.lit("_"), "position").alias("chunk_id"), F.when(F.lit(k > 0), F.col("parent_id")).alias("parent_id"), F.lit(k).alias("level"), F.col("chunk").alias("text"))
        out.append(level)
        level = level.select(id_col, F.col("chunk_id").alias("parent_id"), "text")
    return reduce(DataFrame.unionByName, out)


def routed_chunks(docs: DataFrame, sections: DataFrame, sizes: dict[str, int], id_col: str = "doc_id") -> DataFrame:
    """``id, chunk_id, text``: chunks of sections for documents of the method ``section_aware`` that have some, of two levels for the others."""
    own = sections.select(id_col).distinct()
    aware = F.coalesce(F.col("method") == "section_aware", F.lit(False))
    by_section = docs.where(aware).join(own, id_col, "left_semi")
    plain = docs.where(~aware).unionByName(docs.where(aware).join(own, id_col, "left_anti"))
    cut = section_chunks(sections.join(by_section.select(id_col), id_col, "left_semi"), sizes, id_col=id_col)
    named = cut.select(id_col, F.concat(id_col, F.lit("_section_"), "chunk_index").alias("chunk_id"), "text")
    return named.unionByName(hierarchical_chunks(plain, id_col).select(id_col, "chunk_id", "text"))


def hierarchical_chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parent_size: int = 2048, child_size: int = 1024, min_parent: int = 100, min_child: int = 50, parent_overlap: int = 0, child_overlap: int = 0) -> DataFrame:
    """Parents and their children in one table; child numbers run over the document."""
    parents = recursive_chunks(df, [id_col], text_col, parent_size, overlap=parent_overlap).where(F.length(F.trim("chunk")) >= min_parent)
    parents = parents.select(id_col, F.col("position").cast("long").alias("parent_no"), F.col("chunk").alias("text"))
    parent_id = F.concat(F.col(id_col), F.lit("_parent_"), F.col("parent_no"))
    children = recursive_chunks(parents, [id_col, "parent_no"], "text", child_size, overlap=child_overlap).where(F.length(F.trim("chunk")) >= min_child)
    of_doc = Window.partitionBy(id_col).orderBy("parent_no", "position")
    number = (F.row_number().over(of_doc) - 1).cast("long")
    children = children.withColumn("number", number).select(
        id_col,
        F.concat(F.col(id_col), F.lit("_child_"), F.col("number")).alias("chunk_id"),
        parent_id.alias("parent_id"),
        F.lit("child").alias("chunk_type"),
        F.col("position").cast("long").alias("child_position"),
        F.col("chunk").alias("text"),
    )
    tops = parents.select(id_col, parent_id.alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("parent").alias("chunk_type"), F.lit(None).cast("long").alias("child_position"), "text")
    return tops.unionByName(children)


def fingerprint(text: Column, size: int = 100) -> Column:
    """The first characters of the text, lower-cased and with single spaces."""
    return F.substring(F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " ")), 1, size)


def _settle(owners: int):
    """A function over Arrow batches sorted by their first ``owners`` columns and then by place: the rows that stay, without parent and print."""

    def run(batches):
        now, prints, kept = None, set(), set()
        for batch in batches:
            *owner, _, name, parent, mark = (c.to_pylist() for c in batch.columns)
            stays = np.zeros(batch.num_rows, dtype=bool)
            for i, own in enumerate(zip(*owner, strict=True)):
                if own != now:
                    now, prints, kept = own, set(), set()
                if mark[i] not in prints and (parent[i] is None or parent[i] in kept):
                    prints.add(mark[i])
                    kept.add(name[i])
                    stays[i] = True
            yield batch.filter(pa.array(stays)).select(list(range(owners + 1)))

    return run


def settle_hierarchy(chunks: DataFrame, by: list[str]) -> DataFrame:
    """The chunks that stay, of ``by, chunk, parent, place, print``: those whose print no earlier one that stays has.

    ``place`` is the reading order within ``by``, ``parent`` the chunk before it that
    one belongs to, or null.  A chunk whose parent goes or is not there goes without
    a word: later ones may have its print.  So each hangs on all before it, and they
    are settled as they are read: rows are shuffled once by ``by``, sorted, and
    passed one after the other, with the prints and names of what stays of one
    ``by`` in memory.  Rows with a null in ``by`` or ``print`` give none.
    """
    name = F.to_json if isinstance(chunks.schema["chunk"].dataType, StructType) else F.col  # a value that Python can look up
    sound = reduce(Column.__and__, (F.col(c).isNotNull() for c in [*by, "print"]))
    dealt = chunks.where(sound).repartition(*by).sortWithinPartitions(*by, "place")
    rows = dealt.select(*by, "chunk", name("chunk").alias("__name"), name("parent").alias("__parent"), "print")
    return rows.mapInArrow(_settle(len(by)), rows.select(*by, "chunk").schema)


def hierarchy_dedupe(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """:func:`hierarchical_chunks` without chunks whose fingerprint the document has before, in reading order.

    Parents and children share one set of fingerprints, and a dropped parent takes
    its children along (see :func:`settle_hierarchy`).  The children that stay are
    numbered anew.
    """
    number = F.regexp_extract(F.coalesce("parent_id", "chunk_id"), r"(\d+)$", 1).cast("long")
    place = F.struct(number.alias("parent"), F.coalesce("child_position", F.lit(-1)).cast("long").alias("child"))
    rows = chunks.select(id_col, F.col("chunk_id").alias("chunk"), F.col("parent_id").alias("parent"), place.alias("place"), F.xxhash64(fingerprint(F.col("text"))).alias("print"))
    left = settle_hierarchy(rows, [id_col]).withColumnRenamed("chunk", "chunk_id")
    stay = chunks.join(left, [id_col, "chunk_id"], "left_semi").withColumn("__parent", number)
    child = F.col("parent_id").isNotNull()
    nth = F.row_number().over(Window.partitionBy(id_col, child).orderBy("__parent", "child_position")) - 1
    return stay.withColumn("chunk_id", F.when(child, F.concat(id_col, F.lit("_child_"), nth)).otherwise(F.col("chunk_id"))).select(*chunks.columns)


def fingerprint_dedupe(chunks: DataFrame, by: list[str], order: list[str], text_col: str = "text") -> DataFrame:
    """The first chunk, in ``order``, of each fingerprint within ``by``."""
    first = Window.partitionBy(*by, "__print").orderBy(*order)
    return chunks.withColumn("__print", fingerprint(F.col(text_col))).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__print")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def split_oversize(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", max_tokens: int = 7500, size: int = 30000) -> DataFrame:
    """Chunks over the token limit in overlapping parts ``{id}_part_{i}``; others as they are."""
    large = token_estimate(F.col(text_col)) > max_tokens
    parts = fixed_chunks(chunks.where(large), id_col, text_col, size, min(200, size // 10))
    small = chunks.where(~large | F.col(text_col).isNull()).select(F.col(id_col).cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("parent_chunk_id"), F.col(text_col).alias("text"))
    cut = parts.select(F.concat(F.col(id_col), F.lit("_part_"), F.col("chunk_index")).alias("chunk_id"), F.col(id_col).cast("string").alias("parent_chunk_id"), "text") if id_col != "chunk_id" else None
    if cut is None:
        renamed = chunks.withColumnRenamed("chunk_id", "__base")
        parts = fixed_chunks(renamed.where(large), "__base", text_col, size, min(200, size // 10))
        cut = parts.select(F.concat(F.col("__base"), F.lit("_part_"), F.col("chunk_index")).alias("chunk_id"), F.col("__base").cast("string").alias("parent_chunk_id"), "text")
    return small.unionByName(cut)


def section_chunks(sections: DataFrame, sizes: dict[str, int], default: int = 1000, id_col: str = "doc_id", text_col: str = "content", overlap: int = 0) -> DataFrame:
    """Chunks of ``id, section_no, section_type, content``, of a size by section type; numbers run over the document.

    A section's chunks, without their first ``shared`` characters, give it again when
    joined in order.  Empty and null sections give none.  Where sections have
    ``page_start`` and ``page_end``, chunks have ``page_range``, as ``2-5``.
    """
    known = F.create_map(*[F.lit(x) for item in sizes.items() for x in item]) if sizes else F.lit(None).cast("map<string,int>")
    size = F.coalesce(F.try_element_at(known, F.col("section_type")), F.lit(default))
    cut = sections.where(F.length(text_col) > 0).withColumn("__size", size)
    packed = pack_units(_units(F.col(text_col), F.col("__size") - overlap, SEPARATORS), F.col("__size") - overlap)
    own = [id_col, "section_no", "section_type"]
    if {"page_start", "page_end"} <= set(sections.columns):
        cut, own = cut.withColumn("page_range", F.concat_ws("-", F.col("page_start").cast("string"), F.col("page_end").cast("string"))), [*own, "page_range"]
    rows = cut.select(*own, packed.alias("__parts"))
    rows = rows.select(*own, "__parts", F.posexplode_outer("__parts").alias("position", "text")).where("text is not null")
    rows = rows.withColumn("__shared", _shared(overlap) if overlap else F.lit("")).drop("__parts")
    rows = rows.select(*own, "position", F.concat("__shared", "text").alias("text"), F.length("__shared").alias("shared"))
    number = (F.row_number().over(Window.partitionBy(id_col).orderBy("section_no", "position")) - 1).cast("long")
    return rows.withColumn("chunk_index", number).drop("position")

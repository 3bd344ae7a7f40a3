"""Contexts, citations and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ranking import distributed_rank


def author_list(names: Column, most: int = 3) -> Column:
    shown = F.array_join(F.slice(names, 1, most), ", ")
    return F.when(F.size(names) > most, F.concat(shown, F.lit(" et al."))).otherwise(shown)


def context_blocks(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """``by, context``: the hits of each query in order, separated by rules."""
    block = F.concat(
        F.lit("["), author_list(F.col("authors")), F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit("). "), F.col("title"),
        F.lit("]\nPhase: "), F.col("phase"), F.lit(" | Topic: "), F.col("topic"), F.lit("\n"), F.col("text"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n---\n\n").alias("context"))


def numbered(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """``by, guide``: ``[i] = authors (year). title`` in order."""
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] = "), author_list(F.col("authors")), F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit("). "), F.col("title"))
    ordered = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("guide"))


def bibliography(docs: DataFrame) -> DataFrame:
    """Different entries, with a DOI link where there is one; the first document of each."""
    entry = F.concat(author_list(F.col("authors")), F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit("). "), F.col("title"), F.coalesce(F.concat(F.lit(". https://doi.org/"), F.col("doi")), F.lit("")))
    return docs.groupBy(entry.alias("entry")).agg(F.min("doc_id").alias("doc_id"))


def markdown_by_group(docs: DataFrame, group: str) -> DataFrame:
    """``group, position, line``: entries numbered in each group by author; a null group or author is ``Unknown``."""
    unknown = lambda c: F.coalesce(c, F.lit("Unknown")).alias(c)
    rows = docs.select(unknown(group), unknown("author"), "doc_id", "title")
    ranked = distributed_rank(rows, [group], F.struct("author", F.floor(F.col("doc_id") / 10_000)), ["author", "doc_id"])
    return ranked.select(group, (F.col("rank") + 1).alias("position"), "author", "title").withColumn("line", F.concat(F.col("position"), F.lit(". **"), F.col("author"), F.lit("** "), F.col("title"))).drop("author", "title")


def chat_markdown(turns: DataFrame) -> DataFrame:
    """``conv_id, markdown``: each conversation's turns in order under their roles."""
    block = F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), F.col("text"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", block.alias("block"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("markdown"))


def result_rows(hits: DataFrame, columns: list[str], text: str = "text", most: int = 500) -> DataFrame:
    """What a search shows: the columns asked for, the score to four places, and the start of the text."""
    return hits.select("query_id", "rank", *columns, F.round("score", 4).alias("score"), F.substring(F.coalesce(text, F.lit("")), 1, most).alias("content"))


def citation_table(docs: DataFrame) -> DataFrame:
    """The nine columns of the citation export, as text; a missing one is empty."""
    authors = author_list(F.col("authors"))
    apa = F.concat(authors, F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit("). "), F.col("title"))
    shown = {"Author": authors, "Year": F.col("year"), "Title": F.col("title"), "Source_Type": F.col("source_type"), "Journal": F.col("journal"), "Pages": F.col("total_pages"), "Phase": F.col("phase"), "Filename": F.col("filename"), "APA_Citation": apa}
    return docs.select("doc_id", *[F.coalesce(c.cast("string"), F.lit("")).alias(name) for name, c in shown.items()])


def page_map(pages: DataFrame, preview: int = 200) -> DataFrame:
    """``doc_id, page_map``: a JSON object from page number to words and the start of each page ``page_no, text``."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    entry = F.struct("page_no", F.struct(words.alias("word_count"), F.substring("text", 1, preview).alias("preview")).alias("page"))
    ordered = F.transform(F.sort_array(F.collect_list(entry)), lambda x: F.struct(x["page_no"].cast("string"), x["page"]))
    return pages.groupBy("doc_id").agg(F.to_json(F.map_from_entries(ordered)).alias("page_map"))


def chat_with_references(turns: DataFrame, citations: DataFrame) -> DataFrame:
    """:func:`chat_markdown` and, where a chat cites sources, a numbered list of them.

    ``citations`` has ``conv_id, turn, entry``; an entry counts once a chat, at its first turn.
    """
    first = citations.groupBy("conv_id", "entry").agg(F.min("turn").alias("turn"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "entry")))
    lines = F.transform(ordered, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["entry"]))
    listed = first.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("listed"))
    whole = F.concat(F.col("markdown"), F.coalesce(F.concat(F.lit("\n\n## References\n\n"), F.col("listed")), F.lit("")))
    return chat_markdown(turns).join(listed, "conv_id", "left").select("conv_id", whole.alias("markdown"))

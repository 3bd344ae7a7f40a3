"""Exact token statistics from a histogram of encoded lengths."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.tokens import default_path, encoder
from corpusloom.session import materialize

#: Lengths whose running sums one task adds up.
SPAN = 1024


def token_lengths(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(id, n_tokens)`` of every whole text; 0 for a null or empty one."""
    path = path or default_path()

    def run(batches):
        for batch in batches:
            sizes = [len(raw) // 4 for raw in encoder(path).encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["id", "n_tokens"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_tokens long")


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """``(length, n_docs)`` for every length that occurs."""
    return lengths.groupBy(F.col(length_col).alias("length")).agg(F.count("*").alias("n_docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """What every context limit keeps, from suffix sums over the histogram.

    One row per length that occurs, read as a limit: ``context_limit``, ``n_docs``
    of this length, ``docs_longer``, ``quantile`` (share of documents that fit),
    ``total_tokens``, ``tokens_longer`` (in documents that do not fit) and
    ``truncated_tokens`` (all documents cut to the limit).  Between two rows the
    truncated total is linear, so the table answers every limit.
    """
    spans = histogram.withColumn("span", F.floor(F.col("length") / SPAN)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    later = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    of_span = spans.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # one row per 1024 lengths
    tails = of_span.select("span", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("tail_docs"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tail_tokens"))
    totals = of_span.agg(F.sum("d").alias("all_docs"), F.sum("t").alias("total_tokens"))
    longer = Window.partitionBy("span").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        spans.join(F.broadcast(tails), "span")
        .withColumn("docs_longer", F.col("tail_docs") + F.coalesce(F.sum("n_docs").over(longer), F.lit(0)))
        .withColumn("tokens_longer", F.col("tail_tokens") + F.coalesce(F.sum("tokens").over(longer), F.lit(0)))
        .join(F.broadcast(totals))  # one row
        .select(
            F.col("length").alias("context_limit"),
            "n_docs",
            "docs_longer",
            (1 - F.col("docs_longer") / F.col("all_docs")).alias("quantile"),
            "total_tokens",
            "tokens_longer",
            (F.col("total_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("length")).alias("truncated_tokens"),
        )
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """One row per limit of the caller's list: the tokens left if all documents are cut to it."""
    sums = [F.sum(F.least("length", F.lit(int(n))) * F.col("n_docs")).alias(f"l{k}") for k, n in enumerate(limits)]
    pairs = [F.struct(F.lit(int(n)).cast("long").alias("context_limit"), F.coalesce(f"l{k}", F.lit(0)).alias("truncated_tokens")) for k, n in enumerate(limits)]
    return histogram.agg(*sums).select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """:func:`context_table` of every whole text of ``df``.

    Null and empty texts have length 0; repeated rows count each time; an empty
    table gives an empty result; further columns are ignored.
    """
    return context_table(materialize(length_histogram(token_lengths(df, id_col, text_col, path)), "lengths"))

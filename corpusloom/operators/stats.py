"""Corpus statistics, usage, and retrieval measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P


def corpus_stats(chunks: DataFrame, doc: str = "doc_id", year: str = "year") -> DataFrame:
    """One row: chunks, documents, and the range of plausible years (0 if none)."""
    plausible = F.when(F.col(year) > 1900, F.col(year))
    return chunks.agg(
        F.count("*").alias("n_chunks"),
        F.count_distinct(doc).alias("n_docs"),
        F.coalesce(F.min(plausible), F.lit(0)).cast("long").alias("year_min"),
        F.coalesce(F.max(plausible), F.lit(0)).cast("long").alias("year_max"),
    )


def docs_by(chunks: DataFrame, col: str, doc: str = "doc_id") -> DataFrame:
    return chunks.groupBy(F.coalesce(col, F.lit("Unknown")).alias(col)).agg(F.count_distinct(doc).alias("n_docs"))


def unique_documents(chunks: DataFrame, order: list[str], doc: str = "doc_id") -> DataFrame:
    """The first chunk of every document."""
    first = Window.partitionBy(doc).orderBy(*order)
    return chunks.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def coverage_gaps(docs: DataFrame, by: str, wanted: int) -> DataFrame:
    counts = docs.groupBy(by).agg(F.count("*").alias("current"))
    return counts.where(F.col("current") < wanted).select(by, "current", F.lit(wanted).cast("long").alias("recommended"), (wanted - F.col("current")).alias("gap"))


def topic_stats(docs: DataFrame, by: str, year: str = "year") -> DataFrame:
    return docs.groupBy(by).agg(F.count("*").alias("n_docs"), F.round(F.avg(year), 6).alias("avg_year"), F.min(year).alias("year_min"), F.max(year).alias("year_max"))


def usage_report(items: DataFrame, plans: DataFrame, calls: DataFrame, owner: str = "owner", size: str = "size", base: str = "kb_id") -> DataFrame:
    """Per owner: bases, documents, bytes and calls, and against the plan: percent used (null if unlimited) and whether one more fits.

    ``calls`` has ``owner`` and ``n_calls`` of the day; ``plans`` has a limit (null: none) for each, by ``tier``.
    """
    kinds = ("bases", "docs", "bytes", "calls")
    used = items.groupBy(owner, "tier").agg(F.count_distinct(base).alias("n_bases"), F.count("*").alias("n_docs"), F.sum(size).cast("long").alias("n_bytes"))
    used = used.join(calls, owner, "left").withColumn("n_calls", F.coalesce("n_calls", F.lit(0)))
    share = lambda k: F.round(100 * F.col(f"n_{k}") / F.col(f"max_{k}"), 6).alias(f"{k}_percent")
    fits = lambda k, name: (F.col(f"max_{k}").isNull() | (F.col(f"n_{k}") < F.col(f"max_{k}"))).alias(name)
    counts = [f"n_{k}" for k in kinds]
    return used.join(plans, "tier", "left").select(owner, "tier", *counts, *map(share, kinds), fits("bases", "may_add_base"), fits("docs", "may_add"), fits("calls", "may_call"))


def retrieval_metrics(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per query with a truth: hits, precision (of the k asked for) and recall."""
    expected = truth.select("query_id", "chunk_id").distinct()
    found = hits.where(F.col("rank") <= k).select("query_id", "chunk_id").distinct().join(expected, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.count("*").alias("found"))
    per = expected.groupBy("query_id").agg(F.count("*").alias("expected")).join(found, "query_id", "left")
    got = F.coalesce("found", F.lit(0))
    return per.select("query_id", "expected", got.alias("found"), F.round(got / k, 6).alias("precision"), F.round(got / F.col("expected"), 6).alias("recall"))


def latency_summary(df: DataFrame, by: str, value: str, bins: int = 1024) -> DataFrame:
    """Mean, median, sample deviation, range, and the 95th percentile where there are 20 values.

    The order statistics are exact: values are counted, counts are summed up over
    ``bins`` equal ranges of each group, and only then inside a range.
    """
    summary = df.groupBy(by).agg(
        F.count(value).alias("n"),
        F.round(F.avg(value), 6).alias("mean"),
        F.round(F.stddev_samp(value), 6).alias("stdev"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
    )
    v, width = F.col(value), F.col("most") - F.col("least")
    counts = df.where(v.isNotNull()).groupBy(by, value).agg(F.count("*").alias("__n")).join(summary.select(by, "n", "least", "most"), by)
    counts = counts.withColumn("__bin", F.when(width > 0, F.floor((v - F.col("least")) / width * (bins - 1))).otherwise(0))
    ahead = Window.partitionBy(by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.groupBy(by, "__bin").agg(F.sum("__n").alias("__m")).select(by, "__bin", F.coalesce(F.sum("__m").over(ahead), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(by, "__bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.join(starts, [by, "__bin"]).withColumn("__to", F.col("__start") + F.sum("__n").over(inside))
    at = lambda place: F.max(F.when((F.col("__to") > place) & (F.col("__to") - F.col("__n") <= place), v))
    n = F.col("n")
    found = placed.groupBy(by).agg(
        F.round((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2, 6).alias("median"),
        F.round(at(F.when(n >= 20, F.floor(0.95 * n))), 6).alias("p95"),
    )
    return summary.join(found, by, "left").select(by, "n", "mean", "median", "stdev", "least", "most", "p95")


def order_statistic(df: DataFrame, by: list[str], value: str, place: Column, bins: int = 1024) -> DataFrame:
    """``by, value``: the value at ``place`` (from 0; an expression of ``n``, the values of the group) in ascending order.

    Exact: values are counted, counts are summed up over ``bins`` equal ranges of each
    group, and only then inside the range that has the place.  Nulls do not count.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("__by", F.struct(*by))
    summary = rows.groupBy("__by").agg(F.count("*").alias("n"), F.min(value).alias("__least"), F.max(value).alias("__most"))
    counts = rows.groupBy("__by", F.col(value).alias("value")).agg(F.count("*").alias("__n")).join(summary, "__by")
    width = F.col("__most") - F.col("__least")
    counts = counts.withColumn("__bin", F.when(width > 0, F.floor((F.col("value") - F.col("__least")) / width * (bins - 1))).otherwise(0))
    ahead = Window.partitionBy("__by").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.groupBy("__by", "__bin").agg(F.sum("__n").alias("__m"), F.first("n").alias("n")).withColumn("__start", F.coalesce(F.sum("__m").over(ahead), F.lit(0)))
    asked = starts.where((F.col("__start") <= place) & (F.col("__start") + F.col("__m") > place)).select("__by", "__bin", "__start")
    inside = Window.partitionBy("__by").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.join(asked, ["__by", "__bin"]).withColumn("__to", F.col("__start") + F.sum("__n").over(inside))
    return placed.where((F.col("__to") > place) & (F.col("__to") - F.col("__n") <= place)).select("__by.*", "value")


def _plain_words(text: Column, apart: str) -> Column:
    """Words in lower case with only their letters and digits; the characters ``apart`` part words as spaces do."""
    parts = F.split(F.translate(text, apart, " " * len(apart)), r"\s+")
    return F.transform(parts, lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))


def picked_keywords(text: Column, n: int, stop: list[str]) -> Column:
    """The first n different words of four or more letters or digits that are no stop words; none of a null."""
    words = F.filter(_plain_words(F.coalesce(text, F.lit("")), "-/"), lambda w: (F.length(w) >= 4) & ~w.isin(stop))
    return F.slice(F.array_distinct(words), 1, n)


def topic_tokens(topic: Column, stop: list[str]) -> Column:
    """The words of a topic's name, of four or more letters or digits and no stop words."""
    return F.filter(_plain_words(F.coalesce(topic, F.lit("")), "_"), lambda w: (F.length(w) >= 4) & ~w.isin(stop))


def eval_set(docs: DataFrame, n: int = 20, m: int = 3, stop: list[str] = P.EVAL_STOPS) -> DataFrame:
    """Test queries from the largest (topic, phase) groups: expected ids, words of the topic and keywords.

    The keywords are four of the first document's abstract or, where it has none, three
    of its title; those that the topic's name has too are preferred.
    """
    first_of = lambda c: F.min_by(c, "doc_id").alias(c)
    size = docs.groupBy("topic", "phase").agg(F.count("*").alias("n_docs"), first_of("title"), first_of("abstract"))
    first = docs.withColumn("r", F.row_number().over(Window.partitionBy("topic", "phase").orderBy("doc_id"))).where(F.col("r") <= m)
    expected = first.groupBy("topic", "phase").agg(F.sort_array(F.collect_list("doc_id")).alias("expected"))
    top = size.orderBy(F.desc("n_docs"), "topic", "phase").limit(n).join(expected, ["topic", "phase"])
    top = top.withColumns({"__a": picked_keywords(F.col("abstract"), 4, stop), "__t": picked_keywords(F.col("title"), 3, stop), "__w": topic_tokens(F.col("topic"), stop)})
    top = top.withColumn("__k", F.when(F.size("__a") > 0, F.col("__a")).otherwise(F.col("__t")))
    shared = F.filter("__k", lambda w: F.array_contains("__w", w))
    words = F.when(F.size("__w") > 0, F.slice("__w", 1, 3)).otherwise(F.array(F.translate("topic", "_", " ")))
    query = F.trim(F.array_join(F.concat(words, F.when(F.size(shared) > 0, shared).otherwise(F.col("__k"))), " "))
    return top.select("topic", "phase", "n_docs", F.array_join("expected", ",").alias("expected"), query.alias("query"))


def citation_correctness(cited: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query: citations, the different correct ones, and their share (null without a truth or a citation)."""
    expected = truth.select("query_id", "chunk_id").distinct()
    correct = cited.select("query_id", "chunk_id").distinct().join(expected, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.count("*").alias("c"))
    known = expected.select("query_id").distinct().withColumn("known", F.lit(True))
    rows = cited.groupBy("query_id").agg(F.count("*").alias("citations")).join(correct, "query_id", "left").join(known, "query_id", "left")
    got = F.when(F.col("known"), F.coalesce("c", F.lit(0)))
    return rows.select("query_id", "citations", got.alias("correct"), F.round(got / F.col("citations"), 4).alias("correctness"))


def overhead(df: DataFrame, by: str, arm: Column, value: str) -> DataFrame:
    """Per group: the mean with and without a feature, their difference, and that in percent."""
    means = df.groupBy(by).agg(F.avg(F.when(arm, F.col(value))).alias("a"), F.avg(F.when(~arm, F.col(value))).alias("b"))
    r = lambda c: F.round(c, 6)
    gap = F.col("a") - F.col("b")
    return means.select(by, r(F.col("a")).alias("with_feature"), r(F.col("b")).alias("without"), r(gap).alias("difference"), r(100 * gap / F.nullif("b", F.lit(0.0))).alias("percent"))


def distribution(docs: DataFrame, by: str, value: str) -> DataFrame:
    """``by, value, n``: how often each value occurs in each group."""
    return docs.groupBy(by, value).agg(F.count("*").alias("n"))


def counts_by(chunks: DataFrame, col: str) -> DataFrame:
    """``col, n_chunks``: how many chunks, not documents, each value has; a missing one is ``Unknown``."""
    return chunks.groupBy(F.coalesce(col, F.lit("Unknown")).alias(col)).agg(F.count("*").alias("n_chunks"))


def total_of(bases: DataFrame, *columns: str) -> DataFrame:
    """One row: the sums of these counters over all knowledge bases; 0 if there is none."""
    return bases.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns])


def document_metadata(chunks: DataFrame, columns: list[str], order: str = "chunk_index", doc: str = "doc_id") -> DataFrame:
    """The metadata of every document, as its first chunk has them."""
    return chunks.groupBy(doc).agg(F.min_by(F.struct(*columns), order).alias("__m")).select(doc, "__m.*")


def available(docs: DataFrame, col: str) -> DataFrame:
    """The different values of a column, without the missing one."""
    return docs.select(col).where(F.col(col).isNotNull()).distinct()


def metrics_summary(per_query: DataFrame, queries: DataFrame) -> DataFrame:
    """One row over :func:`retrieval_metrics`: queries, those with a truth, macro precision and micro recall."""
    asked = queries.select("query_id").distinct().join(per_query, "query_id", "left")
    return asked.agg(
        F.count("*").alias("queries"),
        F.count("expected").alias("labelled"),
        F.round(F.coalesce(F.avg("precision"), F.lit(0.0)), 6).alias("macro_precision"),
        F.round(F.coalesce(F.sum("found") / F.nullif(F.sum("expected"), F.lit(0)), F.lit(0.0)), 6).alias("micro_recall"),
    )


def focus_statistics(docs: DataFrame, by: str, focus: str) -> DataFrame:
    """``by, focus, n_docs``: documents of each group for every entry of the array ``focus``."""
    return docs.select(by, "doc_id", F.explode(F.array_distinct(focus)).alias(focus)).groupBy(by, focus).agg(F.count_distinct("doc_id").alias("n_docs"))


def type_statistics(docs: DataFrame, by: str, kind: Column) -> DataFrame:
    """``by, research_type, n_docs, n_of_all``: documents of each group by type, and of the group."""
    counted = docs.select(by, "doc_id", kind.alias("research_type")).groupBy(by, "research_type").agg(F.count_distinct("doc_id").alias("n_docs"))
    return counted.join(docs.groupBy(by).agg(F.count_distinct("doc_id").alias("n_of_all")), by)


def kb_counters(chunks: DataFrame, by: str = "kb_id") -> DataFrame:
    """Every base with its documents, chunks and years, of ``by, doc_id, year`` of each chunk; counted, never kept."""
    return chunks.groupBy(by).agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_chunks"), F.min("year").alias("year_min"), F.max("year").alias("year_max"))


def page_and_word_totals(docs: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    """``by, pages, words``: pages and words (what stands between white space) of each group."""
    words = F.size(F.filter(F.split(text_col, r"\s+"), lambda w: w != ""))
    return docs.groupBy(*by).agg(F.sum("total_pages").alias("pages"), F.sum(words).cast("long").alias("words"))

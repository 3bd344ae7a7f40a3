"""Entities, claims, evidence, and checks of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.operators.components import connected_components
from corpusloom.operators.ranking import distributed_rank
from corpusloom.operators.text import phrases
from corpusloom.session import materialize


def entity_mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, paragraph, name``: the capitalised phrases of each line, all of them."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    return lines.select(id_col, (F.col("pos") + 1).cast("long").alias("paragraph"), F.explode(phrases(F.col("line"))).alias("name"))


def upsert_entities(mentions: DataFrame, order: list[str]) -> DataFrame:
    """One row per name: how often, in how many documents, and where first."""
    place = F.struct(*order)
    return mentions.groupBy("name").agg(F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("n_docs"), F.min_by("doc_id", place).alias("first_doc"))


def cooccurrence_edges(mentions: DataFrame, id_col: str = "doc_id", part: int = 256) -> DataFrame:
    """``source, target, weight``: names that share a paragraph, without a limit.

    Of a paragraph with more than ``part`` names, the pairs are made in several tasks: about ``part`` sources
    each, with all of the names.
    """
    here = mentions.select(id_col, "paragraph", "name").distinct()
    parts = F.ceil(F.count("*").over(Window.partitionBy(id_col, "paragraph")) / part).cast("int")
    here = here.withColumn("parts", parts)
    a = here.withColumn("part", F.pmod(F.xxhash64("name"), "parts").cast("int")).alias("a")
    b = here.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    same = (F.col(f"a.{id_col}") == F.col(f"b.{id_col}")) & (F.col("a.paragraph") == F.col("b.paragraph")) & (F.col("a.part") == F.col("b.part"))
    met = a.join(b, same & (F.col("a.name") < F.col("b.name")))
    return met.groupBy(F.col("a.name").alias("source"), F.col("b.name").alias("target")).agg(F.count("*").alias("weight"))


def clusters(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``node, component, cluster``: components numbered in the order of their least member.

    Nodes are integers or strings.
    """
    found = connected_components(edges, src, dst)
    parts = found.select("component").distinct()
    if parts.schema["component"].dataType.typeName() == "string":
        bucket = F.substring("component", 1, 2)
    else:
        least, most = parts.agg(F.min("component"), F.max("component")).first()
        bucket = F.floor((F.col("component") - (least or 0)) / (((most or 0) - (least or 0)) // 1024 + 1)).cast("long")
    numbered = distributed_rank(parts, [], bucket, ["component"])
    names = numbered.select("component", F.concat(F.lit("cluster_"), F.col("rank") + 1).alias("cluster"))
    return found.join(names, "component").select("node", "component", "cluster")


def cluster_table(clustered: DataFrame, most: int = 6) -> DataFrame:
    """``component, cluster, n_nodes, covers``: the first nodes of each component name it."""
    first = clustered.withColumn("n", F.row_number().over(Window.partitionBy("component").orderBy("node"))).where(F.col("n") <= most)
    members = F.transform(F.sort_array(F.collect_list("node")), lambda n: n.cast("string"))
    named = first.groupBy("component").agg(F.array_join(members, ", ").alias("covers"))
    return clustered.groupBy("component", "cluster").agg(F.count("*").alias("n_nodes")).join(named, "component")


def majority_cluster(docs: DataFrame) -> DataFrame:
    """``doc_id, component``: the commonest component of each document, the least of equals."""
    counts = docs.groupBy("doc_id", "component").agg(F.count("*").alias("n"))
    first = Window.partitionBy("doc_id").orderBy(F.desc("n"), "component")
    return counts.withColumn("r", F.row_number().over(first)).where("r = 1").select("doc_id", "component")


def evidence_gaps(hits: DataFrame, claim: str = "query_id", weak: float = 0.35, missing: float = 0.25, wanted: int = 2) -> DataFrame:
    """Per claim, from its nearest chunks: best score, chunks of evidence, and the kind of gap."""
    score = 1 - F.col("distance")
    stats = hits.groupBy(claim).agg(F.greatest(F.lit(0.0), F.round(F.max(score), 6)).alias("best_score"), F.count(F.when(score >= weak, 1)).alias("evidence"))
    gap = F.when(F.col("best_score") < missing, "missing_evidence").when(F.col("evidence") < wanted, "weak_coverage").otherwise("none")
    return stats.withColumn("gap", gap)


def cited_pairs(answers: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``author, year`` of every ``Author (YYYY)`` in an answer."""
    both = r"([A-Z][A-Za-z0-9]+) \(([0-9]{4})\)"
    found = F.arrays_zip(F.regexp_extract_all(text_col, F.lit(both), 1).alias("author"), F.regexp_extract_all(text_col, F.lit(both), 2).alias("year"))
    return answers.select(*id_cols, F.explode(found).alias("c")).select(*id_cols, F.col("c.author").alias("author"), F.col("c.year").alias("year")).distinct()


def quote_check(cases: DataFrame, docs: DataFrame) -> DataFrame:
    """``case_id, verdict``: not found, page out of range, verified or page exists."""
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    verdict = (
        F.when(F.col("text").isNull(), "not_found")
        .when(~F.col("page").between(1, F.col("total_pages")), "page_out_of_range")
        .when(F.contains(flat(F.col("text")), flat(F.col("quote"))), "verified")
        .otherwise("page_exists")
    )
    return cases.join(docs.select("doc_id", "text", "total_pages"), "doc_id", "left").select("case_id", verdict.alias("verdict"))


def expand_by_graph(seeds: DataFrame, occurrences: DataFrame, edges: DataFrame, hops: int = 1, entities: int = 30, terms: int = 12) -> DataFrame:
    """``query_id, name``: entities of each query's seed documents and those within ``hops`` edges, the first ``terms`` by name."""
    first = lambda df, n: df.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy("name"))).where(F.col("__n") <= n).drop("__n")
    reached = first(seeds.join(occurrences, "doc_id").select("query_id", "name").distinct(), entities)
    steps = edges.select(F.col("source").alias("name"), F.col("target").alias("next")).unionByName(edges.select(F.col("target").alias("name"), F.col("source").alias("next")))
    for _ in range(hops):
        reached = reached.unionByName(reached.join(steps, "name").select("query_id", F.col("next").alias("name"))).distinct()
    return first(reached, terms)


def documents_of_entities(occurrences: DataFrame, names: DataFrame) -> DataFrame:
    """``name, doc_id``, once each, of the entities in ``names``."""
    return occurrences.join(names.select("name").distinct(), "name", "left_semi").select("name", "doc_id").distinct()


def evidence_snippets(hits: DataFrame, chunks: DataFrame, claim: str = "query_id", most: int = 2, chars: int = 300) -> DataFrame:
    """``claim, snippets``: the best chunks of each claim as a JSON list of document, title, score and the start of its text.

    ``chunks`` has ``chunk_id, title, text``; a hit whose chunk is gone has an empty
    title and snippet.
    """
    best = hits.where(F.col("rank") <= most).join(chunks.select("chunk_id", "title", "text"), "chunk_id", "left")
    item = F.struct("rank", F.col("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.greatest(F.lit(0.0), F.round(1 - F.col("distance"), 6)).alias("score"), F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("snippet"))
    ordered = F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(*[x[c].alias(c) for c in ("doc_id", "title", "score", "snippet")]))
    return best.groupBy(claim).agg(F.to_json(ordered).alias("snippets"))


def paragraphs(chunks: DataFrame, most: int = 12, chars: int = 12_000, id_col: str = "doc_id", order: str = "chunk_index", text_col: str = "text") -> DataFrame:
    """``id, paragraph, no``: what claims are drawn from, the first paragraphs of each document.

    Chunks are joined in order by a blank line, the first ``chars`` characters are cut
    at blank lines, and of the parts that are not blank the first ``most`` are numbered
    from 1.  Only chunks that begin within those characters are gathered.
    """
    before = Window.partitionBy(id_col).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.sum(F.char_length(text_col) + 2).over(before), F.lit(0))
    near = chunks.where(F.length(text_col) > 0).withColumn("__at", begins).where(F.col("__at") < chars)
    joined = near.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text_col))), lambda c: c[text_col]), "\n\n").alias("__text"))
    parts = F.transform(F.split(F.substring("__text", 1, chars), "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    rows = joined.select(id_col, F.posexplode(F.slice(F.filter(parts, lambda p: p != ""), 1, most)).alias("pos", "paragraph"))
    return rows.select(id_col, "paragraph", (F.col("pos") + 1).cast("long").alias("no"))


def insights_view(claims: DataFrame, gaps: DataFrame, doc_clusters: DataFrame) -> DataFrame:
    """``claim_id, doc_id, component, n_gaps, kinds``: every claim with its gaps and its document's cluster, null where there is none."""
    kinds = F.array_join(F.sort_array(F.collect_set("gap")), ",")
    nested = gaps.where("gap <> 'none'").groupBy("claim_id").agg(F.count("*").alias("n_gaps"), kinds.alias("kinds"))
    return claims.join(nested, "claim_id", "left").join(doc_clusters, "doc_id", "left").select("claim_id", "doc_id", "component", F.coalesce("n_gaps", F.lit(0)).cast("long").alias("n_gaps"), "kinds")


def claims_by_cluster(view: DataFrame) -> DataFrame:
    """``component, n_claims, n_docs, with_gap`` over an insights view; claims of no cluster count together."""
    return view.groupBy("component").agg(F.count("*").alias("n_claims"), F.count_distinct("doc_id").alias("n_docs"), F.count(F.when(F.col("n_gaps") > 0, 1)).alias("with_gap"))


def overgeneral(answer: Column) -> Column:
    """Whether an answer has one of the phrases of over-generalisation."""
    return F.coalesce(answer.rlike("(?i)" + "|".join(P.OVERGENERAL)), F.lit(False))


def unverified_statistics(answers: DataFrame, sources: DataFrame, id_cols: list[str], source_cols: list[str], text_col: str = "answer", source_col: str = "source") -> DataFrame:
    """``id_cols, stat``: the figures that an answer gives in percent and no text of its sources has.

    ``sources`` has ``source_cols``, which are among ``id_cols``, and one text a row; an answer may have many.
    """
    figure = F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit(P.PERCENTAGE), 1))).alias("stat")
    named = answers.select(*id_cols, figure).distinct()
    held = named.join(sources.select(*source_cols, source_col), source_cols).where(F.contains(source_col, "stat")).select(*id_cols, "stat").distinct()
    return named.join(held, [*id_cols, "stat"], "left_anti")


def answer_verdict(answers: DataFrame, issues: DataFrame, id_cols: list[str], score_col: str | None = None, passing: float = 0.8) -> DataFrame:
    """``issues, valid, accuracy, hallucination, passed`` of every answer, from the list of its issues.

    Without a model's score an answer without issues is valid (accuracy 0.9, else
    0.5) and two issues are a hallucination; it passes if it has none.  With one in
    ``score_col``, each issue takes 0.1 off it, down to 0, and the answer passes from
    ``passing`` on, unless it is a hallucination; where the score is null, the first
    rule counts.
    """
    counts = issues.groupBy(*id_cols).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    plain = F.when(n == 0, 0.9).otherwise(0.5)
    accuracy, passed = plain, n == 0
    if score_col:
        lowered = F.when(F.col(score_col).isNotNull(), F.greatest(F.lit(0.0), F.round(F.col(score_col) - 0.1 * n, 6)))
        accuracy = F.coalesce(lowered, plain)
        passed = F.when(F.col(score_col).isNull(), n == 0).otherwise((lowered >= passing) & (n < 2))
    return answers.join(counts, id_cols, "left").select(*id_cols, n.alias("issues"), (n == 0).alias("valid"), accuracy.alias("accuracy"), (n >= 2).alias("hallucination"), passed.alias("passed"))


def look_up_citations(cited: DataFrame, sources: DataFrame, id_cols: list[str], order: str = "doc_id") -> DataFrame:
    """Each cited author and year with the first source whose authors and year hold them, or null.

    ``sources`` has ``authors`` (one string) and ``year``.  The different cited pairs
    meet the different authors and years of the sources, which are far fewer than
    either table; what matches is joined back by equality.
    """
    pairs = cited.select("author", "year").distinct()
    first = sources.groupBy("authors", F.col("year").cast("string").alias("y")).agg(F.min(order).alias(order))
    years = pairs.select("year").distinct().join(first.select("y").distinct(), F.contains("y", "year"))
    names = pairs.join(years, "year").join(first, "y").where(F.contains(F.lower("authors"), F.lower("author")))
    found = names.groupBy("author", "year").agg(F.min(order).alias(order))
    return cited.join(found, ["author", "year"], "left").select(*id_cols, "author", "year", order)


def quote_similarity(cases: DataFrame, docs: DataFrame, passing: float = 0.6) -> DataFrame:
    """``case_id, similarity, close``: the share of the quote's distinct three-word runs that the document holds.

    Cases are ``case_id, doc_id, quote``.  A shorter quote is one run, which only a text of
    just these words holds.  A missing document or an empty quote has similarity 0.
    """

    words = lambda text: F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def runs(name: str) -> Column:
        size = F.size(name)
        shifted = F.arrays_zip(F.col(name), F.slice(name, 2, F.greatest(size, F.lit(0))), F.slice(name, 3, F.greatest(size, F.lit(0))))
        three = F.transform(F.slice(shifted, 1, F.greatest(size - 2, F.lit(0))), lambda z: F.concat_ws(" ", z[name], z["1"], z["2"]))
        return F.when(size >= 3, F.array_distinct(three)).when(size > 0, F.array(F.array_join(name, " ")))

    held = cases.join(docs.select("doc_id", F.col("text").alias("__text")), "doc_id", "left")
    held = held.select("case_id", words(F.col("quote")).alias("q"), words(F.col("__text")).alias("t"))
    held = held.select("case_id", runs("q").alias("__q"), runs("t").alias("__t"))
    share = F.coalesce(F.size(F.array_intersect("__q", "__t")) / F.nullif(F.size("__q"), F.lit(0)), F.lit(0.0))
    return held.select("case_id", F.round(F.when(F.col("__t").isNull() | F.col("__q").isNull(), 0.0).otherwise(share), 6).alias("similarity")).withColumn("close", F.col("similarity") > passing)


def merge_entities(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row per entity: the first type that is given, the last cluster that is, and the number of rows.

    ``rows`` has ``by`` (such as base and name), ``type``, ``cluster`` and columns that order them.
    """
    place = F.struct(*order)
    return rows.groupBy(*by).agg(
        F.min_by("type", F.when(F.col("type").isNotNull(), place)).alias("type"),
        F.max_by("cluster", F.when(F.col("cluster").isNotNull(), place)).alias("cluster"),
        F.count("*").alias("n"),
    )


def occurrences(mentions: DataFrame, entities: DataFrame, by: list[str]) -> DataFrame:
    """The mentions whose entity is kept."""
    return mentions.join(entities.select(*by).distinct(), by, "left_semi")


def known_edges(relations: DataFrame, entities: DataFrame, name: str = "name", weight: float = 1.0) -> DataFrame:
    """The relations ``source, target`` of which both ends are entities, with a weight."""
    for end in ("source", "target"):
        relations = relations.join(entities.select(F.col(name).alias(end)).distinct(), end, "left_semi")
    return relations.withColumn("weight", F.lit(weight))


def fill_clusters(entities: DataFrame, clustered: DataFrame, name: str = "name") -> DataFrame:
    """Entities with the cluster of their component where they have none of their own; ``clustered`` is ``node, cluster``."""
    found = clustered.select(F.col("node").alias(name), F.col("cluster").alias("__found"))
    return entities.join(found, name, "left").withColumn("cluster", F.coalesce("cluster", "__found")).select(*entities.columns)


def cluster_relations(clustered: DataFrame, edges: DataFrame) -> DataFrame:
    """``cluster, relations``: the different kinds of relation that touch each cluster, in order, comma-joined.

    ``edges`` is ``source, target, relation``.
    """
    ends = edges.select(F.col("source").alias("node"), "relation").unionByName(edges.select(F.col("target").alias("node"), "relation"))
    met = clustered.select("node", "cluster").join(ends, "node").select("cluster", "relation").distinct()
    return met.groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_list("relation")), ", ").alias("relations"))


def graph_listing(entities: DataFrame, edges: DataFrame, clusters: DataFrame, nodes: int = 1000, links: int = 2000, groups: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a graph view shows: the first entities by name, the first edges by their ends, and the largest clusters.

    ``clusters`` has ``component, name``; the third result is ``component, size``, by size and then component.
    """
    sized = clusters.groupBy("component").agg(F.count_distinct("name").alias("size"))
    return entities.orderBy("name").limit(nodes), edges.orderBy("source", "target").limit(links), sized.orderBy(F.desc("size"), "component").limit(groups)


def induced_subgraph(nodes: DataFrame, edges: DataFrame, most_nodes: int = 200, most_edges: int = 400) -> DataFrame:
    """Edges ``source, target`` among the first nodes by ``name``, the first ones by their ends."""
    kept = nodes.select("name").distinct().orderBy("name").limit(most_nodes)
    for end in ("source", "target"):
        edges = edges.join(kept.select(F.col("name").alias(end)), end, "left_semi")
    return edges.select("source", "target").distinct().orderBy("source", "target").limit(most_edges)


def claims_to_check(claims: DataFrame, docs: DataFrame, per_document: int = 8, newest: int = 50, order: str = "claim_no") -> DataFrame:
    """The first claims of each of the newest documents; ``docs`` has ``doc_id`` and ``added``."""
    recent = docs.orderBy(F.desc("added"), F.desc("doc_id")).limit(newest).select("doc_id")
    first = Window.partitionBy("doc_id").orderBy(order)
    return claims.join(recent, "doc_id", "left_semi").withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= per_document).drop("__n")


def run_summary(docs: DataFrame, claims: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: documents processed, claims extracted, and gaps detected."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(docs, "documents_processed").join(one(claims, "claims_extracted")).join(one(gaps.where("gap <> 'none'"), "gaps_detected"))  # one row each


def gap_counters(gaps: DataFrame) -> DataFrame:
    """One row: claims with a missing and with a weak gap."""
    having = lambda kind, name: F.count_distinct(F.when(F.col("gap") == kind, F.col("claim_id"))).alias(name)
    return gaps.agg(having("missing_evidence", "missing"), having("weak_coverage", "weak"))


def claim_groups(view: DataFrame) -> DataFrame:
    """``component, n_claims, claims, place``: clusters by size, each with its claims in order.

    Clusters of one size are placed together (sizes are few), so no task has all.
    """
    groups = view.where("component is not null").groupBy("component").agg(F.count("*").alias("n_claims"), F.array_join(F.transform(F.sort_array(F.collect_list("claim_id")), lambda c: c.cast("string")), ",").alias("claims"))
    groups = materialize(groups, "claim-groups")
    return distributed_rank(groups.withColumn("__all", F.lit(0)), ["__all"], -F.col("n_claims"), ["component"], "place").withColumn("place", F.col("place") + 1).drop("__all")

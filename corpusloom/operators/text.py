"""Cleaning and metadata extraction, as column expressions and windows over lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.operators.phrases import expansions, named_groups

#: White space that is cut off the ends of lines and entries.
SPACE = " \t\n\r\x0b\x0c"

# A line that holds one of these is no title.
NOT_A_TITLE = ("page", "http", r"www\.", "@", "copyright", "confidential")


def _without(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, f"(?im){p}", ""), patterns, text)


def strip_noise(text: Column) -> Column:
    """The text without what the patterns of noise match.

    Every pattern but that of bare numbers needs one of a few words or signs, so a
    text without any of them, and without a bare number, stays as it is.
    """
    low = F.lower(text)
    signs = reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in P.NOISE_SIGNS])
    return F.when(signs | text.rlike(r"(?m)^\d+\s*$"), _without(text, P.NOISE)).otherwise(text)


def strip_generic_noise(text: Column) -> Column:
    """The cleaner of plain documents: four patterns, then lines that are hardly text."""
    return filter_lines(_without(text, P.GENERIC_NOISE))


def _readable(line: Column) -> Column:
    bare = F.trim(line)
    return (F.length(bare) >= 3) & (F.length(F.regexp_replace(bare, r"[^\p{L}\p{N} ]", "")) / F.length(bare) >= 0.5)


def filter_lines(text: Column) -> Column:
    """Keep the lines of three or more characters of which half are letters, digits or spaces."""
    return F.array_join(F.filter(F.split(text, "\n"), _readable), "\n")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), " {2,}", " "))


def drop_running_heads(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3) -> DataFrame:
    """``id, text`` without lines of 6 to 99 characters that a document has more than ``most`` times."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).withColumn("bare", F.trim("line"))
    seen = F.count("*").over(Window.partitionBy(id_col, "bare"))
    kept = lines.withColumn("n", seen).where(~(F.length("bare").between(6, 99) & (F.col("n") > most)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy(id_col).agg(joined.alias("text"))


def _hits(words: Column, stop: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(stop)))


def detect_language(text: Column) -> Column:
    """``de``, ``en`` or ``unknown``, from German letters and stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([A-Za-zÄÖÜäöüß]+)"), 1)
    de, en = _hits(words, P.GERMAN_STOPWORDS), _hits(words, P.ENGLISH_STOPWORDS)
    return (
        F.when(text.isNull() | (text == ""), "unknown")
        .when(text.rlike(f"[{P.GERMAN_LETTERS}]"), "de")
        .when(F.size(words) < 5, "unknown")
        .when(de >= F.greatest(F.lit(3.0), en * 1.2), "de")
        .when(en >= F.greatest(F.lit(3.0), de * 1.2), "en")
        .otherwise("unknown")
    )


def _score(text: Column, signs: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(text.rlike(p).cast("int"), F.lit(0)) for p in signs])


def detect_doctype(text: Column) -> Column:
    low = F.lower(text)
    academic, business = _score(low, P.ACADEMIC), _score(low, P.BUSINESS)
    return F.when((academic >= 3) & (academic > business), "academic").when((business >= 2) & (business > academic), "business").otherwise("generic")


def make_doc_id(phase: Column, stem: Column) -> Column:
    """``{phase}_{first 50 characters of the stem}``, in lower case and underscores."""
    return F.concat_ws("_", F.coalesce(F.regexp_replace(F.lower(phase), " ", "_"), F.lit("unknown")), F.regexp_replace(F.lower(F.substring(stem, 1, 50)), "[^a-z0-9_]", "_"))


def score_titles(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = 40) -> DataFrame:
    """``id, title, score``: the best-scored of the first lines, the earliest of equals."""
    rows = df.select(id_col, F.posexplode(F.slice(F.split(text_col, "\n"), 1, lines)).alias("pos", "raw")).withColumn("line", F.trim("raw"))
    low, size = F.lower("line"), F.length("line")
    skip = reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in P.NO_TITLE])
    digits = F.length(F.regexp_replace("line", "[^0-9]", ""))
    words = F.filter(F.split("line", r"\s+"), lambda w: w != "")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    point = lambda c, n: F.when(c, n).otherwise(0)
    upper = (F.upper("line") == F.col("line")) & (F.lower("line") != F.col("line"))
    score = (
        point(F.col("pos") < 15, 2)
        + point(F.col("line").rlike(r"^\p{Lu}"), 1)
        + F.when(size.between(20, 150), 2).when(size.between(10, 200), 1).otherwise(0)
        + point((F.size(words) >= 2) & (capital >= F.size(words) * 0.5), 1)
        + point(F.contains("line", F.lit(":")), 1)
        - point(upper & (size > 60), 2)
    ).cast("long")
    fit = rows.where((size >= 8) & (size <= 200) & ~skip & (digits <= size * 0.25)).withColumn("score", score).where("score > 0")
    first = Window.partitionBy(id_col).orderBy(F.desc("score"), "pos")
    return fit.withColumn("n", F.row_number().over(first)).where("n = 1").select(id_col, F.trim(F.regexp_replace("line", r"\s+", " ")).alias("title"), "score")


def _year(text: Column, pattern: str, now: int) -> Column:
    found = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")
    return F.when(found.between(1900, now), found)


def publication_year(df: DataFrame, now: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, year``: the copyright year; else published, received or volume; else ``Name (YYYY)``;
    else the oldest of the three most frequent years (the first seen of equals), before ``now``."""
    t, head = F.col(text_col), F.substring(text_col, 1, 3000)
    sure = F.coalesce(
        _year(t, r"[©Ⓒ]\s*([0-9]{4})", now),
        _year(head, r"(?i)(?:published|first published)[:\s]+.*?([0-9]{4})", now),
        _year(head, r"(?i)(?:received|accepted)[:\s]+.*?([0-9]{4})", now),
        _year(head, r"(?i)(?:vol\.|volume)\s*[0-9]+.*?([0-9]{4})", now),
        _year(F.substring(text_col, 1, 2000), r"[A-Z][a-z]+\s*[(,]\s*([0-9]{4})\)?", now),
    ).cast("long")
    rows = df.select(id_col, sure.alias("sure"), t.alias("__t"))
    every = rows.where("sure is null").select(id_col, F.posexplode(F.regexp_extract_all(F.substring("__t", 1, 5000), F.lit(r"\b((?:19|20)[0-9]{2})\b"), 1)).alias("pos", "y"))
    counts = every.where(F.col("y").cast("int") < now).groupBy(id_col, "y").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    common = Window.partitionBy(id_col).orderBy(F.desc("n"), "pos")
    guess = counts.withColumn("r", F.row_number().over(common)).where("r <= 3").groupBy(id_col).agg(F.min(F.col("y").cast("long")).alias("guess"))
    return rows.select(id_col, "sure").join(guess, id_col, "left").select(id_col, F.coalesce("sure", "guess").alias("year"))


def find_doi(text: Column) -> Column:
    tail = r"(10\.[0-9]{4,}/[^\s\]]+)"
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (rf"(?i)doi[:\s]*{tail}", rf"(?i)https?://doi\.org/{tail}", tail)]
    return F.regexp_replace(F.coalesce(*found), r"\.+$", "")


def keyword_line(text: Column, most: int = 10) -> Column:
    """The entries after ``Keywords`` and on the line below, longer than two characters."""
    said = F.regexp_extract(text, r"(?i)keywords?[\s:\-]*([^\n]+(?:\n[^\n]+)?)", 1)
    return F.slice(F.filter(F.transform(F.split(said, "[,;•·]"), lambda k: F.btrim(k, F.lit(SPACE))), lambda k: F.length(k) > 2), 1, most)


def phrases(text: Column) -> Column:
    """All capitalised phrases of two or more words, once each, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]+(?: [A-Z][a-z]+)+)"), 1))


def normalize_authors(names: Column) -> Column:
    """White space inside a name becomes one space; blank and repeated names are dropped."""
    return F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(F.regexp_replace(n, r"\s+", " "))), lambda n: n != ""))


def normalize_doi(doi: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(doi)), r"^https?://doi\.org/", "")


def research_type(topic: Column) -> Column:
    low = F.lower(topic)
    return (
        F.when(F.contains(low, F.lit("method")) | F.contains(low, F.lit("data")), "methodology")
        .when(F.contains(low, F.lit("case stud")), "case_study")
        .when(F.contains(low, F.lit("theoretical")) | F.contains(low, F.lit("framework")), "theoretical")
        .otherwise("empirical")
    )


def geographic_focus(text: Column, rules: dict[str, list[str]], default: str) -> Column:
    """The names of the rules one of whose substrings occurs; else ``[default]``.  The rules may be many (see :mod:`phrases`)."""
    hits = named_groups(text, rules)
    return F.when(F.size(hits) == 0, F.array(F.lit(default))).otherwise(hits)


def safe_filename(name: Column, default: str = "document") -> Column:
    base = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), "[^A-Za-z0-9._-]", "_")
    return F.coalesce(F.nullif(F.regexp_replace(base, "^[._]+|[._]+$", ""), F.lit("")), F.lit(default))


def title_from_filename(name: Column) -> Column:
    """Without extension, eight-digit hash and year prefix; separators become spaces."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), r"^[0-9a-f]{8}_", "")
    words = F.trim(F.regexp_replace(F.regexp_replace(stem, r"^(?:19|20)[0-9]{2}[_ -]+", ""), r"[_ -]+", " "))
    return F.when(F.length(words) > 3, F.initcap(words))


def page_text(df: DataFrame, page_sep: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per page that is not blank, with its number from 1 and its words."""
    pages = df.select(id_col, F.posexplode(F.split(text_col, page_sep)).alias("pos", "page")).where(F.trim("page") != "")
    return pages.select(id_col, (F.col("pos") + 1).cast("long").alias("page_no"), F.size(F.split(F.trim("page"), r"\s+")).cast("long").alias("word_count"))


def sections(df: DataFrame, headings: dict[str, str], expected: list[str], id_col: str = "doc_id", text_col: str = "text", shortest: int = 100) -> DataFrame:
    """``id, section_no, section_type, content, confidence``.

    A line that begins with a heading opens a section that runs to the next one and
    holds the heading too; text before the first heading and blank lines are left out.
    Sections of at most ``shortest`` characters are dropped, and documents without a
    section (or a text) give no row.  Confidence is the share of the expected types that
    the document has.  Each document is cut where it is read, without a shuffle.
    """
    lines = F.filter(F.split(text_col, "\n"), lambda l: F.btrim(l, F.lit(SPACE)) != "")
    maybe = rf"(?i)^\s*(?:{'|'.join(headings.values())})"  # most lines are none, and are looked at once

    def kind(line: Column) -> Column:
        bare = F.btrim(line, F.lit(SPACE))
        return reduce(lambda acc, item: acc.when(bare.rlike(f"(?i)^(?:{item[1]})"), item[0]), headings.items(), F.when(~line.rlike(maybe), None))

    cut = df.select(id_col, lines.alias("__l")).withColumn("__k", F.transform("__l", kind))
    numbers = F.when(F.size("__l") > 0, F.sequence(F.lit(1), F.size("__l")))
    cut = cut.withColumn("__s", F.filter(numbers, lambda i: F.element_at("__k", i).isNotNull()))

    def section(start: Column, number: Column) -> Column:
        end = F.coalesce(F.try_element_at("__s", number + 2), F.size("__l") + 1)
        content = F.btrim(F.array_join(F.slice("__l", start, end - start), "\n"), F.lit(SPACE))
        return F.struct((number + 1).alias("section_no"), F.element_at("__k", start).alias("section_type"), content.alias("content"))

    found = cut.select(id_col, F.transform("__s", section).alias("__f"))
    found = found.select(id_col, F.filter("__f", lambda f: F.length(f["content"]) > shortest).alias("__f"))
    types = F.array_distinct(F.filter(F.transform("__f", lambda f: f["section_type"]), lambda k: k.isin(expected)))
    # an outer explode: a plain one has a filter on its array inferred, which is pushed to the scan with all of the above in it
    rows = found.select(id_col, (F.size(types) / len(expected)).alias("confidence"), F.explode_outer("__f").alias("__f")).where("__f is not null")
    return rows.select(id_col, "__f.section_no", "__f.section_type", "__f.content", "confidence")


def page_ranges(spans: DataFrame, pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``page_start`` and ``page_end`` of spans ``id, start, end`` over pages ``id, page_no, length``.

    Pages get the offsets they cover by a running sum; a span meets them by range.
    """
    w = Window.partitionBy(id_col).orderBy("page_no")
    bounds = pages.withColumn("to", F.sum("length").over(w)).withColumn("from", F.col("to") - F.col("length"))
    met = spans.join(bounds, id_col).where("start < to and end > from")
    return met.groupBy(id_col, "start", "end").agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"))


def classify_questions(df: DataFrame, subjects: list[str], text_col: str = "query") -> DataFrame:
    """Adds ``complexity``, ``confidence``, ``word_count`` and ``topic_count``, the number of ``subjects`` (words or phrases, in lower case) in a question."""
    low = F.lower(F.trim(text_col))
    words = F.filter(F.split(F.trim(text_col), r"\s+"), lambda w: w != "")
    asked = F.length(text_col) - F.length(F.regexp_replace(text_col, r"\?", ""))
    own = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    topic = lambda k: F.contains(low, F.lit(k)) if " " in k else F.array_contains(own, k)
    topics = reduce(lambda a, b: a + b, [topic(k).cast("long") for k in subjects], F.lit(0).cast("long"))
    has = lambda signs: reduce(lambda a, b: a | b, [low.rlike(p) for p in signs])
    rows = df.withColumns({"word_count": F.size(words).cast("long"), "topic_count": topics, "__q": asked, "__s": has(P.SIMPLE), "__m": has(P.MEDIUM), "__c": has(P.COMPLEX)})
    w, t, q = F.col("word_count"), F.col("topic_count"), F.col("__q")
    level = lambda name, sure: F.struct(F.lit(name).alias("complexity"), F.lit(sure).cast("double").alias("confidence"))
    made = (
        F.when((w <= 15) & (q <= 1) & F.col("__s"), level("simple", 0.95))
        .when(F.col("__c") & ((t >= 2) | (q > 1) | (w >= 30)), level("complex", 0.9))
        .when(F.col("__c"), level("complex", 0.75))
        .when(t >= 3, level("complex", 0.7))
        .when((w >= 40) & (q > 1), level("complex", 0.75))
        .when(F.col("__m") & ((t >= 2) | (w >= 20)), level("medium", 0.85))
        .when(F.col("__m"), level("medium", 0.75))
        .when(F.col("__s"), level("simple", 0.85))
        .when(w <= 15, level("simple", 0.7))
        .otherwise(level("medium", 0.6))
    )
    return rows.withColumn("__l", made).select(*df.columns, "__l.*", "word_count", "topic_count")


def expand_terms(queries: DataFrame, groups: list[list[str]], most: int = 2, text_col: str = "query", signs: list[list[str]] | None = None) -> DataFrame:
    """Adds ``expanded`` and ``detected``: the first ``most`` variants of each group that the text names.

    A group is ``[canonical, variant, ...]``; the groups are the caller's list, in order,
    and may be a hundred thousand: they are found by an automaton, not by the plan.
    ``signs`` are the phrases that name each group, where not all of its own do.
    """
    rows = queries.withColumn("__terms", expansions(F.col(text_col), groups, most, signs))
    extra = F.col("__terms.extra")
    expanded = F.when(F.size(extra) > 0, F.concat_ws(" ", F.col(text_col), F.array_join(extra, " "))).otherwise(F.col(text_col))
    return rows.withColumn("expanded", expanded).withColumn("detected", F.col("__terms.detected")).drop("__terms")


def plain_title(text: Column) -> Column:
    """The first of twenty lines that reads like a title: 15 to 150 characters, a capital first,
    at most three digits in ten characters, none of the words of page furniture."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 20), lambda x: F.trim(x))

    def fits(line: Column) -> Column:
        digits = F.length(F.regexp_replace(line, "[^0-9]", ""))
        return F.length(line).between(15, 150) & line.rlike(r"^\p{Lu}") & (10 * digits <= 3 * F.length(line)) & ~F.lower(line).rlike("|".join(NOT_A_TITLE))

    return F.regexp_replace(F.get(F.filter(lines, fits), 0), r"\s+", " ")


def abstract_block(text: Column, most: int = 2000, least: int = 50) -> Column:
    """What follows ``Abstract`` or ``Summary`` up to the next heading, white space collapsed; null if short."""
    block = F.regexp_extract(text, r"(?is)\b(?:abstract|summary)[\s:-]+(.*?)\n\s*(?:keywords?|introduction|background|1\.)", 1)
    flat = F.trim(F.regexp_replace(block, r"\s+", " "))
    return F.when(F.length(flat) > least, F.substring(flat, 1, most))


def merge_metadata(df: DataFrame, now: int) -> DataFrame:
    """``year, title, authors`` by priority: from the file name, the text or the file's properties.

    Takes ``name_*``, ``text_*`` and ``file_*`` columns; a file's year counts only before ``now``,
    as copying a file sets it.
    """
    year = F.coalesce("name_year", "text_year", F.when(F.col("file_year") < now, F.col("file_year")))
    title = F.coalesce("file_title", "text_title", "name_title")
    rest = [c for c in df.columns if not c.startswith(("name_", "text_", "file_"))]
    return df.select(*rest, year.alias("year"), title.alias("title"), F.coalesce("name_authors", "text_authors").alias("authors"))


def flat_list(names: Column) -> Column:
    """A list as one string for export; null if there is nothing in it."""
    return F.nullif(F.array_join(names, ", "), F.lit(""))


def split_list(flat: Column) -> Column:
    """The list that ``flat_list`` wrote."""
    return F.filter(F.transform(F.split(flat, ","), lambda n: F.trim(n)), lambda n: n != "")


_NAME = r"[A-Z][a-z]{2,12} (?:[A-Z]\. ?)?[A-Z][a-z]{2,15}"


def text_authors(text: Column, excluded: list[str] = P.NOT_NAMES, most: int = 4, head: int = 2000) -> Column:
    """Names in the first characters: after ``by``, before an affiliation mark, or two joined by ``and``.

    A name with a part among ``excluded`` (lower case) is left out; names keep the order of the three
    rules and occur once.  An array, empty if there is none; null for a null text.
    """
    flat = F.regexp_replace(F.substring(text, 1, head), r"\s+", " ")
    after_by = F.regexp_extract_all(flat, F.lit(rf"\b[Bb]y ({_NAME})"), 1)
    marked = F.regexp_extract_all(flat, F.lit(rf"({_NAME})[\x{{b9}}\x{{b2}}\x{{b3}}*†‡§]"), 1)
    both = rf"({_NAME}) and ({_NAME})"
    joined = F.flatten(F.zip_with(F.regexp_extract_all(flat, F.lit(both), 1), F.regexp_extract_all(flat, F.lit(both), 2), lambda a, b: F.array(a, b)))
    barred = F.array(*map(F.lit, excluded))
    fits = lambda name: ~F.arrays_overlap(F.split(F.lower(F.regexp_replace(name, r"\.", "")), " "), barred)
    return F.slice(F.filter(F.array_distinct(F.concat(after_by, marked, joined)), fits), 1, most)


def plain_year(text: Column, now: int) -> Column:
    """The year after a copyright sign if it is plausible (1900 to ``now``), else the first plausible one."""
    marked = F.regexp_extract(text, r"©\s*([0-9]{4})", 1).try_cast("int")
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b(?:19|20)[0-9]{2}\b"), 0), lambda y: y.cast("int"))
    return F.coalesce(F.when(marked.between(1900, now), marked), F.get(F.filter(years, lambda y: y.between(1900, now)), 0)).cast("long")


def _stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def filename_year(name: Column, now: int) -> Column:
    """The first year that stands alone in a file's name, if it is from 1950 to ``now``."""
    year = F.regexp_extract(_stem(name), r"\b((?:19|20)[0-9]{2})\b", 1).try_cast("int")
    return F.when(year.between(1950, now), year).cast("long")


def filename_authors(name: Column, excluded: list[str] = P.NOT_NAMES) -> Column:
    """The authors that a file's name gives: after a year, before a year, two before a year, or in lower case before a year.

    The first of the four forms with a name that is not among ``excluded`` (lower case) counts; null if there is none.
    """
    stem, barred = _stem(name), F.array(*map(F.lit, excluded))

    def names(*parts: Column) -> Column:
        found = F.transform(F.array(*parts), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 40)))
        kept = F.filter(found, lambda x: (F.length(x) >= 3) & ~F.array_contains(barred, F.lower(x)))
        return F.when(F.size(kept) > 0, kept)

    part = lambda pattern, group=1: F.regexp_extract(stem, pattern, group)
    two = r"^([A-Z][a-z]{2,20})[_\-\s]+([A-Z][a-z]{2,20})[_\-\s]+[0-9]{4}"
    return F.coalesce(
        names(part(r"^[0-9]{4}[_\-\s]+([A-Z][a-z]{2,20})")),
        names(part(r"^([A-Z][a-z]{2,20})[_\-\s]+[0-9]{4}")),
        names(part(two, 1), part(two, 2)),
        names(part(r"^([a-z]{3,20})[0-9]{4}")),
    )


def plain_authors(text: Column, title: Column) -> Column:
    """Authors of a plain document: names in the lines after the title, else after a line that begins with ``by``.

    Up to eight lines are read, as far as the first word of the body; lines of an
    affiliation, with an address, or of an unlikely length are skipped.  Names are
    what stands between commas, semicolons, ampersands and the word ``and``, and has
    two parts; null if there is none.  Without a title among the first forty lines the
    text is read from its start.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    head = F.slice(lines, 1, 40)
    places = F.transform(head, lambda x, i: F.when(F.contains(F.lower(x), F.lower(title)), i + 1))
    start = F.when(F.length(title) > 0, F.coalesce(F.array_min(F.array_compact(places)), F.lit(0))).otherwise(0)
    near = F.slice(lines, start + 1, 8)
    stops = F.transform(near, lambda x, i: F.when(x.rlike(rf"(?i){P.AUTHOR_STOPS}"), i))
    near = F.slice(near, 1, F.coalesce(F.array_min(F.array_compact(stops)), F.lit(8)))
    fits = F.filter(near, lambda x: ~F.contains(x, F.lit("@")) & ~x.rlike(rf"(?i){P.AFFILIATIONS}") & F.length(x).between(5, 120))
    by = F.get(F.filter(F.transform(F.slice(lines, 1, 20), lambda x: F.regexp_extract(x, r"(?i)^by\s+(.+)$", 1)), lambda x: x != ""), 0)
    said = F.when(F.size(fits) > 0, F.array_join(fits, " ")).otherwise(F.trim(by))
    flat = F.trim(F.regexp_replace(F.regexp_replace(said, r"\s+", " "), "[0-9]+", ""))
    names = F.transform(F.split(flat, r"(?i)\s*(?:,|;|&|\band\b)\s*"), lambda x: F.trim(x))
    kept = F.filter(names, lambda x: x.rlike(r"\S\s+\S") & x.rlike("[A-Za-z]"))
    return F.when(F.size(kept) > 0, kept)


def extractor_kind(kind: Column, text: Column) -> Column:
    """``academic``, ``business`` or ``generic``: as a knowledge base says, found in the text where it says ``auto`` or nothing."""
    return F.when(kind.isin("academic", "business", "generic"), kind).otherwise(detect_doctype(F.coalesce(text, F.lit(""))))


def clean_by_kind(kind: Column, text: Column) -> Column:
    """The text without noise, as the extractor of its kind cleans it."""
    return collapse_space(F.when(kind == "academic", filter_lines(strip_noise(text))).otherwise(strip_generic_noise(text)))


def topical_keywords(text: Column, patterns: list[str], most: int = 10) -> Column:
    """The first ten capitalised words and phrases, then what the caller's topical patterns find, once each, ``most`` in all."""
    names = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)(?![\p{L}\p{N}_])"), 1)
    found = [F.regexp_extract_all(text, F.lit(f"(?i)({p})"), 1) for p in patterns]
    return F.slice(F.array_distinct(F.concat(F.slice(names, 1, 10), *found)), 1, most)

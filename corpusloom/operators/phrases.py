"""Phrases in texts: of a caller's map, by an automaton that every task builds once, or of a table of any size, by joins."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First characters of a term by which it meets the words of texts.
SEED = 8


class PhraseFinder:
    """Which groups of phrases a lower-cased text names, and by which of their phrases first.

    With ``signs``, a list for each group, only those of its phrases that are there count.
    """

    def __init__(self, groups: list[list[str]], signs: list[list[str]] | None = None):
        self._automaton = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for g, phrases in enumerate(groups):
            for rank, phrase in enumerate(phrases):
                if signs is not None and phrase not in signs[g]:
                    continue
                owners.setdefault(phrase.lower(), []).append((g, rank))
        self._always = owners.pop("", [])  # the empty phrase is in every text
        for phrase, own in owners.items():
            self._automaton.add_word(phrase, own)
        if owners:
            self._automaton.make_automaton()
        self._some = bool(owners)

    def find(self, low: str) -> list[tuple[int, int]]:
        """``(group, least place of a phrase of it)``, in the order of the groups."""
        first = dict(sorted(self._always, reverse=True))
        for _, own in self._automaton.iter(low) if self._some else ():
            for g, rank in own:
                if rank < first.get(g, rank + 1):
                    first[g] = rank
        return sorted(first.items())


def named_groups(text: Column, groups: dict[str, list[str]]) -> Column:
    """The names of the groups one of whose phrases ``text`` holds, whatever its case, in their order; none for null.

    The plan holds one function, however many phrases there are; they go to a task once.
    """
    names = list(groups)

    @F.pandas_udf("array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = PhraseFinder([groups[n] for n in names])
        for texts in batches:
            yield texts.map(lambda t: [] if t is None else [names[g] for g, _ in finder.find(t)])

    return find(F.lower(text))


def expansions(text: Column, groups: list[list[str]], most: int, signs: list[list[str]] | None = None) -> Column:
    """``struct(extra, detected)``: terms that the groups named by ``text`` add, and their canonical terms.

    A group is ``[canonical, variant, ...]``.  Where the text names the canonical
    term the first ``most`` variants are added, else the canonical term and those of
    these variants that are not the first one named.  With ``signs``, a group is
    named only by those of its phrases that are in its list.
    """

    @F.pandas_udf("extra array<string>, detected array<string>")
    def expand(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = PhraseFinder(groups, signs)
        for texts in batches:
            extra, detected = [], []
            for t in texts:
                found = [] if t is None else finder.find(t)
                added = []
                for g, rank in found:
                    canonical, variants = groups[g][0], groups[g][1 : most + 1]
                    added += variants if rank == 0 else [canonical, *(v for v in variants if v != groups[g][rank])]
                extra.append(added)
                detected.append([groups[g][0] for g, _ in found])
            yield pd.DataFrame({"extra": extra, "detected": detected})

    return expand(F.lower(text))


def terms_in(texts: DataFrame, by: list[str], terms: DataFrame, text_col: str = "text", apart: str = r"\s+") -> DataFrame:
    """``by, found``: which of ``terms`` (``term``, in lower case) the texts hold in any case, as a word or a part of one, sorted.

    Texts without one give no row, texts of one ``by`` one row.  No term holds what
    the pattern ``apart`` matches, white space as a rule, so a term lies in one word.
    Each different word meets the terms by its runs of at most ``SEED`` characters, of
    which one is a term's beginning; then the texts meet their words.  All is
    joined, so neither the driver nor a task has the table of terms.
    """
    each = texts.select(*by, F.explode(F.array_distinct(F.split(F.lower(text_col), apart))).alias("__word"))
    runs = F.regexp_extract_all("__word", F.lit(f"(?s)(?=(.{{1,{SEED}}}))"), F.lit(1))
    parts = F.flatten(F.transform(runs, lambda run: F.transform(F.sequence(F.lit(1), F.length(run)), lambda n: F.substring(run, F.lit(1), n))))
    words = each.select("__word").distinct().where("__word <> ''").select("__word", F.explode(F.array_distinct(parts)).alias("__seed"))
    sought = terms.select("term").where("term <> ''").distinct().withColumn("__seed", F.substring("term", 1, SEED))
    held = words.join(sought, "__seed").where(F.contains("__word", "term")).groupBy("__word").agg(F.collect_list("term").alias("__terms"))
    return each.join(held, "__word").groupBy(*by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__terms")))).alias("found"))

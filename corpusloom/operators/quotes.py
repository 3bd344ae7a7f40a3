"""Quotes that a text has with changes, by edit distance to the best passage of it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of the grams that choose windows.
GRAM = 2


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def best_distance(quote: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of ``quote`` to any passage of ``text``, and where the first such passage ends.

    A row of the table at a time: a row's running minimum settles its insertions.
    """
    ramp = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for k, letter in enumerate(quote, 1):
        step = np.empty_like(row)
        step[0] = k
        step[1:] = np.minimum(row[:-1] + (text != letter), row[1:] + 1)
        row = np.minimum.accumulate(step - ramp) + ramp
    end = int(row.argmin())
    return int(row[end]), end


def windows(quote: np.ndarray, text: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Stretches of ``text`` outside of which no passage is within ``most`` edits of ``quote``.

    Such a passage keeps at least ``len(quote) - GRAM + 1 - most * GRAM`` of the grams of
    the quote, and is at most ``most`` longer.  Where that number is not positive the
    whole text is the stretch.
    """
    need = len(quote) - GRAM + 1 - most * GRAM
    if need <= 0 or len(text) < GRAM:
        return [(0, len(text))] if len(text) else []
    scale = np.int64(0x110000)
    own = np.unique(quote[:-1] * scale + quote[1:])
    grams = text[:-1] * scale + text[1:]
    hit = np.concatenate([[0], np.cumsum(np.isin(grams, own))])
    wide = len(quote) + most - GRAM + 1  # grams of the longest passage
    starts = np.arange(len(grams))
    ends = np.minimum(starts + wide, len(grams))
    good = np.flatnonzero(hit[ends] - hit[starts] >= need)
    if not len(good):
        return []
    out = []
    for group in np.split(good, np.flatnonzero(np.diff(good) > len(quote) + most) + 1):
        # a passage may begin up to GRAM - 1 letters before its first gram, and ends with its last
        out.append((max(0, int(group[0]) - len(quote) - most), min(len(text), int(group[-1]) + len(quote) + 2 * most + GRAM)))
    return out


def similarity(quote: str, text: str, passing: float) -> float:
    """1 less edits for each letter of the quote, to the best passage of the text; 0 if that is under ``passing``."""
    q, t = _codes(quote), _codes(text)
    if not len(q) or not len(t):
        return 0.0
    most = int(np.floor((1 - passing) * len(q) + 1e-9))
    least = min((best_distance(q, t[a:b])[0] for a, b in windows(q, t, most)), default=len(q))
    return 1 - least / len(q) if least <= most else 0.0


def fuzzy_quotes(cases: DataFrame, docs: DataFrame, passing: float = 0.6) -> DataFrame:
    """``case_id, similarity, close`` for cases ``case_id, doc_id, quote``, against ``docs`` (``doc_id, text``).

    Case and runs of white space count for nothing.  ``similarity`` is one less the edits
    (letters put in, left out or changed) that the quote needs to be a passage of the
    text, for each of its letters; ``close`` says whether that is ``passing`` or
    more, and otherwise it is 0.  A missing document, a null or blank quote and an
    empty text have similarity 0; a case of several documents has a row for each.
    """

    def flat(c):
        return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))

    met = cases.join(docs.select("doc_id", F.col("text").alias("__text")), "doc_id", "left").select("case_id", flat(F.col("quote")).alias("quote"), flat(F.col("__text")).alias("text"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [similarity(q or "", t or "", passing) for q, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([round(s, 6) for s in found], pa.float64()), pa.array([s > 0 for s in found])], ["case_id", "similarity", "close"])

    return met.mapInArrow(run, f"case_id {met.schema['case_id'].dataType.simpleString()}, similarity double, close boolean")

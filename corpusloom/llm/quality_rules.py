"""Quality rules: counts over words and lines, and bands of compression ratios.

Two kinds of bands decide.  Fixed ones, wide and the same for every corpus, hold
for whole texts and for their chunks.  Fitted ones hold for whole texts: how far
text compresses depends on its length and its kind, so a smooth curve over the
logarithm of the length gives the usual ratio and its spread, learnt from all
different texts of a corpus that pass the base rule.  A curve is a value of its
own: with a given curve the verdict of a text depends on nothing but the text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize

SYMBOLS = b"#*$%&|<>"
#: Length classes for each doubling of a text's bytes, and steps of the logarithm of a ratio.
CLASSES, STEPS = 8, 500
#: Least width of the middle half of the logarithms, so that a family of near copies sets no narrow band.
LEAST_SPREAD = 0.02
#: What is taken to be usual before any text is seen: texts that count for each doubling of the bytes between two powers of two, logarithm of their ratio at 2**11 bytes, its slope by doubling, and its standard deviation.
PRIOR_TEXTS, PRIOR_OCTAVES, PRIOR_CENTRE, PRIOR_SLOPE, PRIOR_SPREAD = 2.0, (7, 24), -0.75, -0.06, 0.3
#: Residuals beyond so many standard deviations pull no harder on the curve.
HUBER = 1.5
#: Share of the texts that the curve leaves out at either end of the lengths; beyond, it goes straight and the spread doubles by doubling.
ENDS = 0.005


@dataclass(frozen=True)
class Curve:
    """Usual logarithm of the ratio (quadratic in the doublings of the length) and the logarithm of its standard deviation."""

    centre: tuple[float, float, float]
    spread: tuple[float, float, float]
    #: doublings between which texts were seen
    low: float
    high: float

    def at(self, doublings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centre and width of the middle half at lengths of ``2 ** doublings`` bytes."""
        inside = np.clip(doublings, self.low, self.high)
        beyond = np.abs(doublings - inside)
        centre = np.polyval(self.centre[::-1], inside - 11) + PRIOR_SLOPE * (doublings - inside)
        return centre, np.maximum(1.349 * np.exp(np.polyval(self.spread[::-1], inside - 11)) * 2.0**beyond, LEAST_SPREAD)

    def limits(self, size: Column, fence: float) -> tuple[Column, Column]:
        """Lowest and highest ratio of a text of ``size`` bytes: fences of so many widths beyond the middle half."""
        doublings = F.log2(size)
        inside = F.least(F.greatest(doublings, F.lit(self.low)), F.lit(self.high))
        x = inside - 11
        centre = F.lit(self.centre[0]) + self.centre[1] * x + self.centre[2] * x * x + PRIOR_SLOPE * (doublings - inside)
        width = F.exp(F.lit(self.spread[0]) + self.spread[1] * x + self.spread[2] * x * x) * F.pow(F.lit(2.0), F.abs(doublings - inside))
        reach = (0.5 + fence) * F.greatest(1.349 * width, F.lit(LEAST_SPREAD))
        return F.exp(centre - reach), F.exp(centre + reach)


@dataclass(frozen=True)
class Bands:
    """Limits of zstandard ratios (compressed / raw bytes)."""

    level: int = 3
    #: (bytes from, lowest, highest ratio of a whole text); shorter texts have no limits
    whole: tuple[tuple[int, float, float], ...] = (
        (150, 0.24, 1.05),
        (300, 0.24, 0.90),
        (1000, 0.24, 0.80),
        (4096, 0.20, 0.74),
        (16384, 0.15, 0.74),
    )
    #: (bytes of the text from, bytes of a chunk, lowest, highest ratio of a chunk); a shorter text is tested as a whole only
    chunks: tuple[tuple[int, int, float, float], ...] = (
        (256, 256, 0.40, 0.92),
        (2048, 512, 0.25, 0.84),
        (4096, 1024, 0.20, 0.80),
        (16384, 4096, 0.15, 0.76),
    )
    #: a text is rejected if more than this share of its chunks is out of its band
    bad_chunks: float = 0.25
    #: fitted limits lie so many widths of the middle half beyond it; infinite: fixed bands only
    fence: float = 2.0

    def limits(self, size: int) -> tuple[float, float]:
        found = (0.0, float("inf"))
        for start, low, high in self.whole:
            if size >= start:
                found = (low, high)
        return found

    def cut(self, size: int) -> tuple[list[int], int, float, float]:
        """Where the chunks of a text of ``size`` bytes begin, their bytes and limits; the last may overlap the one before."""
        begins, found = [], (0, 0.0, float("inf"))
        for start, chunk, low, high in self.chunks:
            if size >= start:
                begins = [*range(0, size - chunk + 1, chunk), *([size - chunk] if size % chunk else [])]
                found = (chunk, low, high)
        return begins, *found


def base_counts(text: str) -> dict[str, int]:
    """The five counts of one text; words are runs of anything but ASCII white space."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen, dup_lines = set(), 0
    for line in raw.split(b"\n"):
        if line.strip():
            dup_lines += line in seen
            seen.add(line)
    repeat = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(windows) > len(set(windows)):
        often = {w for w, n in Counter(windows).items() if n > 1}
        covered = -1  # last word that a repeated window covers
        for k, window in enumerate(windows):
            if window in often:
                repeat += k + 2 - max(covered, k - 1)
                covered = k + 2
    return {
        "n_words": len(words),
        "word_chars": len(b"".join(words).decode("utf-8", "surrogatepass")),
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat,
    }


def compression(text: str, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple[float | None, int, int, bool]:
    """(ratio of the whole text, chunks, chunks out of band, verdict)."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return None, 0, 0, True
    ratio = len(compressor.compress(raw)) / len(raw)
    low, high = bands.limits(len(raw))
    begins, chunk, lowest, highest = bands.cut(len(raw))
    bad = 0
    for at in begins:
        part = len(compressor.compress(raw[at : at + chunk])) / chunk
        bad += not lowest <= part <= highest
    return ratio, len(begins), bad, low <= ratio <= high and bad <= bands.bad_chunks * len(begins)


def fit_curve(histogram: list[tuple[int, int, int]]) -> Curve:
    """The curve of ``(length class, step of the logarithm of the ratio, texts)``.

    Reweighted least squares, so that a share of odd texts does not bend it.  The
    prior counts as a few texts of every length, so every corpus has a curve that
    changes with each text a little: nothing is switched by how many there are.
    """
    octaves = np.arange(PRIOR_OCTAVES[0], PRIOR_OCTAVES[1] + 1) - 11.0
    seen = np.array(sorted(histogram), dtype=np.float64).reshape(-1, 3)
    x = np.concatenate([(seen[:, 0] + 0.5) / CLASSES - 11, octaves])
    y = np.concatenate([(seen[:, 1] + 0.5) / STEPS, PRIOR_CENTRE + PRIOR_SLOPE * octaves])
    n = np.concatenate([seen[:, 2], np.full(len(octaves), PRIOR_TEXTS)])
    own = np.arange(len(x)) < len(seen)
    basis = np.stack([np.ones_like(x), x, x * x], axis=1)
    centre, spread = np.array([PRIOR_CENTRE, PRIOR_SLOPE, 0.0]), np.array([np.log(PRIOR_SPREAD), 0.0, 0.0])
    for _ in range(60):
        sigma = np.where(own, np.maximum(np.exp(basis @ spread), LEAST_SPREAD / 2), PRIOR_SPREAD)
        off = np.abs(y - basis @ centre) / sigma
        w = n / sigma**2 * np.minimum(1, HUBER / np.maximum(off, 1e-9))
        centre = np.linalg.solve(basis.T @ (basis * w[:, None]), basis.T @ (w * y))
        # the mean logarithm of a normal deviate's size is 0.635 under that of its standard deviation
        size = np.where(own, np.log(np.maximum(np.abs(y - basis @ centre), 0.5 / STEPS)) + 0.635, np.log(PRIOR_SPREAD))
        spread = np.linalg.solve(basis.T @ (basis * n[:, None]), basis.T @ (n * size))
    at = np.cumsum(seen[np.argsort(seen[:, 0], kind="stable"), 2])
    ends = [float(np.sort(seen[:, 0])[np.searchsorted(at, q * at[-1])]) for q in (ENDS, 1 - ENDS)] if len(seen) else [11 * CLASSES] * 2
    return Curve(tuple(map(float, centre)), tuple(map(float, spread)), ends[0] / CLASSES, (ends[1] + 1) / CLASSES)


def learn_curve(figures: DataFrame) -> Curve:
    """The curve of all different texts that pass the base rule, from what :func:`quality_figures` gives.

    Copies have the same figures and count once.
    """
    different = figures.where("not base_failed").select("n_bytes", "zstd_ratio", "n_words", "word_chars", "n_symbols").distinct()
    # at most a few hundred classes times the steps of a ratio, whatever the input
    length_class, step = F.floor(F.log2("n_bytes") * CLASSES).cast("int"), F.floor(F.log("zstd_ratio") * STEPS).cast("int")
    return fit_curve([tuple(r) for r in different.groupBy(length_class.alias("c"), step.alias("step")).count().collect()])


def quality_figures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """``id``, the five counts, ``base_failed``, ``n_bytes``, ``zstd_ratio``, ``n_chunks``, ``bad_chunks`` and ``in_band`` (fixed bands)."""
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            counts, ratios = [], []
            for value in batch.column(1):
                t = value.as_py() or ""
                counts.append(base_counts(t))
                ratios.append((len(t.encode("utf-8", "surrogatepass")), *compression(t, bands, compressor)))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in longs]
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())
            columns += [pa.array([r[k] for r in ratios], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *longs, "n_bytes", "zstd_ratio", "n_chunks", "bad_chunks", "in_band"])

    schema = "id long, " + ", ".join(f"{k} long" for k in longs) + ", n_bytes long, zstd_ratio double, n_chunks long, bad_chunks long, in_band boolean"
    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return picked.mapInArrow(run, schema).withColumn("base_failed", failed)


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands(), curve: Curve | None = None) -> DataFrame:
    """Counts, ``base_failed``, compression figures, fitted limits and ``kept`` for every row.

    ``kept`` is false where the base rule fails (under 50 words, or over half of
    the words in repeated three-word windows) and otherwise says whether the text
    is inside its compression bands, the fixed ones and those of ``curve``.  With a
    given curve a row has the same verdict in every table; without one it is learnt
    from the table itself (:func:`learn_curve`), so that of a corpus cut in parts
    the curve of the whole should be given to each.  Null texts count as empty and
    fail the base rule; null ids and repeated rows stay; an empty table gives an
    empty result; further columns are ignored.
    """
    figures = quality_figures(df, id_col, text_col, bands)
    if curve is None:
        figures = materialize(figures, "quality-figures")
        curve = learn_curve(figures)
    low, high = curve.limits(F.col("n_bytes"), bands.fence)
    fitted = F.coalesce(F.col("zstd_ratio").between(F.col("fitted_low"), F.col("fitted_high")), F.lit(True))
    return (
        figures.withColumn("fitted_low", F.when(F.col("n_bytes") > 0, low))
        .withColumn("fitted_high", F.when(F.col("n_bytes") > 0, high))
        .withColumn("kept", ~F.col("base_failed") & F.col("in_band") & fitted)
        .drop("in_band")
        .withColumnRenamed("id", id_col)
    )

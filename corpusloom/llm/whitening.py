"""Whitening of embeddings by polarisation.

Covariances are never multiplied out: the corpus gives the exact sum of squares of
every dimension and of the sum of every two dimensions, and since
``var(a + b) = var(a) + var(b) + 2 cov(a, b)`` their differences are all
covariances.  Entries are put on a grid of integers, so every sum is exact and
no order of the tasks changes a digit; only the eigenvectors are floating point.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Grid steps of 1, and what is added so that usual values are positive.
SCALE, SHIFT = 64, 1_000_000
#: Components that are returned, and the least eigenvalue as a share of the largest.
COMPONENTS, LEAST_SHARE = 32, 1e-10
#: Rows that a task works on at once, and the largest value whose squares surely add up in 64 bits.
ROWS, SMALL = 1024, 1 << 24
#: Bits of an exact sum that are added in one column.
LIMB = 40


def _grid(batch, dimensions: int | None = None, column: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of an Arrow batch have a whole vector (of ``dimensions``), and these on the grid."""
    lists = batch.column(column)
    good = np.zeros(batch.num_rows, bool)
    rows = []
    for k in range(batch.num_rows):
        v = lists[k]
        if v.is_valid and len(v.values) and v.values.null_count == 0 and (dimensions is None or len(v.values) == dimensions):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all():
                good[k] = True
                rows.append(x)
    if not rows:
        return good, np.zeros((0, dimensions or 0), dtype=np.int64)
    x = np.floor(SCALE * np.array(rows))
    # beyond 2**62 an entry is a Python integer, in exact if slow arithmetic
    return good, (x.astype(np.int64) + SHIFT if np.abs(x).max() < 1 << 62 else np.array([[int(e) + SHIFT for e in r] for r in x], dtype=object))


def _parts(batch):
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def _exact(values: np.ndarray, limit: int = SMALL) -> np.ndarray:
    """The same values as 64-bit integers if their squares add up without overflow, else as Python integers."""
    if values.dtype != object and (not values.size or np.abs(values).max() < limit):
        return values
    return values.astype(object)


def _minus(x: np.ndarray, middle: list[int]) -> np.ndarray:
    """``x`` less ``middle``, as integers whose squares add up exactly."""
    small = x.dtype != object and max(map(abs, middle)) < 1 << 61 and (not x.size or np.abs(x).max() < 1 << 61)
    return _exact((x if small else x.astype(object)) - np.array(middle, dtype=np.int64 if small else object))


def _dimensions(vectors: DataFrame) -> int:
    """The length that most vectors have; of equally frequent ones the largest."""
    sized = vectors.where(F.col("vector").isNotNull() & (F.size("vector") > 0)).groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    most = sized.orderBy(F.desc("n"), F.desc("d")).first()
    return most["d"] if most else 0


def _long_sums(parts: DataFrame, run) -> dict[tuple[int, int], int]:
    """Sums of what tasks hand over as ``i, j, limb, part``: integers of any size in limbs of 40 bits, which add up exactly."""
    added = parts.mapInArrow(run, "i int, j int, limb int, part long").groupBy("i", "j", "limb").agg(F.sum("part").alias("part"))
    out: dict[tuple[int, int], int] = {}
    for r in added.collect():  # a few rows a pair of dimensions
        out[r.i, r.j] = out.get((r.i, r.j), 0) + (int(r.part) << LIMB * r.limb)
    return out


def _handed(totals: dict[tuple[int, int], int]) -> pa.RecordBatch:
    rows = []
    for (i, j), v in totals.items():
        sign, v, limb = (-1 if v < 0 else 1), abs(v), 0
        while v or not limb:
            rows.append((i, j, limb, sign * (v & ((1 << LIMB) - 1))))
            v, limb = v >> LIMB, limb + 1
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["i", "j", "limb", "part"])


@dataclass(frozen=True)
class Whitening:
    """n vectors, per-dimension sums, eigenvalues (falling), eigenvectors (rows), trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance from the integer part of the mean, and the fraction of the mean times n."""
        floor = [s // self.n for s in self.sums]
        rest = [s - self.n * f for s, f in zip(self.sums, floor, strict=True)]
        return _minus(x, floor), np.array(rest, dtype=object)

    def project(self, x: np.ndarray) -> np.ndarray:
        y, rest = self.centred(x)
        return (y.astype(np.float64) - (rest / self.n).astype(np.float64)) @ self.vectors.T / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2 for each row, exactly."""
        y, rest = self.centred(x)
        squares = (y * y).sum(axis=1)
        cross = y.astype(object) @ rest
        return [self.n * self.n * int(q) - 2 * self.n * int(c) + int((rest * rest).sum()) for q, c in zip(squares, cross, strict=True)]


def covariance(n: int, sums: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance matrix, divisor n, from the exact sums of squares of ``n x - S`` and of its sums over two dimensions."""
    d = len(sums)
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            product = squares[i, i] if i == j else (squares[i, j] - squares[i, i] - squares[j, j]) // 2
            out[i, j] = out[j, i] = product / n**3
    return out


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fit on all whole vectors of ``vector``; two passes, and d * (d + 1) / 2 numbers to the driver.

    Values are centred on the integer part of their dimension's mean before they are
    squared, which keeps them small; the fraction of the mean, the same for all
    rows, is then taken off exactly.
    """
    d = _dimensions(vectors)

    def sums(batches):
        total, n = [0] * d, 0
        for batch in batches:
            for part in _parts(batch):
                _, x = _grid(part, d, 0)
                n += len(x)
                if len(x):
                    total = [a + int(b) for a, b in zip(total, _exact(x, 1 << 50).sum(axis=0), strict=True)]
        yield _handed({(k, 0): v for k, v in enumerate(total)} | {(-1, 0): n})

    found = _long_sums(vectors.select("vector"), sums) if d else {}
    n = found.pop((-1, 0), 0)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    totals = [found[k, 0] for k in range(d)]
    middle = [s // n for s in totals]

    def squares(batches):
        out = [[0] * (d - i) for i in range(d)]
        for batch in batches:
            for part in _parts(batch):
                _, x = _grid(part, d, 0)
                if len(x):
                    y = _minus(x, middle)
                    for i in range(d):
                        both = y[:, i:] + y[:, i : i + 1]
                        both[:, 0] = y[:, i]
                        out[i] = [a + int(b) for a, b in zip(out[i], (both * both).sum(axis=0), strict=True)]
        yield _handed({(i, i + k): v for i in range(d) for k, v in enumerate(out[i])})

    raw = _long_sums(vectors.select("vector"), squares)
    rest = [s - n * m for s, m in zip(totals, middle, strict=True)]
    exact = {(i, j): n * n * q - n * (rest[i] if i == j else rest[i] + rest[j]) ** 2 for (i, j), q in raw.items()}
    v = covariance(n, totals, exact)
    values, found_vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > LEAST_SHARE * max(float(values.max()), 0.0)]
    axes = found_vectors[:, order].T
    largest = np.abs(axes).argmax(axis=1)
    axes = axes * np.where(axes[np.arange(len(axes)), largest] < 0, -1.0, 1.0)[:, None]
    return Whitening(n, totals, values[order], axes, float(np.trace(v)))


def identity_error(vectors: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured on all of them."""
    c, d = len(fitted.values), len(fitted.sums)

    def run(batches):
        first, second = np.zeros(c), np.zeros((c, c))
        for batch in batches:
            for part in _parts(batch):
                _, x = _grid(part, d, 0)
                if len(x):
                    w = fitted.project(x)
                    first += w.sum(axis=0)
                    second += w.T @ w
        rows = [(i, -1, first[i]) for i in range(c)] + [(i, j, second[i, j]) for i in range(c) for j in range(c)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.float64()))], ["i", "j", "v"])

    total = vectors.select("vector").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    at = {(r.i, r.j): r.v / fitted.n for r in total}
    return max((abs(at[i, j] - at[i, -1] * at[j, -1] - (i == j)) for i in range(c) for j in range(c)), default=0.0)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, fitted: Whitening | None = None) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error, deviation_exact`` for every whole vector and component.

    ``deviation`` is the sum over dimensions of (n x - S)^2, null where it is no
    64-bit number (``deviation_exact``, up to 38 digits, goes on).  Components are
    numbered from 1 by falling eigenvalue, their largest entry is positive.

    Left out are null and empty vectors, those with a null or an entry that is not
    finite, and those of another length than most.  Components without spread
    (under 1e-10 of the largest eigenvalue) have no rows, so constant or single
    vectors give none, as does an empty table.  Null ids and repeated rows stay;
    further columns are ignored.
    """
    picked = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    fitted = fitted or fit_whitening(picked, components)
    c, d = len(fitted.values), len(fitted.sums)
    error = identity_error(picked, fitted) if c else 0.0
    sent = df.sparkSession.sparkContext.broadcast(fitted)  # at most 32 x d numbers
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"]

    def run(batches):
        fit = sent.value
        share = fit.values / fit.trace if c else np.zeros(0)
        for batch in batches:
            for part in _parts(batch) if c else ():
                good, x = _grid(part, d, 1)
                if not len(x):
                    continue
                exact = fit.deviation(x)
                spread = np.repeat(np.arange(len(x)), c)
                far = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
                near = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).filter(pa.array(good)).take(pa.array(spread)), pa.array(np.tile(np.arange(1, c + 1), len(x)), pa.int32()), pa.array(np.full(len(spread), fit.n), pa.int64()),
                        near.take(pa.array(spread)), pa.array(fit.project(x).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(spread), error)), far.take(pa.array(spread)),
                    ], names,
                )

    schema = f"`{id_col}` long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    return picked.mapInArrow(run, schema)

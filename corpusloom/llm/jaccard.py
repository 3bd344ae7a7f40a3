"""Groups of documents whose sets of word n-grams have a Jaccard similarity of a threshold or more.

Sets of about one size form a band.  A band cuts the universe of n-grams into
segments by a hash, and a set's n-grams in a segment are the set's part of it.  Two
sets that link differ in at most ``H`` n-grams, so of ``H + 1 + spare`` segments
more than ``spare`` parts are the same in both (pigeonhole).  A part that is twice
as wide and indexed with its one-deletion neighbourhood stands for two segments.

The allocation follows cost.  For a band, parts alone or parts with deletions, by
the keys that a set emits and the chance meetings that a corpus of this size brings.
For a set, its most frequent parts are not looked at, as many as the spare segments
allow: frequencies are counted over the whole corpus, and of the parts that two
linked sets share, the rarest is looked at by both.

Sets that share a key are compared with the most typical of them first; what is
then still apart is compared with the rest, if sizes and parity sketches allow a
link.  Every link is verified on the whole sets.  Equal sets count as one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.bm25 import top_k
from corpusloom.operators.components import connected_components
from corpusloom.session import discard, materialize

#: Longs of a parity sketch: two sets differ in as many n-grams at least as their sketches in bits.
SKETCH = 8
#: Sets that a task remembers, so that copies emit their keys once.
KNOWN = 50_000
#: Texts that are fetched by a broadcast of their hashes; more are joined.
MAX_FETCHED = 1_000_000
#: A set is hot if more than one in so many rows has it.
HOT = 5000
#: Chance that two n-grams of unrelated texts are the same.
MEET = 1e-4
_A, _B, _C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_A)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_B)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of ``width`` words; of fewer words the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    grams = {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, grams), dtype=np.uint64, count=len(grams)))


@dataclass(frozen=True)
class Band:
    """Sets of ``low`` to ``high`` n-grams as the smaller of a pair, and how their universe is cut."""

    number: int
    low: int
    high: int
    exact: int
    deleted: int

    @property
    def residues(self) -> int:
        return self.exact + 2 * self.deleted


class Bands:
    """All bands for a threshold of ``percent`` and a corpus of ``rows`` documents."""

    def __init__(self, percent: int, rows: int):
        self.percent, self.rows = percent, max(1, rows)
        self.first = next(n for n in range(1, 10_000) if self.most(n, self.partner(n)))
        self.ratio = max(1.5, 100 / percent + 0.01)
        self._bands: list[Band] = []

    def partner(self, n: int) -> int:
        """The largest set that a set of ``n`` can link with."""
        return 100 * n // self.percent

    def most(self, a: int, b: int) -> int:
        """The most n-grams by which linked sets of these sizes differ."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def cost(self, size: int, spare: int, exact: int, deleted: int) -> float:
        """Keys that a set emits, and chance meetings with other sets."""
        mean = size / (exact + 2 * deleted)
        empty = exp(-2 * mean) if 4 * exact * exp(-mean) > spare else 0.0  # else the spare segments take the empty parts
        alone = exact * (1 + self.rows * (empty + exp(-2 * mean) * mean * mean * MEET))
        wide = 2 * mean
        return alone + deleted * (1 + wide + self.rows * exp(-2 * wide) * (1 + wide) ** 2)

    def _add(self) -> None:
        low = self._bands[-1].high + 1 if self._bands else self.first
        high = max(low, int(low * self.ratio))
        need = self.most(high, self.partner(high)) + 1
        spare = 1 + need // 4
        alone = self.cost(low, spare, need + spare, 0)
        pairs = -(-need // 2)
        wide = self.cost(low, 0, 0, pairs)
        self._bands.append(Band(len(self._bands), low, high, need + spare, 0) if alone <= wide else Band(len(self._bands), low, high, 0, pairs))

    def of(self, n: int) -> list[tuple[Band, int]]:
        """The bands that a set of ``n`` n-grams takes part in, and how many of its most frequent parts it may leave out."""
        if n < self.first:
            return []  # links with equal sets only
        while not self._bands or self._bands[-1].high < n:
            self._add()
        at = next(k for k, b in enumerate(self._bands) if n <= b.high)
        out = [(self._bands[at], self.most(n, self.partner(n)))]
        if at and n <= self.partner(self._bands[at - 1].high):
            out.append((self._bands[at - 1], self.most(self._bands[at - 1].high, n)))
        return [(b, max(0, min(b.exact, b.residues - h - 1))) for b, h in out]


def band_keys(hashes: np.ndarray, band: Band) -> np.ndarray:
    """The keys of a set in a band: even for parts, odd for parts with or without one of their n-grams."""
    residue = ((hashes >> np.uint64(20)) % np.uint64(band.residues)).astype(np.int64)
    part = np.where(residue < band.exact, residue, band.exact + (residue - band.exact) // 2)
    order = np.argsort(part, kind="stable")
    marks = _mix(hashes[order] + np.uint64((band.number + 1) * _C & (1 << 64) - 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(marks, dtype=np.uint64)])
    ends = np.searchsorted(part[order], np.arange(band.exact + band.deleted), "right")
    begins = np.concatenate([[0], ends[:-1]])
    name = np.arange(1, band.exact + band.deleted + 1, dtype=np.uint64) * np.uint64(_B) + np.uint64(band.number)
    whole = sums[ends] - sums[begins] + _mix(name)
    even, odd = ~np.uint64(1), np.uint64(1)
    if not band.deleted:
        return (_mix(whole) & even).view(np.int64)
    split = int(begins[band.exact])
    less = whole[part[order][split:]] - marks[split:]
    keys = [_mix(whole[: band.exact]) & even, _mix(whole[band.exact :]) | odd, _mix(less) | odd]
    return np.unique(np.concatenate(keys)).view(np.int64)


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """``SKETCH`` longs: for each bit, whether the set has an odd number of n-grams there."""
    odd = np.bincount((hashes >> np.uint64(7)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _set_hash(hashes: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(blake2b(hashes.tobytes(), digest_size=16).digest(), dtype=np.int64)
    return int(a), int(b)


def _prints(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """``id, mark, n, h1, h2, keys, split, drop0, drop1, sketch`` of every row; keys only with the first of equal sets of a task."""

    def run(batches):
        known: set = set()
        cut = lru_cache(4096)(bands.of)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                for text in part.column(2):
                    hashes = shingle_hashes(text.as_py(), width)
                    name = _set_hash(hashes)
                    if name in known or not len(hashes):
                        rows.append((len(hashes), *name, None, 0, 0, 0, None))
                        continue
                    if len(known) >= KNOWN:
                        known.clear()
                    known.add(name)
                    own = cut(len(hashes))
                    keys = [band_keys(hashes, b) for b, _ in own]
                    drops = [d for _, d in own] + [0, 0]
                    rows.append((len(hashes), *name, np.concatenate([*keys, np.zeros(0, np.int64)]), len(keys[0]) if keys else 0, drops[0], drops[1], parity_sketch(hashes)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["id", "mark", "n", "h1", "h2", "keys", "split", "drop0", "drop1", "sketch"])

    return docs.mapInArrow(run, "id long, mark long, n long, h1 long, h2 long, keys array<long>, split long, drop0 long, drop1 long, sketch array<long>")


def _kept_keys(classes: DataFrame) -> DataFrame:
    """``sid, key, held``: the keys that at least two sets have, without those that a set may leave out."""
    second = F.col("pos") >= F.col("split")
    emitted = classes.where("keys is not null").select("sid", "split", "drop0", "drop1", F.posexplode("keys").alias("pos", "key")).select(
        "sid", "key", second.alias("second"), F.when(second, F.col("drop1")).otherwise(F.col("drop0")).alias("drop")
    )
    counts = emitted.groupBy("key").agg(F.count("*").alias("held")).where("held >= 2")
    met = emitted.join(counts, "key").withColumn("part", F.col("key").bitwiseAND(F.lit(1)) == 0)
    ranked = top_k(met.where("part").withColumn("of", F.struct("sid", "second")), 1 << 40, [F.desc("held"), "key"], "of")
    return ranked.where(F.col("rank") > F.col("drop")).select("sid", "key", "held").unionByName(met.where("not part").select("sid", "key", "held"))


def _may_link(a: str, b: str, percent: int):
    """Sizes and sketches of rows ``a`` and ``b`` (columns n and sketch) leave room for a link."""
    most = f"({a}.n + {b}.n) * {100 - percent}"
    bits = " + ".join(f"bit_count({a}.sketch[{k}] ^ {b}.sketch[{k}])" for k in range(SKETCH))
    return F.expr(f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and ({bits}) * {100 + percent} <= {most}")


def _fetched_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``sid, grams``: the sets of ``wanted`` (``sid, mark, h1, h2``), made again from their texts."""
    few = wanted.limit(MAX_FETCHED + 1).count() <= MAX_FETCHED
    found = docs.join(F.broadcast(wanted) if few else wanted, "mark").select("sid", "h1", "h2", "text")

    def run(batches):
        done: set = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sids, sets = [], []
                for sid, h1, h2, text in zip(*(part.column(k) for k in range(4)), strict=True):
                    if sid.as_py() in done:
                        continue
                    hashes = shingle_hashes(text.as_py(), width)
                    if _set_hash(hashes) == (h1.as_py(), h2.as_py()):
                        if len(done) >= KNOWN:
                            done.clear()
                        done.add(sid.as_py())
                        sids.append(sid.as_py())
                        sets.append(hashes.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["sid", "grams"])

    return found.mapInArrow(run, "sid long, grams array<long>").groupBy("sid").agg(F.first("grams").alias("grams"))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """``src, dst`` of the pairs ``a, b`` that link."""
    pairs = materialize(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    sets = materialize(_fetched_sets(docs, materialize(classes.select("sid", "mark", "h1", "h2").join(ends, "sid"), "wanted"), width), "sets")
    met = pairs.join(sets.select(F.col("sid").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("grams").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y"))
    linked = met.where(100 * same >= percent * (F.size("x") + F.size("y") - same)).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    linked = materialize(linked, "links")
    discard(sets)
    return linked


def _groups(kept: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """``sid, component`` of the sets that link with another."""
    about = classes.select("sid", "n", "sketch")
    kept = materialize(kept, "kept")
    weight = kept.groupBy("sid").agg(F.sum("held").alias("weight"))
    typical = kept.join(weight, "sid").groupBy("key").agg(F.max(F.struct("weight", "sid")).alias("most")).select("key", F.col("most.sid").alias("b"))
    near = kept.join(typical, "key").where("sid <> b").select(F.col("sid").alias("a"), "b").distinct()
    sized = near.join(about.alias("x").select(F.col("sid").alias("a"), F.struct("n", "sketch").alias("x")), "a").join(about.select(F.col("sid").alias("b"), F.struct("n", "sketch").alias("y")), "b")
    first = connected_components(_verified(sized.where(_may_link("x", "y", percent)).select("a", "b"), docs, classes, width, percent))

    labelled = kept.select("sid", "key").join(first.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    apart = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    open_rows = materialize(labelled.join(apart, "key").join(typical, "key").join(about, "sid"), "open")
    main = open_rows.where("sid = b").select("key", F.col("component").alias("main"))
    rows = open_rows.join(main, "key")
    x, y = rows.where("component <> main").alias("x"), rows.alias("y")
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.sid") < F.col("y.sid"))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & once & _may_link("x", "y", percent))
    second = _verified(pairs.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct(), docs, classes, width, percent)

    of = first.union(second.select("src", "src").union(second.select("dst", "dst")).distinct().join(first.select(F.col("node").alias("src")), "src", "left_anti"))
    of = materialize(of.toDF("sid", "component"), "first-groups")
    edges = second.join(of.toDF("src", "from"), "src").join(of.toDF("dst", "to"), "dst").select(F.col("from").alias("src"), F.col("to").alias("dst"))
    merged = connected_components(edges).toDF("component", "merged")
    return of.join(merged, "component", "left").select("sid", F.coalesce("merged", "component").alias("component"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """``id, n_shingles, component_id`` for every row.

    A set holds the distinct n-grams of ``width`` words (runs of anything but ASCII
    white space, A-Z lower-cased); a text of fewer words is one n-gram.  Two rows
    link if ``100 * intersection >= percent * union``; the component is the smallest
    id that links reach.

    Null, empty and blank texts have no n-grams and link with nothing.  Null ids
    stay and name a component only if it has no other id; repeated rows stay; an
    empty table gives an empty result; further columns are ignored.  n-grams are
    compared by 64-bit hashes and sets, for equality, by 128-bit hashes.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("mark"), F.col(f"`{text_col}`").cast("string").alias("text"))
    prints = materialize(_prints(docs, width, Bands(percent, docs.count())), "set-prints")
    some = [F.first(c, ignorenulls=True).alias(c) for c in ("keys", "sketch")]
    grouped = prints.where("n > 0").groupBy("h1", "h2").agg(
        F.min("id").alias("low"), F.count("*").alias("copies"), F.max("n").alias("n"), F.min("mark").alias("mark"), *[F.max(c).alias(c) for c in ("split", "drop0", "drop1")], *some
    )
    classes = materialize(grouped.withColumn("sid", F.monotonically_increasing_id()), "set-classes")
    groups = materialize(_groups(_kept_keys(classes), docs, classes, width, percent), "set-groups")
    joined = classes.select("sid", "h1", "h2", "low", "copies").join(groups, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    lowest = groups.join(classes.select("sid", "low"), "sid").groupBy("component").agg(F.min("low").alias("least"))
    of_set = materialize(joined.join(lowest, "component", "left").select("h1", "h2", "copies", F.when(F.col("least").isNull(), F.col("low")).otherwise(F.col("least")).alias("component_id")), "of-set")
    rows = prints.select("id", "n", "h1", "h2")
    # fewer than HOT sets can have more than a HOT-th of the rows: theirs go to every task, so no key of the shuffle is hot
    hot = F.broadcast(of_set.where(F.col("copies") > prints.count() / HOT).select("h1", "h2", "component_id"))
    some_rows = rows.where("n > 0")
    rest = some_rows.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(of_set.select("h1", "h2", "component_id"), ["h1", "h2"])
    alone = rows.where("n = 0").withColumn("component_id", F.col("id"))
    out = some_rows.join(hot, ["h1", "h2"]).unionByName(rest).unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")

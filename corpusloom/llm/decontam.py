"""Benchmark decontamination: rare gapped three-word seeds, then Smith-Waterman alignment.

Three words of an item, each one or two words after the one before, are a seed of the
middle one; in a document each may come up to three words after the one before.  How
many middles an alignment of a given score must hold follows from its edits
(``least_seeds``): a document that holds ``c`` of an item's ``s`` middles holds one of
its ``s - c + 1`` rarest.  One pass counts middles over all documents and sets aside
those with enough seeds of an item; these meet the items by their rare seeds and are
aligned, and what is found does not depend on how common a passage is.  Items go to
the tasks in blocks of bounded size; each document is read once for each block.

Items of five and six words meet documents by any two of their words in reach of each
other, shorter ones by their words in a row, which must be the same.  In scripts that
put no space between words every character is a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize

#: Items of fewer words have seeds of two words, of still fewer must be held word for word.
SEEDED_WORDS, ALIGNED_WORDS = 7, 5
#: Words from one word of a seed to the next, in an item and in a document; of a seed of two words.
ITEM_STEPS, TEXT_STEPS, PAIR_STEPS = (1, 2), (1, 2, 3), (1, 2)
#: Least share of the best possible alignment score of an item.
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of each of the two filters.
FILTER_BITS = 1 << 23
#: Item words that go to the tasks at once, and document words that are searched at once.
BLOCK_WORDS, TEXT_WORDS = 500_000, 200_000
#: Words of passages whose alignments a task remembers, so that equal ones are aligned once.
KNOWN_WORDS = 200_000
#: Texts with a copy whose hashes are sent to the documents; more are joined.
MAX_SENT = 1_000_000
#: Words whose hashes a task remembers.
KNOWN_HASHES = 60_000
#: No word has this hash; three stand between texts, so that no seed spans two.
_BREAK = 1 << 33
_WORD = re.compile(r"[^\W_]+")
#: Blocks of scripts without spaces (fixed values): Thai and Lao, Tibetan, Myanmar, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f"
_SOME_UNSPACED = re.compile(f"[{_UNSPACED}]")
_ANY_WORD = re.compile(f"[{_UNSPACED}]|[^\\W_{_UNSPACED}]+")
_PRIME = 0x9E3779B97F4A7C15
#: In place of the further words of a seed of two words, and of one.
_TWO, _ONE = np.uint64((1 << 34) + 2), np.uint64((1 << 34) + 1)


class _Hashes(dict):
    """32-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_HASHES:
            self.clear()
        found = self[word] = crc32(word.encode("utf-8", "surrogatepass"))
        return found


_hash_of = _Hashes().__getitem__


def word_hashes(text: str | None) -> np.ndarray:
    """A 32-bit hash of each word, without case and punctuation; characters of scripts without spaces are words."""
    low = (text or "").lower()
    words = (_WORD if low.isascii() or not _SOME_UNSPACED.search(low) else _ANY_WORD).findall(low)
    return np.fromiter(map(_hash_of, words), dtype=np.int64, count=len(words))


def least_seeds(n: int, threshold: float) -> int:
    """So many seeds, with distinct middle words, are in every alignment of an item of ``n`` words from ``threshold`` on.

    With M matched words and E edits the score is 2 M - E at most, so E <= 2 M - 2 n threshold.
    Every three matched words in a row are a seed, unless one of the two gaps between them has two
    words of the item (of which there are n - M) or three words of the text; such a gap takes
    two or three edits and spoils two seeds.
    """
    least = n
    for matched in range(1, n + 1):
        edits = int(np.floor(2 * matched - 2 * n * threshold + 1e-9))
        if edits >= 0:
            gaps = min((n - matched) // 2, edits // 2)
            least = min(least, matched - 2 - 2 * (gaps + (edits - 2 * gaps) // 3))
    return max(1, least)


def _mix(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = (hashes ^ words) * np.uint64(_PRIME)
    return out ^ (out >> np.uint64(29))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(41)).astype(np.int64)  # 23 bits


def alignment(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of the words ``a`` of an item in ``b``: score, first and last (exclusive) word of ``b``.

    Gaps cost the same per word, so a row's running maximum settles its gaps.
    """
    ramp = np.arange(len(b) + 1, dtype=np.int64) * GAP
    row, begin = np.zeros(len(b) + 1, dtype=np.int64), np.arange(len(b) + 1)
    best = (0, 0, 0)
    for word in a:
        diagonal = row[:-1] + np.where(b == word, MATCH, MISMATCH)
        above = row[1:] + GAP
        take = diagonal >= above
        fresh = np.concatenate([[0], np.maximum(np.where(take, diagonal, above), 0)])
        start = np.concatenate([[0], np.where(take, begin[:-1], begin[1:])])
        start = np.where(fresh > 0, start, np.arange(len(b) + 1))
        lifted = fresh - ramp
        high = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == high, np.arange(len(b) + 1), 0))
        new = high + ramp
        row, begin = np.maximum(new, 0), np.where(new > 0, start[source], np.arange(len(b) + 1))
        top = int(row.argmax())
        if row[top] > best[0]:
            best = (int(row[top]), int(begin[top]), top)
    return best


class SeedIndex:
    """The seeds of some items, and the search for passages that hold enough of them.

    An entry is a seed with its item and its middle there; middles are numbered over
    all items.  ``rare`` says of each entry whether its middle is one that documents
    are looked up by.
    """

    def __init__(self, item_words: list[np.ndarray], threshold: float):
        self.items = item_words
        sizes = np.array([len(w) for w in item_words], dtype=np.int64)
        self.least = np.array([least_seeds(n, threshold) if n >= SEEDED_WORDS else 1 for n in sizes], dtype=np.int64)
        # no alignment from the threshold on is longer
        self.window = np.array([np.ceil((3 - 2 * threshold) * n) for n in sizes], dtype=np.int64)
        self.begin = np.cumsum(sizes) - sizes
        pairs, seeds, owners, middles = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def enter(hashes: np.ndarray, k: int, first: int) -> None:
            seeds.append(hashes)
            owners.append(np.full(len(hashes), k, np.int64))
            middles.append(self.begin[k] + first + np.arange(len(hashes)))

        for k, words in enumerate(item_words):
            w = words.astype(np.uint64)
            if len(w) == 1:
                enter(_mix(w * np.uint64(_PRIME), _ONE), k, 0)
            for a in ITEM_STEPS if len(w) > 1 else ():
                pair = _mix(w[:-a] * np.uint64(_PRIME), w[a:])
                if len(w) < SEEDED_WORDS:
                    enter(_mix(pair, _TWO), k, 0)
                    continue
                pairs.append(pair)
                for b in ITEM_STEPS:
                    enter(_mix(pair[: max(0, len(w) - a - b)], w[a + b :]), k, a)
        self.single, self.paired, self.seeded = (bool(((low <= sizes) & (sizes < high)).any()) for low, high in ((1, 2), (2, SEEDED_WORDS), (SEEDED_WORDS, 1 << 62)))
        seeds, owners, middles = np.concatenate(seeds), np.concatenate(owners), np.concatenate(middles)
        order = np.lexsort((middles, seeds))
        seeds, owners, middles = seeds[order], owners[order], middles[order]
        first = np.ones(len(seeds), bool)
        first[1:] = (seeds[1:] != seeds[:-1]) | (middles[1:] != middles[:-1])
        self.seeds, self.at, self.count = np.unique(seeds[first], return_index=True, return_counts=True)
        self.owners, self.middles = owners[first], middles[first]
        self.rare = np.ones(len(self.owners), bool)
        self.pair_bits, self.seed_bits = np.zeros(FILTER_BITS, bool), np.zeros(FILTER_BITS, bool)
        self.pair_bits[_slots(np.concatenate(pairs))] = True
        self.seed_bits[_slots(self.seeds)] = True

    def __getstate__(self):
        return self.__dict__ | {"pair_bits": np.packbits(self.pair_bits), "seed_bits": np.packbits(self.seed_bits)}

    def __setstate__(self, state):
        self.__dict__ |= state | {k: np.unpackbits(state[k]).astype(bool) for k in ("pair_bits", "seed_bits")}

    def rare_entries(self, counts: dict[int, int]) -> np.ndarray:
        """Which entries have one of the rarest middles of their item: so many that a document with enough middles holds one."""
        has = np.unique(self.middles)
        item = np.searchsorted(self.begin, has, "right") - 1
        times = np.array([counts.get(int(m), 0) for m in has], dtype=np.int64)
        order = np.lexsort((has, times, item))
        place = np.arange(len(has)) - np.searchsorted(item[order], item[order], "left")
        held = np.bincount(item, minlength=len(self.items))
        kept = np.zeros(len(has), bool)
        kept[order] = place < (held - self.least + 1)[item[order]]
        return kept[np.searchsorted(has, self.middles)] if len(has) else self.rare

    def _entries(self, seed: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of each of the hashes ``seed``, and the words ``at`` which they stand."""
        passed = self.seed_bits[_slots(seed)]
        seed, at = seed[passed], at[passed]
        place = np.minimum(np.searchsorted(self.seeds, seed), len(self.seeds) - 1)
        same = self.seeds[place] == seed
        at, place = at[same], place[same]
        count = self.count[place]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(self.at[place], count) + nth, np.repeat(at, count)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and middle word of every seed in ``words``."""
        w = words.astype(np.uint64)
        scaled = w * np.uint64(_PRIME)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if not len(self.seeds):
            return found[0]
        if self.single:
            found.append(self._entries(_mix(scaled, _ONE), np.arange(len(w))))
        for a in TEXT_STEPS if self.paired or self.seeded else ():
            pair = _mix(scaled[:-a], w[a:])
            if self.paired and a in PAIR_STEPS:
                found.append(self._entries(_mix(pair, _TWO), np.arange(len(pair))))
            some = np.flatnonzero(self.pair_bits[_slots(pair)]) if self.seeded else np.zeros(0, np.int64)
            for b in TEXT_STEPS if len(some) else ():
                start = some[some < len(w) - a - b]
                found.append(self._entries(_mix(pair[start], w[start + a + b]), start + a))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def hits_of(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, entry and middle word (over all texts) of the hits, and where each text begins."""
        gap = np.full(3, _BREAK, np.int64)
        begins = np.cumsum([0, *(len(t) + 3 for t in texts)])
        entry, at = self.hits(np.concatenate([x for t in texts for x in (t, gap)]))
        return np.searchsorted(begins, at, "right") - 1, entry, at, begins

    def held_middles(self, hits: tuple) -> np.ndarray:
        """The middles that texts with these hits hold, each as often as there are texts that do."""
        text, entry, _, _ = hits
        both = np.unique(np.stack([text, self.middles[entry]]), axis=1) if len(text) else np.zeros((2, 0), np.int64)
        return both[1]

    def passages(self, texts: list[np.ndarray], hits: tuple | None = None):
        """``text, item, first, end``: every passage that may hold an alignment of the item."""
        text, entry, at, begins = hits or self.hits_of(texts)
        if not len(entry):
            return
        item = self.owners[entry]
        # a text without a rare seed of an item is no copy of it
        looked = np.unique(text[self.rare[entry]] * len(self.items) + item[self.rare[entry]])
        able = np.isin(text * len(self.items) + item, looked)
        item, at = np.unique(np.stack([item[able], at[able]]), axis=1)
        if not len(item):
            return
        text = np.searchsorted(begins, at, "right") - 1
        last = np.arange(len(item)) + self.least[item] - 1
        here = np.flatnonzero(last < len(item))
        to = last[here]
        here = here[(item[to] == item[here]) & (text[to] == text[here]) & (at[to] - at[here] <= self.window[item[here]])]
        edge = np.zeros(len(item) + 1, np.int64)
        np.add.at(edge, here, 1)
        np.add.at(edge, last[here] + 1, -1)
        dense = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        if not len(dense):
            return
        item, at, text = item[dense], at[dense], text[dense]
        cut = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (at[1:] - at[:-1] > self.window[item[1:]])
        for group in np.split(np.arange(len(item)), np.flatnonzero(cut) + 1):
            k, t = int(item[group[0]]), int(text[group[0]])
            size, begin = int(self.window[k]), int(begins[t])
            yield t, k, max(0, int(at[group[0]]) - begin - size), min(len(texts[t]), int(at[group[-1]]) - begin + size + 1)


def _item_words(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            words = [word_hashes(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64()))], ["item_id", "item_words"])

    picked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "item_id long, item_words array<long>").where("size(item_words) > 0")


def _blocks(docs: DataFrame, items: DataFrame, id_col: str | None, text_col: str, item_col: str, item_text_col: str, threshold: float):
    """For every block of items: a broadcast :class:`SeedIndex` with its rare entries, its item ids, and the documents
    ``id, text`` that hold enough seeds of an item in reach, be they rare or not."""
    spark = items.sparkSession
    item_words = materialize(_item_words(items, item_col, item_text_col), "items")
    blocks = -(-(item_words.agg(F.sum(F.size("item_words"))).first()[0] or 0) // BLOCK_WORDS) or 1
    block = F.pmod(F.xxhash64("item_id", "item_words"), F.lit(blocks))
    for k in range(blocks):
        rows = item_words.where(block == k).collect()  # about BLOCK_WORDS words
        index = SeedIndex([np.array(r.item_words, dtype=np.int64) for r in rows], threshold)
        met = materialize(_met(docs, spark.sparkContext.broadcast(index), id_col, text_col), "met")
        counts = met.where("middle is not null").groupBy("middle").agg(F.sum("n").alias("n")).collect()  # a number for each of these words at most
        index.rare = index.rare_entries({r.middle: r.n for r in counts})
        yield spark.sparkContext.broadcast((index, [r.item_id for r in rows])), met.where("middle is null").select("id", "text")


def _met(docs: DataFrame, sent: Broadcast, id_col: str | None, text_col: str) -> DataFrame:
    """One pass over the documents: ``middle, n``, how many of a task's documents hold each middle, and ``id, text`` of those with enough seeds."""

    def run(batches):
        index = sent.value
        total = np.zeros(sum(map(len, index.items)), dtype=np.int64)
        names = ["middle", "n", "id", "text"]
        for batch in batches:
            enough = np.zeros(batch.num_rows, bool)
            for begin, texts in _hashed(batch.column(1)):
                hits = index.hits_of(texts)
                total += np.bincount(index.held_middles(hits), minlength=len(total))
                enough[[begin + t for t, *_ in index.passages(texts, hits)]] = True
            some = batch.filter(pa.array(enough))
            nothing = pa.nulls(some.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, nothing, some.column(0), some.column(1)], names)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64()), pa.nulls(len(held), pa.int64()), pa.nulls(len(held), pa.string())], names)

    name = F.col(f"`{id_col}`").cast("long") if id_col else F.lit(None).cast("long")
    return docs.select(name.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "middle long, n long, id long, text string")


def _alignments(index: SeedIndex, texts: list[np.ndarray], threshold: float, known: dict):
    """``text, item, share of the score, first, end`` of the passages from ``threshold`` on; short items whole."""
    for t, k, first, end in index.passages(texts):
        passage = texts[t][first:end]
        key = k, passage.tobytes()
        if key not in known:
            if known.get("words", 0) + len(passage) > KNOWN_WORDS:
                known.clear()
            known["words"] = known.get("words", 0) + len(passage)
            known[key] = alignment(index.items[k], passage)
        score, start, last = known[key]
        share = score / (MATCH * len(index.items[k]))
        if share >= (threshold if len(index.items[k]) >= ALIGNED_WORDS else 1):
            yield t, k, share, first + start, first + last


def _hashed(column) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Word hashes of the texts of an Arrow column, about TEXT_WORDS words at once, and where each part begins."""
    texts, held, begin = [], 0, 0
    for text in column:
        texts.append(word_hashes(text.as_py()))
        held += len(texts[-1])
        if held >= TEXT_WORDS:
            yield begin, texts
            begin, texts, held = begin + len(texts), [], 0
    if texts:
        yield begin, texts


def _scored(met: DataFrame, sent: Broadcast, threshold: float) -> DataFrame:
    """``id, item_id, score, first, last, text`` of the alignments of ``met`` (``id, text``) with the items of one block."""

    def run(batches):
        index, names = sent.value
        kinds = {"id": pa.int64(), "item_id": pa.int64(), "score": pa.float64(), "first": pa.int64(), "last": pa.int64(), "a": pa.int64(), "b": pa.int64()}
        known: dict = {}
        for batch in batches:
            ids, keys, rows = batch.column(0).to_pylist(), [c.to_pylist() for c in batch.columns[2:4]], []
            for begin, texts in _hashed(batch.column(1)):
                rows += [(ids[begin + t], names[k], *rest, keys[0][begin + t], keys[1][begin + t]) for t, k, *rest in _alignments(index, texts, threshold, known)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], list(kinds))

    return met.select("id", "text", *_text_keys(F.col("text"))).mapInArrow(run, "id long, item_id long, score double, first long, last long, a long, b long")


def _text_keys(text: Column) -> list[Column]:
    """Two hashes that say which text it is."""
    return [F.xxhash64(text).alias("a"), F.xxhash64(F.lit("again"), text).alias("b")]


def contaminated_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id, item_id, score, start_word, end_word`` of the best alignment of each document and item.

    ``score`` is the Smith-Waterman score over words (2 for a match, -1 for a
    mismatch or gap) as a share of the score of a verbatim copy; rows from
    ``threshold`` (0.5 or more) on are returned, all of them; an item of fewer than
    five words must be held word for word.  In scripts without spaces words are
    characters.  Null and empty texts and items give no row.  Rows of null ids count as one document and repeated rows as one;
    an empty table on either side gives an empty result; further columns are ignored.
    """
    parts = [_scored(met, sent, threshold) for sent, met in _blocks(docs, items, id_col, text_col, item_col, item_text_col, threshold)]
    case = F.struct("score", (-F.col("first")).alias("start"), F.col("last").alias("end"))
    best = reduce(DataFrame.unionByName, parts).groupBy("id", "item_id").agg(F.max(case).alias("case"))
    return best.select(
        F.col("id").alias(id_col), "item_id", F.col("case.score").alias("score"), (-F.col("case.start")).alias("start_word"), F.col("case.end").alias("end_word")
    )


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no copy of an item; all columns stay.

    Every text is judged, whatever ids there are, and equal texts alike: the texts that
    hold an item go by two hashes, which are sent to the documents, or joined where
    they are more than ``MAX_SENT``.  Null and empty texts stay; an empty table on
    either side drops nothing.
    """
    parts = [_scored(met, sent, threshold).select("a", "b") for sent, met in _blocks(docs, items, None, text_col, item_col, item_text_col, threshold)]
    bad = materialize(reduce(DataFrame.unionByName, parts).distinct(), "copies").toDF("__a", "__b")
    few = bad.limit(MAX_SENT + 1).count() <= MAX_SENT
    a, b = _text_keys(F.col(f"`{text_col}`").cast("string"))
    return docs.join(F.broadcast(bad) if few else bad, (a == F.col("__a")) & (b == F.col("__b")), "left_anti")

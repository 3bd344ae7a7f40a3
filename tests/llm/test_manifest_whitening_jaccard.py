"""Merkle manifests, whitening and the n-gram Jaccard join against plain versions."""

from __future__ import annotations

import math
import os
import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import duckdb
import numpy as np
import pytest

from corpusloom.llm import jaccard, merkle, queries, whitening
from tests.llm.test_operators import SCHEMA, WORDS, awkward, empty, prose, table

# -- 11


def h(*parts):
    return sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def leaf_of(row, newlines=True):
    values = [row[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    if not newlines and values[4] is not None:
        values[4] = values[4].replace("\n", "")
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """Levels of a tree, from the leaves to one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        by[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[name] = climb([leaf_of(r) for r in by[name]])
    upper = climb([trees[n][-1][0] for n in names])
    out = []
    for place, name in enumerate(names):
        for at, r in enumerate(by[name]):
            flagged = r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 2 == 0
            now, siblings = leaf_of(r, newlines=not flagged), []
            for levels, k in ((trees[name], at), (upper, place)):
                for nodes in levels[:-1]:
                    first = k - k % 3
                    left, right = nodes[first:k], nodes[k + 1 : first + 3]
                    siblings += left + right
                    now, k = h(*left, now, *right), k // 3
            out.append((r["doc_id"], leaf_of(r), trees[name][-1][0], upper[-1][0], h(*siblings), now, now == upper[-1][0]))
    return sorted(out, key=repr)


def manifest_rows(spark, n, seed=1):
    draw = random.Random(seed)
    rows = [(draw.choice([None, k, 5]) if k % 9 == 0 else k, draw.choice([None, "", "é\n", *[prose(draw, 5) + "\n" + prose(draw, 3)] * 5]), draw.choice([None, "de"]), draw.choice(["hot"] * 9 + ["a", "b", None, "", "é", "one" + str(k)]), draw.choice([None, 7])) for k in range(n)]
    return spark.createDataFrame([(*r, "x", "y", "z", "r") for r in rows + rows[:3]], SCHEMA)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_is_that_of_a_plain_tree(spark, levels):
    df = manifest_rows(spark, 150)
    found = merkle.merkle_manifest(df, levels=levels).collect()
    assert sorted([tuple(r) for r in found], key=repr) == plain_manifest([r.asDict() for r in df.collect()])
    assert not all(r.verified for r in found) and any(r.verified for r in found)


def test_manifest_of_awkward_tables(spark):
    df = awkward(spark)
    assert sorted([tuple(r) for r in merkle.merkle_manifest(df).collect()], key=repr) == plain_manifest([r.asDict() for r in df.collect()])
    assert merkle.merkle_manifest(empty(spark)).count() == 0
    one = merkle.merkle_manifest(table(spark, ["a\nb"], start=2)).first()
    assert one.root == one.leaf == one.subroot and one.proof_sha256 == h()


def test_a_version_copies_only_its_path():
    leaves = [str(k).encode() for k in range(30)]
    tree = merkle.BlockTree(leaves, 7, whole=False)
    before = [list(level) for level in tree.levels]
    path = merkle.copied_path(b"new", tree.siblings(17))
    assert len(path) == len(tree.levels) and tree.levels == before
    assert path[-1] == merkle.BlockTree([*leaves[:17], b"new", *leaves[18:]], 7, whole=False).top


# -- 12


def vectors_of(spark, rows):
    return spark.createDataFrame([(k, v, 1.0, "n") for k, v in rows], "vec_id long, embedding array<float>, x double, component string")


def test_whitening_is_that_of_numpy(spark):
    draw = np.random.default_rng(3)
    x = (draw.normal(size=(400, 12)) @ draw.normal(size=(12, 12)) + 3).astype(np.float32)
    rows = [(k, [float(e) for e in v]) for k, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [1.0] * 5), (903, [math.nan] + [1.0] * 11), (904, [None] + [1.0] * 11), (905, [math.inf] * 12), (None, rows[0][1]), (7, rows[7][1])]
    found = whitening.whiten(vectors_of(spark, rows + odd)).toPandas()
    whole = np.vstack([x, x[:1], x[7:8]]).astype(np.float64)
    grid = np.floor(64 * whole).astype(np.int64) + 1_000_000
    n, s = len(grid), grid.sum(axis=0)
    assert len(found) == n * 12 and set(found.n) == {n} and found.component.max() == 12
    deviation = [int(v) for v in ((n * grid - s).astype(object) ** 2).sum(axis=1)]
    ones = found[found.component == 1].sort_values("deviation")
    assert list(ones.deviation) == sorted(deviation) == [int(v) for v in ones.deviation_exact]
    centred = grid - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    for c in (1, 5, 12):
        ours = found[(found.component == c) & found.vec_id.between(0, 399) & (found.vec_id != 7)].sort_values("vec_id")
        theirs = np.delete(centred[:400], 7, axis=0) @ axes[:, -c] / np.sqrt(values[-c])
        assert min(np.abs(ours.whitened - theirs).max(), np.abs(ours.whitened + theirs).max()) < 1e-7
        assert abs(ours.explained.iloc[0] - values[-c] / values.sum()) < 1e-9
    assert found.identity_error.max() < 1e-9


def test_polarisation_gives_the_covariances_exactly():
    draw = np.random.default_rng(4)
    x = draw.integers(-50, 50, (30, 5)) + 10**6
    n, s = len(x), x.sum(axis=0)
    z = n * x - s
    squares = {(i, j): int(((z[:, i] + (z[:, j] if i != j else 0)) ** 2).sum()) for i in range(5) for j in range(i, 5)}
    assert np.allclose(whitening.covariance(n, [int(v) for v in s], squares), np.cov(x.T, bias=True), rtol=1e-14)


def test_awkward_vectors(spark):
    none = vectors_of(spark, [])
    assert whitening.whiten(none).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(k, [1.0, 2.0]) for k in range(9)])).count() == 0
    flat = whitening.whiten(vectors_of(spark, [(k, [float(k), 2.0, float(k)]) for k in range(9)])).toPandas()
    assert set(flat.component) == {1} and flat.identity_error.max() < 1e-9 and abs(flat.explained.iloc[0] - 1) < 1e-9
    huge = whitening.whiten(vectors_of(spark, [(k, [float(k) * 1e30, float(-k * k)]) for k in range(5)])).toPandas()
    assert huge.deviation.isna().all() and huge.identity_error.max() < 1e-6


# -- 13


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()


def plain_components(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                group[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted([(i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(rows)], key=repr)


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        at = draw.randrange(len(words))
        kind = draw.random()
        if kind < 0.4:
            words[at] = draw.choice(WORDS)
        elif kind < 0.7:
            words.insert(at, draw.choice(WORDS))
        elif len(words) > 3:
            del words[at]
    return words


def near_copies(seed):
    """Families at and around the threshold, of many lengths, and texts that share a passage."""
    draw = random.Random(seed)
    texts = []
    for n in (6, 9, 10, 11, 12, 14, 15, 16, 20, 23, 24, 30, 40, 60, 90, 150, 300, 700):
        base = [draw.choice(WORDS) for _ in range(n)]
        texts += [" ".join(edited(draw, base, k)) for k in (0, 0, 1, 1, 1, 2, 3, n // 40, n // 30, n // 20)]
        texts += [" ".join(base[: n - k]) for k in (1, n // 20, n // 12, n // 10)]
    passage = [draw.choice(WORDS) for _ in range(60)]
    texts += [" ".join(passage + [draw.choice(WORDS) for _ in range(draw.randrange(3, 60))]) for _ in range(25)]
    return texts


@pytest.mark.parametrize("percent", [90, 80])
def test_components_are_those_of_all_pairs(spark, percent):
    texts = near_copies(percent)
    found = jaccard.jaccard_components(table(spark, texts), percent=percent)
    rows = sorted([tuple(r) for r in found.collect()], key=repr)
    assert rows == plain_components(list(enumerate(texts)), percent)
    assert len({r[2] for r in rows}) < len(texts) - 60


def test_large_group_of_near_copies(spark):
    draw = random.Random(5)
    base = [draw.choice(WORDS) for _ in range(200)]
    texts = [" ".join(edited(draw, base, draw.choice([1, 2, 3, 4, 5, 6]))) for _ in range(250)] + ["x " + " ".join(base)] * 40
    found = jaccard.jaccard_components(table(spark, texts)).collect()
    assert sorted([tuple(r) for r in found], key=repr) == plain_components(list(enumerate(texts)))


def test_awkward_sets(spark):
    df = awkward(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted([tuple(r) for r in jaccard.jaccard_components(df).collect()], key=repr) == plain_components(rows)
    assert jaccard.jaccard_components(empty(spark)).count() == 0
    small = table(spark, ["A b", "a  B", "a b c", "a b d", ""])
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(small).collect()} == {(0, 1, 0), (1, 1, 0), (2, 1, 2), (3, 1, 3), (4, 0, 4)}


@pytest.mark.parametrize("rows", [10**3, 10**12])
def test_every_allocation_lets_linked_sets_meet(rows):
    """Linked sets share a key that neither may leave out, whatever the frequencies of keys."""
    draw, bands = random.Random(rows), jaccard.Bands(90, rows)
    kinds = set()
    for _ in range(1500):
        n = draw.choice([9, 10, 12, 15, 16, 22, 23, 24, 40, 80, 200, 500])
        a = {draw.getrandbits(64) for _ in range(n)}
        most = bands.most(n, n)
        lost = draw.randrange(min(n, most + 1))
        b = set(list(a)[lost:]) | {draw.getrandbits(64) for _ in range(draw.randrange(most - lost + 1))}
        if 100 * len(a & b) < 90 * len(a | b):
            continue
        held = {}
        left = []
        for s in (a, b):
            hashes = np.sort(np.array(list(s), dtype=np.uint64))
            keys = set()
            for band, drop in bands.of(len(s)):
                kinds.add(band.deleted > 0)
                own = [int(k) for k in jaccard.band_keys(hashes, band)]
                parts = sorted((k for k in own if k % 2 == 0), key=lambda k: held.setdefault(k, draw.random()))
                keys |= set(parts[drop:]) | {k for k in own if k % 2}
            left.append(keys)
        assert left[0] & left[1]
        sketches = [jaccard.parity_sketch(np.array(list(s), dtype=np.uint64)).view(np.uint8) for s in (a, b)]
        assert int(np.unpackbits(sketches[0] ^ sketches[1]).sum()) <= len(a ^ b)
    assert kinds == ({False} if rows == 10**3 else {False, True})


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_queries_on_the_smallest_tables(spark):
    docs = duckdb.sql(f"SELECT doc_id, source, lang, n_chars, text FROM '{SF}/documents.parquet'").fetchall()
    rows = [dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r, strict=True)) for r in docs]
    assert sorted([tuple(r) for r in queries.op11_merkle(spark, SF).collect()], key=repr) == plain_manifest(rows)
    assert sorted([tuple(r) for r in queries.op13_jaccard(spark, SF).collect()], key=repr) == plain_components([(r[0], r[4]) for r in docs])
    white = queries.op12_whitening(spark, SF).toPandas()
    assert white.identity_error.max() < 1e-4 and white.component.max() == 32

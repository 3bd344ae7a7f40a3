"""Stored indexes that change, block-max search, quantised vectors, anchors, quotes, phrases and hierarchies against plain versions."""

from __future__ import annotations

import os
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import anchors, blockmax, bm25, chunking, dense, fusion, knowledge, phrases, quantized, quotes, segments, stats, tenancy
from corpusloom.operators import text as T
from corpusloom.queries.structures import QUERIES as structure_queries
from corpusloom.queries.texts import QUERIES as texts_queries
from corpusloom.session import materialize, scratch, state_of
from corpusloom.streaming import ingest, usage

WORDS = [a + b for a in ("ba", "ko", "mi", "tu", "re", "sa", "lo") for b in ("lon", "ri", "mus", "", "dent", "ve")]


def texts(seed, n, low=1, high=60):
    draw = random.Random(seed)
    return [" ".join(draw.choice(WORDS[: draw.choice((3, 10, 42))]) for _ in range(draw.randint(low, high))) for _ in range(n)]


def chunk_table(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, doc_id long, text string")


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-"))


# -- segments


def same_index(spark, stored, rows):
    """The stored index against a new one of ``rows``."""
    fresh, now = bm25.build_index(chunk_table(spark, rows)), stored.index()
    for table in ("postings", "lengths", "terms"):
        columns = getattr(fresh, table).columns
        ours, theirs = ([tuple(r) for r in getattr(i, table).select(*columns).collect()] for i in (now, fresh))
        assert sorted(ours) == sorted(theirs)
    asked = spark.createDataFrame([(0, "balon kori xx"), (1, "mimus mimus ba"), (2, "")], "query_id long, query string")
    assert bm25.bm25_topk(now, asked).collect() == bm25.bm25_topk(fresh, asked).collect()
    n, tokens = fresh.lengths.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    assert (stored.n_chunks, stored.n_tokens) == (n, tokens)


def test_an_index_that_changes_is_that_of_what_is_left(spark, tmp_path):
    rows = [(k, k // 3, t) for k, t in enumerate(texts(1, 90))]
    path = f"{tmp_path}/i"
    stored = segments.create(spark, path)
    same_index(spark, stored, [])
    stored = segments.add(stored, chunk_table(spark, rows[:60]))
    stored = segments.remove_chunks(stored, chunk_table(spark, rows[5:8] + [(999, 1, "no such")]))
    same_index(spark, stored, rows[:5] + rows[8:60])
    before = stored
    # a removed chunk comes again with another text, one that is there does not change, an empty one is no chunk
    again = [(6, 2, "kori kori new")]
    stored = segments.add(stored, chunk_table(spark, again + [(0, 0, "other"), (700, 7, ""), (701, 7, None), (None, 7, "lost")] + rows[60:]))
    left = rows[:5] + rows[8:60] + again + rows[60:]
    same_index(spark, stored, left)
    stored = segments.remove_documents(stored, chunk_table(spark, rows[6:9] + [(0, 29, "")]))
    left = [r for r in left if r[1] not in (2, 29)]
    same_index(spark, stored, left)
    grown = size_of(path)
    one = segments.add(stored, chunk_table(spark, [(800, 80, "balon")]))
    assert size_of(path) - grown < 8000  # four small tables, whatever is there already
    with pytest.raises(Exception, match="(?i)exists"):
        segments.add(before, chunk_table(spark, [(900, 90, "late")]))  # another writer was first
    merged = segments.merge(one)
    same_index(spark, merged, [*left, (800, 80, "balon")])
    assert len(merged.entries) == 1 and segments.purge(merged) == len(one.entries) + 1  # with what the late writer has left
    same_index(spark, segments.open_index(spark, path), [*left, (800, 80, "balon")])
    assert segments.add(merged, chunk_table(spark, left)).version == merged.version  # nothing new, no version


def test_many_changes_merge_by_themselves(spark, tmp_path):
    stored = segments.create(spark, f"{tmp_path}/i")
    for k in range(5):
        stored = segments.add(stored, chunk_table(spark, [(k, k, f"word{k} same")]), most=3)
    assert len(stored.entries) <= 3 and stored.n_chunks == 5
    gone = segments.remove_documents(stored, chunk_table(spark, [(0, k, "") for k in range(5)]), most=3)
    assert gone.n_chunks == 0 and gone.index().terms.count() == 0


# -- block-max


@pytest.mark.parametrize("seed", [1, 2])
def test_blockmax_gives_the_rows_of_a_full_search(spark, seed):
    draw = random.Random(seed)
    rare = [f"rare{k}" for k in range(300)]
    rows = [(k, k, t + " " + " ".join(draw.choice(rare) for _ in range(3))) for k, t in enumerate(texts(seed, 700, 3, 50))]
    asked = [(q, " ".join(draw.choice(rare + WORDS * 4) for _ in range(n))) for q, n in enumerate([1, 2, 3, 5, 8, 12, 20, 40])] + [(50, None), (51, ""), (52, "balon"), (53, "unknown words")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    index = bm25.build_index(chunk_table(spark, rows))
    counts: dict = {}
    for k in (1, 10):
        found = blockmax.blockmax_topk(blockmax.build_blocks(index), queries, k, counts=counts).collect()
        assert sorted(map(tuple, found)) == sorted(map(tuple, bm25.bm25_topk(index, queries, k).collect()))
        assert 0 < counts["read"] <= counts["all"]


def test_blockmax_leaves_common_lists_alone(spark):
    draw = random.Random(7)
    common = [f"common{k}" for k in range(6)]
    rows = [(k, k, " ".join([c for c in common if draw.random() < 0.45] + [f"rare{k % 150}"] * draw.randint(1, 3))) for k in range(6000)]
    index = bm25.build_index(chunk_table(spark, rows))
    queries = spark.createDataFrame([(q, f"rare{q} rare{q + 1} " + " ".join(common)) for q in range(20)], "query_id long, query string")
    counts: dict = {}
    found = blockmax.blockmax_topk(blockmax.build_blocks(index), queries, 5, counts=counts).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, bm25.bm25_topk(index, queries, 5).collect()))
    assert counts["read"] < 0.5 * counts["all"]


def test_blockmax_shards_are_made_and_searched_without_a_row_for_a_posting(spark, monkeypatch):
    """The index is not shuffled to make blocks; small shards, ties at the last rank, names for ids and several blocks of queries give the same rows."""
    plans = []
    monkeypatch.setattr(blockmax, "materialize", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or materialize(df, label))
    rows = [(f"c{k}", t) for k, t in enumerate(texts(5, 300) + ["balon kori"] * 40 + texts(6, 60, 200, 300))]
    index = bm25.build_index(spark.createDataFrame(rows, "chunk_id string, text string").repartition(3))
    queries = spark.createDataFrame([(f"q{k}", t) for k, t in enumerate([*texts(7, 12, 1, 30), "balon kori", "kori"])], "query_id string, query string")
    want = sorted(map(tuple, bm25.bm25_topk(index, queries, 7).collect()))
    gathered = bm25.SparseIndex(index.postings, index.lengths, index.terms)
    for size, block, held in ((2_000_000, 4096, index), (500, 4096, index), (1, 3, index), (500, 4096, gathered)):
        monkeypatch.setattr(blockmax, "SHARD", size)
        monkeypatch.setattr(bm25, "QUERY_BLOCK", block)
        plans.clear()
        stored, counts = blockmax.build_blocks(held), {}
        assert held is gathered or "Exchange" not in plans[0]
        assert sorted(map(tuple, blockmax.blockmax_topk(stored, queries, 7, counts=counts).collect())) == want
        assert 0 < counts["read"] <= counts["all"] and "explode" not in plans[-1]


def test_blockmax_of_an_empty_index(spark):
    queries = spark.createDataFrame([(0, "balon")], "query_id long, query string")
    assert blockmax.blockmax_topk(blockmax.build_blocks(bm25.build_index(chunk_table(spark, []))), queries).count() == 0


# -- quantised vectors


def test_quantised_search_finds_nine_in_ten_and_measures_few(spark, tmp_path):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 24)).astype(np.float32)
    rows = [(k, [float(e) for e in v]) for k, v in enumerate(x)]
    corpus = spark.createDataFrame([*rows, (5000, None)], "chunk_id long, embedding array<float>")
    path = f"{tmp_path}/q"
    quantized.save_index(corpus.where("chunk_id < 2000"), path)
    before = {n: os.path.getmtime(f"{path}/codes/{n}") for n in quantized.stored_parts(spark, path)}
    model = os.listdir(f"{path}/model")
    quantized.save_index(corpus.where("chunk_id >= 2000"), path)  # an addition: no refit, old files as they are
    assert os.listdir(f"{path}/model") == model and before.items() <= {n: os.path.getmtime(f"{path}/codes/{n}") for n in quantized.stored_parts(spark, path)}.items()
    assert spark.read.parquet(f"{path}/codes").count() == 3000
    asked = spark.createDataFrame([(k, rows[k][1]) for k in range(0, 3000, 60)] + [(9999, None)], "query_id long, embedding array<float>")
    kept = quantized.survivors(spark, path, asked)
    assert kept.count() <= 0.1 * 50 * 3000
    found = {}
    for r in quantized.quantized_topk(path, asked, corpus).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.chunk_id, r.distance))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    right = 0
    for q, hits in found.items():
        near = np.argsort(np.round(1 - unit @ unit[q], 6), kind="stable")[:10]
        right += len(set(near.tolist()) & {c for _, c, _ in hits})
        assert [r for r, _, _ in sorted(hits)] == list(range(1, 11)) and all(abs(d - (1 - float(unit[c] @ unit[q]))) < 2e-6 for _, c, d in hits)
    assert len(found) == 50 and right >= 0.9 * 500


def test_quantised_search_of_few_vectors(spark, tmp_path):
    corpus = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("b", [0.0, 1.0, 0.0])], "chunk_id string, embedding array<float>")
    quantized.save_index(corpus, f"{tmp_path}/q")
    asked = spark.createDataFrame([("x", [1.0, 0.1, 0.0])], "query_id string, embedding array<float>")
    assert [(r.chunk_id, r.rank) for r in quantized.quantized_topk(f"{tmp_path}/q", asked, corpus, share=1.0).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert quantized.quantized_topk(f"{tmp_path}/q", asked.limit(0), corpus).count() == 0


# -- anchors


def test_anchors_find_every_text_that_holds_a_passage(spark):
    draw = random.Random(3)
    alphabet = "ab é日\n"
    held = ["".join(draw.choice(alphabet) for _ in range(draw.choice([0, 1, 2, 5, 30, 200, 900]))) for _ in range(120)] + [None, "same", "same"]
    asked = [draw.choice([t for t in held if t])[a : a + n] for a, n in ((draw.randrange(3), draw.choice([1, 2, 3, 4, 7, 8, 9, 31, 32, 33, 100])) for _ in range(80))] + ["", None, "not there at all", "same", "same"]
    passages = spark.createDataFrame(list(enumerate(asked)), "query_id long, passage string")
    found = anchors.holders(passages, spark.createDataFrame(list(enumerate(held)), "chunk_id long, text string"))
    assert sorted(map(tuple, found.collect())) == sorted((q, k) for q, p in enumerate(asked) if p for k, t in enumerate(held) if t and p in t)
    assert anchors.holders(passages.limit(0), spark.createDataFrame([(1, "a")], "chunk_id long, text string")).count() == 0


# -- quotes


def plain_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def test_quotes_equal_the_best_of_all_windows(spark):
    draw = random.Random(4)
    cases, docs, want = [], [], {}
    for k in range(60):
        text = " ".join(draw.choice(WORDS) for _ in range(draw.randint(0, 14)))
        quote = list(text[draw.randrange(5) :][: draw.randint(1, 25)] if k % 4 else "".join(draw.choice("abcdef ") for _ in range(12)))
        for _ in range(draw.choice([0, 1, 2, 4, 8])):
            if quote:
                quote[draw.randrange(len(quote))] = draw.choice(["x", "", "qq"])
        quote = "".join(quote)
        passing = 0.6
        flat = " ".join(quote.split())
        least = min((plain_edit(flat, text[a:b]) for a in range(len(text) + 1) for b in range(a, len(text) + 1)), default=len(flat)) if flat and text else len(flat)
        share = 1 - least / len(flat) if flat and text else 0.0
        want[k] = round(share, 6) if flat and text and least <= int(0.4 * len(flat) + 1e-9) else 0.0
        cases.append((k, k, quote.upper()))
        docs.append((k, text.replace(" ", "\n ")))
    rows = quotes.fuzzy_quotes(spark.createDataFrame([*cases, (100, 999, "gone"), (101, 1, None)], "case_id long, doc_id long, quote string"), spark.createDataFrame(docs, "doc_id long, text string"), passing).collect()
    got = {r.case_id: r for r in rows}
    assert {k: got[k].similarity for k in want} == want and got[100].similarity == got[101].similarity == 0
    assert all(r.close == (r.similarity > 0) for r in rows)


def test_windows_of_quotes_lose_no_passage():
    draw = random.Random(5)
    for _ in range(300):
        text = np.array([draw.randrange(4) for _ in range(draw.randint(0, 120))])
        quote = np.array([draw.randrange(4) for _ in range(draw.randint(1, 30))])
        if len(text) > 40 and draw.random() < 0.7:
            quote = text[10:35].copy()
            quote[draw.randrange(25)] = 9
        for most in (0, 1, 3):
            whole = quotes.best_distance(quote, text)[0] if len(text) else len(quote)
            cut = min((quotes.best_distance(quote, text[a:b])[0] for a, b in quotes.windows(quote, text, most)), default=len(quote))
            assert cut == whole or whole > most


def test_a_changed_quote_is_close(spark):
    cases = spark.createDataFrame([(1, 1, "the quick brown fox jumped over a lazy dog today")], "case_id long, doc_id long, quote string")
    docs = spark.createDataFrame([(1, "He wrote that the quick red fox jumps over the lazy dog, and more. " * 3)], "doc_id long, text string")
    assert quotes.fuzzy_quotes(cases, docs).first().similarity > 0.6


# -- phrases


def test_terms_of_a_large_map(spark):
    groups = [[f"canonical{k}x", *(f"variant{k}y{j}" for j in range(4))] for k in range(25_000)] + [["Of", "from it"], ["", "nothing"]]
    asked = spark.createDataFrame([(0, "VARIANT17y2 and canonical5x of"), (1, "none"), (2, None), (3, "variant9y0 variant9y3")], "i int, query string")
    began = time.time()
    found = T.expand_terms(asked, groups)
    found._jdf.queryExecution().executedPlan()
    assert time.time() - began < 20
    got = {r.i: r for r in found.collect()}
    assert got[0].detected == ["canonical5x", "canonical17x", "Of", ""]
    assert got[0].expanded == "VARIANT17y2 and canonical5x of variant5y0 variant5y1 canonical17x variant17y0 variant17y1 from it nothing"
    assert got[1].detected == [""] and got[3].expanded == "variant9y0 variant9y3 canonical9x variant9y1 nothing" and got[2].detected == []


def test_groups_are_named_by_their_signs_alone(spark, tmp_path):
    rows = [(1, 0, "user", "alone with it, by it or else nowhere"), (2, 0, "user", "OF sand by it"), (3, 0, "user", "with it"), (4, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.expanded, r.detected) for r in texts_queries["expand_terms"](spark, str(tmp_path)).collect()}
    assert got[1] == (rows[0][3], "") and got[3] == ("with it", "") and got[4] == (None, "")
    assert got[2] == ("OF sand by it from it by it xyzzy or else", "Of|xyzzy")


def test_phrases_are_those_of_substrings():
    draw = random.Random(6)
    groups = [["".join(draw.choice("abC ") for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(1, 4))] for _ in range(40)]
    finder = phrases.PhraseFinder(groups)
    for _ in range(200):
        low = "".join(draw.choice("abcd ") for _ in range(draw.randint(0, 12)))
        assert finder.find(low) == [(g, min(k for k, p in enumerate(own) if p.lower() in low)) for g, own in enumerate(groups) if any(p.lower() in low for p in own)]


def test_terms_of_a_table_are_those_of_substrings(spark):
    draw = random.Random(9)
    some = lambda most: "".join(draw.choice("abé😀") for _ in range(draw.randint(1, most)))
    terms = sorted({some(n) for n in (1, 2, 3, 4, 8, 9, 12) for _ in range(60)})
    texts = [(k, " ".join(some(30) for _ in range(draw.randint(0, 5)))) for k in range(60)] + [(60, "x" * 9 + terms[0].upper() + "\n" + max(terms, key=len)), (61, None), (62, "ab" * 20_000), (63, "zz"), (None, "a")]
    found = phrases.terms_in(spark.createDataFrame(texts, "i long, text string"), ["i"], spark.createDataFrame([(t,) for t in [*terms, terms[0], "", None]], "term string"))
    got = {r.i: sorted(r.found) for r in found.collect()}
    want = {k: sorted(w for w in terms if w in t.lower()) for k, t in texts if t is not None}
    assert got == {k: v for k, v in want.items() if v} and len(got) > 50


def test_a_vocabulary_goes_to_no_task_whole(spark, tmp_path):
    rows = [(1, 0, "user", "Sandy, of\nsands"), (2, 0, "user", "?"), (3, 0, "user", None), (4, 0, "assistant", "sand and of x\n an end\n")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = structure_queries["expand_many_terms"](spark, str(tmp_path))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.conv_id: (r.n_named, r.expanded) for r in found.collect()} == {1: (4, "Sandy, of\nsands zzanzz zzandzz zzofzz zzsandzz"), 2: (0, "?"), 3: (0, None)}


# -- hierarchies


def test_hierarchies_settle_as_read_in_order(spark):
    draw, rows, want = random.Random(8), [], set()
    for doc in range(40):
        seen, kept = set(), set()
        for p in range(draw.randint(1, 12)):
            for k in range(-1, draw.randint(0, 6)):
                mark = draw.randrange(14)
                rows.append((doc, f"{p}.{k}", None if k < 0 else f"{p}.-1", (p, k), mark))
                if mark not in seen and (k < 0 or p in kept):
                    seen.add(mark)
                    want.add((doc, f"{p}.{k}"))
                    if k < 0:
                        kept.add(p)
    df = spark.createDataFrame(rows, "doc_id long, chunk string, parent string, place struct<p: int, k: int>, print long")
    assert {tuple(r) for r in chunking.settle_hierarchy(df, ["doc_id"]).collect()} == want


def test_hierarchies_settle_in_one_shuffle(spark):
    """Chunk i of a chain is decided by the one before it: every second stays, however long the chain, and nothing is shuffled again for it."""
    chain = [(d, {"n": i}, None if j == 0 else {"n": i}, (i, j), m) for d in range(3) for i in range(2000) for j, m in ((0, 2 * (i // 2)), (1, 10_000 + i // 4))]
    rows = [*chain, (7, {"n": 1}, {"n": 9}, (1, 0), 1), (7, {"n": 2}, None, (2, 0), 1), (7, {"n": 3}, None, (3, 0), 1), (None, {"n": 1}, None, (1, 0), 1), (8, {"n": 1}, None, (1, 0), None)]
    df = spark.createDataFrame(rows, "doc_id long, chunk struct<n: int>, parent struct<n: int>, place struct<p: int, k: int>, print long")
    found = chunking.settle_hierarchy(df, ["doc_id"])
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = []
    for d in range(3):
        seen, kept = set(), set()
        for _, chunk, parent, _, mark in (r for r in chain if r[0] == d):
            if mark not in seen and (parent is None or chunk["n"] in kept):
                seen.add(mark)
                kept.add(chunk["n"])
                want.append((d, chunk["n"]))
    assert sorted((r.doc_id, r.chunk.n) for r in found.collect()) == sorted([*want, (7, 2)])


# -- limits


def test_the_longest_prefix_counts(spark):
    policies = spark.createDataFrame([("/api", 5), ("/api/search", 3), ("/api/search", 2), ("", 9), (None, 1)] + [(f"/p{k}", k) for k in range(20_000)], "prefix string, limit int")
    paths = spark.createDataFrame([(p,) for p in ("/api/x", "/api/search/a", "/zz", "/p17", "/p19999x", None)], "path string")
    assert {r.path: (r.prefix, r.limit) for r in usage.longest_prefix(paths, policies).collect()} == {
        "/api/x": ("/api", 5), "/api/search/a": ("/api/search", 2), "/zz": ("", 9), "/p17": ("/p17", 17), "/p19999x": ("/p19999", 19999)
    }


def test_one_client_without_a_pause(spark):
    """All requests are one client's, one every second: ten in sixty seconds are granted."""
    asked = spark.range(20_000).select(F.col("id").alias("request_id"), F.lit("c").alias("client"), F.lit("/x").alias("path"), F.lit(False).alias("member"), F.timestamp_seconds("id").alias("ts"))
    found = usage.limit_requests(asked, [], usage.Policy("default", (), 10, 60)).orderBy("request_id").collect()
    assert [r.request_id for r in found if not r.throttled] == [k for k in range(20_000) if k % 60 < 10]


# -- what follows retrieval


def test_retries_end_when_hits_suffice(spark):
    """Question 0 is simple, 1 suffices at once, 2 after one round, 3 after two, 4 never, 5 has nothing at first, 6 gets nothing more."""
    def hits(rows):
        return spark.createDataFrame([(q, r, 100 * q + r, f"d{r if good else 0}", 0.9 if good else 0.1) for q, good, n in rows for r in range(1, n + 1)], "query_id long, rank long, chunk_id long, doc_id string, score double")

    classes = spark.createDataFrame([(q, "simple" if q == 0 else "complex", 1) for q in range(7)], "query_id long, complexity string, n_sub int")
    rounds = {1: hits([(2, True, 9), (3, False, 9), (4, False, 9), (5, True, 9), (1, True, 9)]), 2: hits([(3, True, 9), (4, False, 9)])}
    asked = []

    def widen(failed, k):
        asked.append(sorted(r.query_id for r in failed.collect()))
        return rounds[k]

    found = fusion.routed(hits([(0, False, 7), (1, True, 7), (2, False, 5), (3, False, 5), (4, False, 5), (6, False, 3)]), widen, classes).collect()
    kept = {}
    for r in found:
        kept.setdefault((r.query_id, r.retries), []).append(r.rank)
    assert {k: len(v) for k, v in kept.items()} == {(0, 0): 5, (1, 0): 5, (2, 1): 8, (3, 2): 8, (4, 2): 8, (5, 1): 8, (6, 0): 3}
    assert asked == [[2, 3, 4, 5, 6], [3, 4, 6]]
    one = fusion.routed(hits([(1, True, 7)]), widen, classes.where("query_id = 1"))
    assert one.count() == 5 and len(asked) == 2  # none fails, none is asked for


def test_paragraphs_of_chunks(spark):
    chunks = spark.createDataFrame([(1, 1, "b\n\n \n\n c "), (1, 0, "a"), (1, 2, None), (1, 3, "d" * 40), (1, 4, "e"), (2, 0, " \n")], "doc_id long, chunk_index long, text string")
    assert [(r.doc_id, r.no, r.paragraph) for r in knowledge.paragraphs(chunks, chars=30).orderBy("no").collect()] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, "d" * 16)]
    assert knowledge.paragraphs(chunks, most=2).count() == 2


def test_messages_and_their_citations(spark):
    rows = [(1, 2, "assistant", "x", '[{"doc_id": 5, "title": "T"}, null]'), (1, 1, "user", "y", None), (1, 3, "user", "z", "{broken")]
    found = tenancy.chat_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, citations string")).orderBy("place").collect()
    assert [(r.place, r.text, r.doc_ids, r.titles) for r in found] == [(1, "y", [], []), (2, "x", ["5"], ["T"]), (3, "z", [], [])]


def test_order_statistics_are_exact(spark):
    draw = random.Random(9)
    rows = [(draw.choice(["a", "b", None]), draw.choice([None, draw.gauss(0, 5), 3.0])) for _ in range(3000)] + [("one", 7.0)]
    found = {r.k: r.value for r in stats.order_statistic(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", F.ceil(0.95 * F.col("n")) - 1).collect()}
    for k in ("a", "b", None, "one"):
        own = sorted(v for g, v in rows if g == k and v is not None)
        assert found[k] == own[-(-95 * len(own) // 100) - 1]


# -- scratch


def test_scratch_goes_with_its_scope(spark, tmp_path):
    with scratch(spark):
        outer = materialize(spark.range(3), "outer")
        with scratch(spark):
            inner = materialize(spark.range(3), "inner").scratch_path
            assert os.path.isdir(inner)
        assert not os.path.exists(inner) and outer.count() == 3
    with pytest.raises(ValueError), scratch(spark):
        broken = materialize(spark.range(3), "broken").scratch_path
        raise ValueError
    assert not os.path.exists(outer.scratch_path) and not os.path.exists(broken)


def test_a_changed_table_has_another_state(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(3).write.parquet(path)
    before = state_of(spark, path)
    assert state_of(spark, path) == before
    spark.range(1).write.mode("append").parquet(path)
    assert state_of(spark, path) != before


# -- ingestion with states


def test_searches_score_chunks_where_they_are_read(spark, monkeypatch):
    rows = [(k % 150, 0, t) for k, t in enumerate(texts(40, 200))] + [(900 + k, 0, "balon kori") for k in range(30)] + [(990, 0, None), (991, 0, "!")]
    chunks = chunk_table(spark, rows)
    index = bm25.build_index(chunks)
    whole = {}
    for i, _, t in rows:
        whole[i] = " ".join([whole.get(i, ""), t or ""])
    counted = {i: [w for w in t.split() if len(w) > 1 and w != "!"] for i, t in whole.items()}
    counted = {i: w for i, w in counted.items() if w}
    assert {(r.chunk_id, r.length) for r in index.lengths.collect()} == {(i, len(w)) for i, w in counted.items()}
    assert {(r.chunk_id, r.term): r.tf for r in index.postings.collect()} == {(i, x): w.count(x) for i, w in counted.items() for x in w}
    idf, mean = {r.term: r.idf for r in bm25.term_idf(index).collect()}, np.mean([len(w) for w in counted.values()])
    asked = {f"q{k}": t for k, t in enumerate(texts(41, 12))} | {"copies": "balon kori", "none": "zzz"}
    frame = spark.createDataFrame(list(asked.items()), "query_id string, query string")
    want = {}
    for q, t in asked.items():
        gain = {i: sum(idf.get(x, 0) * w.count(x) * 2.5 / (w.count(x) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for x in t.split() if x in w) for i, w in counted.items()}
        want[q] = sorted(((round(s, 6), i) for i, s in gain.items() if round(s, 6) > 0), key=lambda p: (-p[0], p[1]))
    for block, cells, products in ((4096, 2_000_000, 2_000_000), (3, 100, 50)):
        monkeypatch.setattr(bm25, "QUERY_BLOCK", block)
        monkeypatch.setattr(bm25, "CELLS", cells)
        monkeypatch.setattr(bm25, "PRODUCTS", products)
        found = bm25.bm25_topk(index, frame, 7)
        got = {q: sorted((r.rank, r.chunk_id, r.score) for r in found.collect() if r.query_id == q) for q in asked}
        for q in asked:
            assert [i for _, i, _ in got[q]] == [i for _, i in want[q][:7]] and np.allclose([s for *_, s in got[q]], [s for s, _ in want[q][:7]], atol=2e-6)
        assert bm25.bm25_scores(index, frame).count() == sum(map(len, want.values()))
    # no shuffle by chunk: only the best of each task go to their query
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
    odd = bm25.bm25_topk(index, frame, 3, among=chunks.where("chunk_id % 2 = 1"))
    assert {(r.query_id, r.chunk_id) for r in odd.collect()} == {(q, i) for q in asked for _, i in [p for p in want[q] if p[1] % 2 and p[1] != 991][:3]}


def test_words_are_split_where_texts_are_counted(spark, monkeypatch):
    """A word that touches a letter beyond 16 bits is none, and texts, not lists of their words, go to Python."""
    draw = random.Random(7)
    parts = ["ab", "x", "Z9", "_", "\u00e9", "\u00df", "\u212a", "\u0130", "\u0663", "\u6f22", "\U0001d400", "\U0001f600", "\u0301", " ", "\n", "-", "a1b", "\u00a0"]
    rows = [(k, None if k % 9 == 0 else "".join(draw.choices(parts, k=draw.randint(0, 25)))) for k in range(900)] + [(900, "\U0001d400ab cd"), (901, "ab"), (902, "cd"), (903, "")]
    frame = spark.createDataFrame(rows, "chunk_id long, text string").coalesce(1)
    want = {}
    for k, t in rows:
        for w in re.findall(r"\w+", (t or "").lower()):
            if re.fullmatch("[a-z0-9]{2,}", w):
                want[k, w] = want.get((k, w), 0) + 1
    by_column = frame.select("chunk_id", F.explode(bm25.tokens(F.col("text"))).alias("term")).groupBy("chunk_id", "term").count()
    assert {(r.chunk_id, r.term): r["count"] for r in by_column.collect()} == want
    for size in (8_000_000, 40):
        monkeypatch.setattr(bm25, "TEXT_BYTES", size)
        found = bm25.count_words(frame).collect()
        assert {(r.chunk_id, r.term): r.tf for r in found} == want and len(found) == len(want)
        assert all(r.length == sum(n for (k, _), n in want.items() if k == r.chunk_id) for r in found)
    assert "regexp_extract_all" not in bm25.word_rows(frame)._jdf.queryExecution().optimizedPlan().toString()


def test_passages_go_to_the_texts(spark):
    held = anchors.holders(spark.createDataFrame([(1, "kori balon mimus")], "query_id long, passage string"), spark.createDataFrame([(5, "a kori balon mimus b"), (6, "kori")], "chunk_id long, text string"))
    assert [tuple(r) for r in held.collect()] == [(1, 5)]
    assert "SortMergeJoin" not in held._jdf.queryExecution().executedPlan().toString() and held._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 1


def test_a_batch_adds_one_file_a_folder(spark, tmp_path):
    rows = spark.range(4000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), (F.col("id") % 1000).alias("doc_id"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in a stream
    try:
        for batch in (rows.where("id < 2000"), rows):
            ingest.append_new(batch.repartition(8), f"{tmp_path}/t")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    folders = [f for f in (tmp_path / "t").iterdir() if f.is_dir()]
    assert max(len(list(f.glob("*.parquet"))) for f in folders) <= 2
    assert spark.read.parquet(f"{tmp_path}/t").groupBy("chunk_id").count().agg(F.max("count"), F.count("*")).first() == (1, 4000)


def test_uploads_are_tracked_over_batches(spark, tmp_path):
    """Announced first and sent later, sent twice, never sent, and a batch that is run again."""
    schema = "doc_id long, ts timestamp, text string"
    at = lambda s: f"2024-01-01 {s}"
    batches = [
        [(1, at("10:00:00"), None), (2, at("10:00:00"), "two words"), (3, at("10:00:00"), None)],
        [(1, at("10:20:00"), "text one"), (2, at("10:21:00"), "again"), (2, at("10:22:00"), "and again"), (None, at("10:22:00"), "lost")],
        [(4, at("14:00:00"), "x" * 1500)],
        [(5, at("14:01:00"), "late one")],
    ]
    target, source = f"{tmp_path}/target", f"{tmp_path}/in"

    def run(checkpoint):
        events = spark.readStream.schema(schema).parquet(source)
        ingest.ingest_uploads(events, target, f"{tmp_path}/{checkpoint}", dense.hashed_vectors).awaitTermination()
        steps = {}
        for r in spark.read.parquet(f"{target}/progress").collect():
            steps.setdefault(r.doc_id, []).append((r.progress, r.status))
        return {d: sorted(s) for d, s in steps.items()}

    for rows in batches:
        spark.createDataFrame([(d, t, x) for d, t, x in rows], "doc_id long, ts string, text string").selectExpr("doc_id", "cast(ts as timestamp) ts", "text").coalesce(1).write.mode("append").parquet(source)
        now = run("state")
    whole = [(10, "processing"), (20, "processing"), (70, "processing"), (90, "processing"), (100, "completed")]
    assert {d: now[d] for d in (1, 2, 4, 5)} == dict.fromkeys((1, 2, 4, 5), whole) and now[3] == [(10, "failed"), (10, "processing")]
    chunks = {r.chunk_id: r for r in spark.read.parquet(f"{target}/chunks").collect()}
    assert set(chunks) == {"1_chunk_0", "2_chunk_0", "4_chunk_0", "4_chunk_1", "5_chunk_0"} and chunks["2_chunk_0"].text == "two words"
    assert all(len(c.embedding) == 256 for c in chunks.values())
    assert run("again") == now and spark.read.parquet(f"{target}/chunks").count() == 5  # everything again, with no memory: nothing is added


def test_documents_are_followed_in_groups(spark, tmp_path, monkeypatch):
    """Many documents are one row of the state and one call of Python; the steps are those of a plain loop."""
    monkeypatch.setattr(ingest, "GROUPS", 5)
    draw, hour = random.Random(3), 3600
    batches = [[(draw.randrange(60), 10 * hour * n + draw.randrange(hour), draw.choice([None, None, "", f"text {n}"])) for _ in range(70)] for n in range(4)]
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame([(d, t, f"{x} {i}" if x else x) for i, (d, t, x) in enumerate(rows)], "doc_id long, s long, text string")
        frame.select("doc_id", F.timestamp_seconds("s").alias("ts"), "text").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        batches[k] = [(d, t, f"{x} {i}" if x else x) for i, (d, t, x) in enumerate(rows)]
        steps, query = [], ingest.track(spark.readStream.schema("doc_id long, ts timestamp, text string").parquet(f"{tmp_path}/in")).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        query = query.foreachBatch(lambda b, _: b.write.mode("append").parquet(f"{tmp_path}/out")).start()
        query.awaitTermination()
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 5
    state, watermark = {}, 0
    for rows in [x for batch in batches for x in (batch, [])]:  # a batch without rows follows, once the watermark has moved on
        come = {}
        for d, t, x in sorted((r for r in rows if r[1] >= watermark), key=lambda r: r[1]):
            come.setdefault(d, []).append((t, x))
        for d, events in come.items():
            done, text = state.get(d, (0, 0))[0], next((x for _, x in events if x), None)
            steps += [(d, 10, "processing", None)] * (done < 10) + [(d, 20, "processing", text)] * (done < 20 and text is not None)
            state[d] = max(done, 20 if text else 10), events[-1][0] + hour
        for d in [d for d, (_, end) in state.items() if d not in come and end < watermark]:
            done, _ = state.pop(d)
            steps += [(d, done, "failed", None)] * (done < 20)
        watermark = max([watermark, *(t - hour for _, t, _ in rows)])
    assert Counter(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == Counter(steps) and any(s == "failed" for _, _, s, _ in steps)


def test_vectors_are_made_once_for_chunks_that_are_new(spark, tmp_path):
    asked = []

    def vectors(chunks):
        asked.append(sorted(r.chunk_id for r in chunks.select("chunk_id").collect()))
        return dense.hashed_vectors(chunks, keep=tuple(chunks.columns))

    for k, (ids, want) in enumerate([((1, 2), [["1_chunk_0", "2_chunk_0"]]), ((2, 3, 3), [["3_chunk_0"]]), ((1, 3), [])]):
        rows = spark.createDataFrame([(d, f"text {d}") for d in ids], "doc_id long, text string").select("doc_id", F.timestamp_seconds(F.lit(1)).alias("ts"), "text")
        rows.write.parquet(f"{tmp_path}/in{k}")
        events = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in{k}")
        asked.clear()
        ingest.ingest_uploads(events, f"{tmp_path}/target", f"{tmp_path}/state{k}", vectors).awaitTermination()
        assert asked == want
    held = spark.read.parquet(f"{tmp_path}/target/chunks")
    joined = held.drop("embedding").join(dense.hashed_vectors(held), "chunk_id")  # the vectors that a join would give
    assert held.count() == 3 and held.select("chunk_id", "embedding").exceptAll(joined.select("chunk_id", "embedding")).isEmpty()


def test_nearest_of_other_documents_in_one_search(spark):
    draw = np.random.default_rng(2)
    x = np.round(draw.normal(size=(300, 6)), 1)
    x[10:30] = x[5]  # copies, so that distances tie
    doc = [0 if k < 200 else k % 13 for k in range(300)]  # one document has most chunks
    rows = spark.createDataFrame([(k, d, [float(e) for e in v]) for k, (d, v) in enumerate(zip(doc, x, strict=True))] + [(999, 3, None)], "chunk_id long, doc_id long, embedding array<double>")
    docs = rows.select("doc_id").distinct()
    found = {}
    for r in dense.related_by_first_chunk(rows, docs, 4).collect():
        found.setdefault(r.doc_id, []).append((r.rank, r.related_doc_id, r.distance))
    for d in set(doc):
        first = min(k for k in range(300) if doc[k] == d)
        near = {}
        for k in range(300):
            if doc[k] != d:
                far = round(1 - float(x[k] @ x[first]) / float(np.linalg.norm(x[k]) * np.linalg.norm(x[first])), 6)
                near[doc[k]] = min(far, near.get(doc[k], 9))
        best = sorted((v, o) for o, v in near.items())[:4]
        assert [o for _, o, _ in sorted(found[d])] == [o for _, o in best]


def test_odd_vectors_and_names_of_queries(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0, 1.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, []), (8, [inf, 0.0]), (9, [0.0, 0.0])]
    corpus = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([("a", [1.0, 0.1]), ("b", [0.1, 1.0]), ("c", [1.0]), ("d", None), ("e", [nan, 1.0])], "query_id string, embedding array<double>")
    found = dense.dense_topk(asked, corpus, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in found] == [("a", 1), ("a", 2), ("a", 9), ("b", 2), ("b", 1), ("b", 9)]
    assert dense.dense_topk(asked.where("query_id = 'd'"), corpus).count() == 0


def test_chunks_of_sections_know_their_pages(spark):
    sections = spark.createDataFrame([(1, 0, "abstract", "x" * 50, 2, 5), (1, 1, "results", "y", 6, 6)], "doc_id long, section_no int, section_type string, content string, page_start int, page_end int")
    assert {(r.chunk_index, r.page_range) for r in chunking.section_chunks(sections, {"abstract": 30}).collect()} == {(0, "2-5"), (1, "2-5"), (2, "6-6")}

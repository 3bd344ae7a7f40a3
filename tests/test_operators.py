"""Hand-computed cases and properties of single operators."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.functions import patterns as P
from corpusloom.operators import bm25, chunking, dense, filters, fusion, knowledge, stats, tenancy
from corpusloom.operators import text as T
from corpusloom.operators.components import connected_components
from corpusloom.operators.ranking import distributed_rank
from corpusloom.plans import hybrid_search
from corpusloom.sources import tables as io
from corpusloom.streaming import ingest, usage


def test_components_of_chains_and_loops(spark):
    draw = random.Random(1)
    chain = [(k, k + 1) for k in range(40)] + [(100, 100), (200, 201), (201, 202), (202, 200), (None, 3)]
    draw.shuffle(chain)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {k: 0 for k in range(41)} | {200: 200, 201: 200, 202: 200}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_distributed_rank_is_row_number(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("k"))
    got = distributed_rank(df, ["g"], F.floor(F.col("k") / 100), ["k", "id"]).collect()
    for g in (0, 1):
        rows = sorted((r for r in got if r.g == g), key=lambda r: (r.k, r.id))
        assert [r["rank"] for r in rows] == list(range(250))


def test_recursive_chunks_rebuild_the_text(spark):
    text = "First paragraph. It goes on.\nA line\n\n" + "word " * 90 + "x" * 250
    rows = chunking.recursive_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"), ["doc_id"], size=100).orderBy("position").collect()
    assert "".join(r.chunk for r in rows) == text and max(len(r.chunk) for r in rows) <= 100 and {r.doc_id for r in rows} == {1}


def test_hierarchy_numbers_and_parents(spark):
    docs = spark.createDataFrame([(1, "A sentence of words. " * 300)], "doc_id long, text string")
    rows = chunking.hierarchical_chunks(docs).collect()
    parents = {r.chunk_id for r in rows if r.chunk_type == "parent"}
    children = [r for r in rows if r.chunk_type == "child"]
    assert {r.parent_id for r in children} <= parents and {r.chunk_id for r in children} == {f"1_child_{k}" for k in range(len(children))}


def test_bm25_negative_idf_and_repeated_terms(spark):
    chunks = spark.createDataFrame([(k, t) for k, t in enumerate(["aa bb", "aa cc", "aa dd dd", "aa", "", "größe x"])], "chunk_id long, text string")
    index = bm25.build_index(chunks)
    assert {r.term: r.df for r in index.terms.collect()} == {"aa": 4, "bb": 1, "cc": 1, "dd": 1}
    idf = {r.term: r.idf for r in bm25.term_idf(index).collect()}
    assert idf["aa"] == 0.25 * (3 * 0.8472978603872037 - 2.1972245773362196) / 4
    ask = lambda q: {r.chunk_id: r.score for r in bm25.bm25_topk(index, spark.createDataFrame([(0, q)], "query_id int, query string")).collect()}
    assert set(ask("dd zz")) == {2} and abs(ask("dd dd")[2] - 2 * ask("dd")[2]) < 2e-6 and ask("!") == {}


def test_rrf_is_symmetric_and_breaks_ties(spark):
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "query_id int, rank long, chunk_id long")
    b = spark.createDataFrame([(1, 1, 11), (1, 2, 12)], "query_id int, rank long, chunk_id long")
    scores = lambda x, y: {r.chunk_id: r.score for r in fusion.rrf(x, y).collect()}
    assert scores(a, b) == scores(b, a) == {10: 0.016393, 11: 0.032522, 12: 0.016129}


def test_weighted_with_a_flat_leg(spark):
    s = spark.createDataFrame([(1, 10, 2.0), (1, 11, 2.0)], "query_id int, chunk_id long, score double")
    d = spark.createDataFrame([(1, 11, 0.2), (1, 12, 0.6)], "query_id int, chunk_id long, distance double")
    assert {r.chunk_id: r.score for r in fusion.weighted(s, d).collect()} == {10: 0.0, 11: 0.7, 12: 0.0}


def test_filters_treat_missing_values(spark):
    df = spark.createDataFrame([(1, "a", 2000), (2, None, None), (3, "b", 1990)], "id int, phase string, year int")
    ids = lambda tree: sorted(r.id for r in df.where(filters.where(tree)).collect())
    assert ids({}) == [1, 2, 3] and ids({"phase": {"$ne": "a"}}) == [2, 3] and ids({"year": {"$gte": 1991}}) == [1]
    assert ids({"$or": [{"phase": "b"}, {"$and": [{"phase": "a"}, {"year": {"$lt": 2001, "$gt": 1999}}]}]}) == [1, 3]


def test_language_and_doctype(spark):
    df = spark.createDataFrame([("the cat is on the mat and so on",), ("der Hund ist nicht auf dem Sofa",), ("schön",), ("one two",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.detect_language(F.col("t"))).collect()] == ["en", "de", "de", "unknown", "unknown", "unknown"]


def test_evidence_gap_thresholds(spark):
    hits = spark.createDataFrame([(1, 0.8), (2, 0.7), (3, 0.6), (3, 0.65), (4, 1.4)], "query_id int, distance double")
    assert {r.query_id: r.gap for r in knowledge.evidence_gaps(hits).collect()} == {1: "missing_evidence", 2: "weak_coverage", 3: "none", 4: "missing_evidence"}


def test_exact_search_equals_brute_force_in_any_blocks(spark, monkeypatch):
    draw = np.random.default_rng(21)
    points = draw.integers(-2, 3, (400, 6)).astype(float)  # many ties
    points[7] = 0
    rows = [(k, p.tolist() if k % 97 else None, k % 3 or None) for k, p in enumerate(points)]
    corpus = spark.createDataFrame([(f"c{k:03d}", *r[1:]) for k, r in enumerate(rows)], "chunk_id string, embedding array<double>, kind long")
    asked = spark.createDataFrame(rows, "query_id long, embedding array<double>, want long").where("query_id % 9 = 0")
    sizes = np.sqrt((points**2).sum(axis=1))
    both = np.outer(sizes, sizes)
    measures = {"cosine": 1 - points @ points.T / np.where(both > 0, both, 1), "ip": 1 - points @ points.T, "l2sq": ((points[:, None] - points[None]) ** 2).sum(axis=2)}
    for block, cells in ((4096, 2_000_000), (7, 50)):
        monkeypatch.setattr(dense, "QUERY_BLOCK", block)
        monkeypatch.setattr(dense, "CELLS", cells)
        for metric, match in (("cosine", None), ("ip", None), ("l2sq", None), ("cosine", ("kind", "want"))):
            got = {(r.query_id, r["rank"]): (r.chunk_id, r.distance) for r in dense.dense_topk(asked, corpus, 12, metric, match).collect()}
            want = {}
            for q in range(0, 400, 9):
                if q % 97 == 0:
                    continue
                order = sorted((round(measures[metric][q, c], 6) + 0.0, f"c{c:03d}") for c in range(400) if c % 97 and (not match or (q % 3 and c % 3 == q % 3)))
                want |= {(q, n + 1): (c, d) for n, (d, c) in enumerate(order[:12])}
            assert got == want
    assert dense.dense_topk(asked.limit(0), corpus).count() == 0 and dense.dense_topk(asked, corpus.limit(0)).count() == 0


def test_related_by_first_chunk_sees_past_its_own_chunks(spark):
    rows = [(k, 0, [1.0, 0.001 * k]) for k in range(60)] + [(100 + k, 1 + k // 30, [1.0, 0.5 + 0.001 * k]) for k in range(60)] + [(200, 5, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "chunk_id long, doc_id long, embedding array<double>")
    got = dense.related_by_first_chunk(vectors, vectors, 2).collect()
    assert {(r.doc_id, r["rank"]): r.related_doc_id for r in got} == {(0, 1): 1, (0, 2): 2, (1, 1): 2, (1, 2): 0, (2, 1): 1, (2, 2): 0, (5, 1): 2, (5, 2): 1}


def test_throttling_as_configured(spark):
    policies = [usage.Policy("auth", ("/api/auth/login",), 2), usage.Policy("search", ("/api/search",), 3)]
    paths = ["/api/auth/login"] * 3 + ["/api/search"] * 4 + ["/api/other"] * 11
    rows = [(k, "ip:a", p, False, k) for k, p in enumerate(paths)] + [(100 + k, "ip:b", "/api/auth/login", False, 5) for k in range(2)] + [(200, "ip:a", "/api/auth/login", False, 61)]
    schema = "request_id long, client string, path string, member boolean, s long"
    asked = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s"))
    got = {r.request_id: (r.policy, r.throttled) for r in usage.limit_requests(asked, policies, usage.Policy("default", (), 10)).collect()}
    assert [k for k, (_, no) in sorted(got.items()) if no] == [2, 6, 17] and got[2][0] == "auth" and got[6][0] == "search" and got[17][0] == "default"
    # the member's limit of 2 counts twice, and each token is a client
    head = spark.createDataFrame([(k, "Bearer token-A") for k in range(5)] + [(5, "bearer token-B"), (6, None)], "request_id long, a string")
    none = F.lit(None).cast("string")
    named = head.select("request_id", usage.client_name(none, F.col("a"), none, F.lit("10.0.0.1, 10.0.0.2"), F.lit("h")).alias("client"), F.lit("/api/plain").alias("path"), F.col("a").isNotNull().alias("member"), F.timestamp_seconds("request_id").alias("ts"))
    got = {r.request_id: r for r in usage.limit_requests(named, [], usage.Policy("default", (), 2, 60, 2.0)).collect()}
    assert [k for k in sorted(got) if got[k].throttled] == [4] and got[0].allowed == 4 and got[6].allowed == 2
    assert got[0].client.startswith("bearer:") and len(got[0].client) == 31 and got[5].client != got[0].client and got[6].client == "ip:10.0.0.1"


def test_throttling_equals_brute_force_in_batch_and_stream(spark, tmp_path):
    draw = random.Random(23)
    rows = [(k, f"c{draw.randint(0, 4)}", draw.choice(["/a", "/a/b", "/x"]), draw.random() < 0.3, draw.randint(0, 900)) for k in range(600)]
    policies, default = [usage.Policy("a", ("/a",), 2, 30, 2.0), usage.Policy("ab", ("/a/b",), 1, 60)], usage.Policy("default", (), 3, 20, 1.5)
    schema = "request_id long, client string, path string, member boolean, s long"
    asked = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000))
    want, log = {}, {}
    for i, client, path, member, s in sorted(rows, key=lambda r: (r[4], r[0])):
        p = policies[1] if path == "/a/b" else policies[0] if path == "/a" else default
        granted = [t for t in log.setdefault((client, p.name), []) if t > s - p.seconds]
        want[i] = (len(granted), len(granted) >= int(p.requests * (p.factor if member else 1)))
        if not want[i][1]:
            log[client, p.name].append(s)
    assert {r.request_id: (r.n, r.throttled) for r in usage.limit_requests(asked, policies, default).collect()} == want
    for k in range(3):
        asked.where(f"s >= {k * 300} and s < {k * 300 + 300 + (k == 2)}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(asked.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = usage.limit_stream(stream, policies, default).writeStream.format("memory").queryName("limits").outputMode("append")
    out.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start().awaitTermination()
    assert {r.request_id: (r.n, r.throttled) for r in spark.table("limits").collect()} == want


def test_recent_requests_over_window_edges(spark):
    draw = random.Random(24)
    rows = [(k, draw.randint(0, 2), draw.randint(0, 300)) for k in range(200)]
    got = usage.recent_requests(spark.createDataFrame(rows, "request_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s")), 40).collect()
    assert {r.request_id: r.n for r in got} == {i: sum(u == v and s - 40 < t <= s for _, v, t in rows) for i, u, s in rows}


def test_noise_guard_changes_nothing(spark):
    draw = random.Random(25)
    parts = ["Downloaded from https://x.y/z", "© 2004 Press.", "12", "\n", " ", "plain words", "Page 3 of 9", "7 | head", "E-mail: a@b.c", "DOI: 10.1/x", "k", "accepted 3 May 2001", "\u212a", "CC BY-NC"]
    rows = spark.createDataFrame([("".join(draw.choice(parts) for _ in range(draw.randint(0, 6))),) for _ in range(400)] + [(None,)], "t string")
    both = rows.select(T.strip_noise(F.col("t")).alias("a"), T._without(F.col("t"), T.P.NOISE).alias("b")).collect()
    assert all(r.a == r.b for r in both)


def test_verdict_rules(spark):
    texts = ["All studies show it", "every researcher", "all researchers", "they universally AGREE", "never the case", "it always holds", "all studies of it", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    assert [r[0] for r in rows.orderBy("k").select(knowledge.overgeneral(F.col("t"))).collect()] == [True] * 5 + [False] * 3
    answers = spark.createDataFrame([(1, "rose 12.5% and 7 percent"), (2, "40 percentage points"), (3, None), (4, "9 %")], "k long, answer string")
    sources = spark.createDataFrame([(1, "7 of"), (1, "3"), (2, "140"), (4, None)], "k long, source string")
    assert {(r.k, r.stat) for r in knowledge.unverified_statistics(answers, sources, ["k"], ["k"]).collect()} == {(1, "12.5"), (4, "9")}
    scored = spark.createDataFrame([(1, 0.95), (2, 0.95), (3, 0.95), (4, None), (5, 0.05)], "k long, score double")
    issues = spark.createDataFrame([(2,), (3,), (3,), (5,)], "k long")
    got = {r.k: (r.accuracy, r.passed, r.hallucination) for r in knowledge.answer_verdict(scored, issues, ["k"], "score").collect()}
    assert got == {1: (0.95, True, False), 2: (0.85, True, False), 3: (0.75, False, True), 4: (0.9, True, False), 5: (0.0, False, False)}
    cited = spark.createDataFrame([(1, "Keller", "1991"), (1, "keller", "199"), (1, "Stein", "1991")], "k long, author string, year string")
    held = spark.createDataFrame([("Anna Keller, Jo Stein", 1991, 7), ("Anna Keller", 1991, 3), (None, 1991, 1), ("X", None, 2)], "authors string, year int, doc_id long")
    assert {(r.author, r.year): r.doc_id for r in knowledge.look_up_citations(cited, held, ["k"]).collect()} == {("Keller", "1991"): 3, ("keller", "199"): 3, ("Stein", "1991"): 7}


def test_clusters_need_the_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        session.workspace(Session())


def test_hybrid_plan(spark):
    chunks = spark.createDataFrame([(k, k // 2, f"word{k} common text", 10, None, 2000 + k) for k in range(8)], "chunk_id long, doc_id long, text string, total_pages int, doi string, year int")
    vectors = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(8)], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, "word5", [1.0, 5.0])], "query_id int, query string, embedding array<double>")
    rows = hybrid_search(chunks, vectors, asked, 2, {"year": {"$gte": 2004}}).orderBy("rank").collect()
    assert rows[0].chunk_id == 5 and len({r.doc_id for r in rows}) == 2 and all(r.year >= 2004 for r in rows)


def test_stream_equals_batch_and_replay_adds_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(k, "x" * (500 * k)) for k in range(5)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    for state in ("a", "b"):  # the second checkpoint replays everything
        ingest.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/{state}", "doc_id long, text string").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("bucket")
    assert sorted(got.collect()) == sorted(chunking.fixed_chunks(docs).collect())

    events = spark.createDataFrame([(k, k % 3, 7.0 * k) for k in range(60)], "event_id long, user_id long, s double").withColumn("ts", F.timestamp_seconds("s"))
    events.write.parquet(f"{tmp_path}/events")
    stream = usage.sliding_requests(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"))
    q = stream.writeStream.format("memory").queryName("usage").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("usage").collect()) == sorted(usage.sliding_requests(events).collect())


def test_sources(spark, tmp_path):
    folder = tmp_path / "corpus" / "Phase 1 - Theory" / "Growth"
    folder.mkdir(parents=True)
    (folder / "a b.pdf").write_bytes(b"%PDF")
    row = io.corpus_catalog(spark, str(tmp_path / "corpus")).first()
    assert (row.filename, row.phase, row.phase_name, row.topic, row.length) == ("a b.pdf", "Phase 1", "Theory", "Growth", 4)
    (tmp_path / "terms.json").write_text(json.dumps({"economic": [["growth", "boom", "rise"], []]}))
    assert [tuple(r) for r in io.term_maps(spark, str(tmp_path / "terms.json")).collect()] == [("economic", "growth", ["boom", "rise"])]
    (tmp_path / "q.json").write_text('{"id": "1", "query": "x", "expected_doc_ids": ["a", "REPLACE_ME", ""], "n_results": 5}\n')
    assert io.query_set(spark, str(tmp_path / "q.json")).first().expected_doc_ids == ["a"]
    replies = spark.createDataFrame([(1, '```json\n[{"claim": " A "}, {"claim_text": "B"}, {"claim": ""}]\n```'), (2, '[{"claim": "C"}]'), (3, "sorry")], "doc_id int, raw string")
    assert sorted(tuple(r) for r in io.parse_claims(replies).collect()) == [(1, "A"), (1, "B"), (2, "C")]
    graph = spark.createDataFrame([(1, '{"entities": [{"name": "X"}, {"name": " "}], "relations": [{"source": "X", "target": "Y"}]}')], "claim_id int, raw string")
    entities, relations = io.parse_graph(graph)
    assert [tuple(r) for r in entities.collect()] == [(1, "X", "concept")] and [tuple(r) for r in relations.collect()] == [(1, "X", "Y", "related_to")]


def test_order_statistics_are_exact_when_one_value_is_most_of_a_group(spark):
    import statistics

    groups = {"hot": [5.0] * 70 + [float(k) for k in range(31)], "few": [3.0, 1.0], "one": [2.0, 2.0, 2.0], "wide": [1e-9, 1e12, 7.0, 8.0, -4.0] * 5}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v double")
    out = {r.g: r for r in stats.latency_summary(rows, "g", "v").collect()}
    for g, vs in groups.items():
        assert out[g].n == len(vs) and out[g].median == round(statistics.median(vs), 6)
        assert out[g].p95 == (round(sorted(vs)[int(0.95 * len(vs))], 6) if len(vs) >= 20 else None)
    assert stats.latency_summary(rows.limit(0), "g", "v").count() == 0


def test_clusters_are_numbered_by_their_least_member(spark):
    for kind, name in (("long", lambda k: 10**12 * k), ("string", lambda k: f"n{k:02}")):
        edges = spark.createDataFrame([(name(a), name(b)) for a, b in ((9, 3), (3, 7), (2, 8), (5, 4), *((3, k) for k in range(20, 40)))], f"src {kind}, dst {kind}")
        found = knowledge.clusters(edges, "src", "dst")
        first = {r.cluster: r.component for r in found.select("cluster", "component").distinct().collect()}
        assert first == {"cluster_1": name(2), "cluster_2": name(3), "cluster_3": name(4)}
        table = {r.cluster: (r.n_nodes, r.covers) for r in knowledge.cluster_table(found).collect()}
        assert table["cluster_2"] == (23, ", ".join(str(name(k)) for k in (3, 7, 9, 20, 21, 22)))
    assert knowledge.clusters(edges.limit(0), "src", "dst").count() == 0


def test_approximate_search_finds_nine_in_ten(spark):
    import numpy as np

    points = np.random.default_rng(3).normal(size=(300, 32))
    points[100:] += 2 * points[:200]
    corpus = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "chunk_id long, embedding array<float>")
    asked = corpus.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    pairs = lambda df: {(r.query_id, r.chunk_id) for r in df.collect()}
    exact = pairs(dense.dense_topk(asked, corpus))
    index = dense.fit_cells(corpus, cells=32)
    assert len(exact & pairs(dense.lsh_topk(asked, corpus, index=index))) >= 0.9 * len(exact)
    met = dense._in_cells(asked, index, "query_id", 3).alias("q").join(dense._in_cells(corpus, index, "chunk_id", 1).alias("c"), "cell").select("q.id", "c.id").distinct().count()
    assert met <= 0.35 * 300 * asked.count()
    assert dense.lsh_topk(asked, corpus.limit(0)).count() == 0


def test_approximate_search_makes_no_row_of_a_pair(spark, monkeypatch):
    """The k nearest of the pairs that share a cell, as a join of them gives; here in several blocks and parts, with odd vectors and repeated ids."""
    points = np.random.default_rng(5).normal(size=(400, 16))
    points[200:300] = points[100:200]
    rows = [(f"c{k % 390}", p.tolist()) for k, p in enumerate(points)]
    corpus = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points[::20])], "query_id int, embedding array<float>")
    index = dense.fit_cells(corpus, cells=20)
    met = dense._in_cells(asked, index, "query_id", 2).alias("q").join(dense._in_cells(corpus, index, "chunk_id", 1).alias("c"), "cell")
    d = {}
    for r in met.select(F.col("q.id").alias("q"), F.col("c.id").alias("c"), F.round(1 - dense.dot(F.col("q.unit"), F.col("c.unit")), 6).alias("d")).collect():
        d.setdefault(r.q, {})[r.c] = min(r.d, d.get(r.q, {}).get(r.c, 9))
    want = {(q, n + 1, c, x) for q, of in d.items() for n, (x, c) in enumerate(sorted((x, c) for c, x in of.items())[:10])}
    odd = spark.createDataFrame([("z1", None), ("z2", [1.0]), ("z3", [float("nan")] * 16)], "chunk_id string, embedding array<float>")
    monkeypatch.setattr(dense, "QUERY_BLOCK", 7)
    monkeypatch.setattr(dense, "CELLS", 100)
    found = dense.lsh_topk(asked, corpus.unionByName(odd), index=index)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.schema["query_id"].dataType.simpleString() == "int"
    got = {tuple(r) for r in found.collect()}
    assert {(q, n, round(x, 5)) for q, n, _, x in got} == {(q, n, round(x, 5)) for q, n, _, x in want} and len(got & want) >= 0.98 * len(want)


def test_section_chunks_keep_sections_whole(spark):
    long = " ".join(f"word{k}." for k in range(900))
    rows = [(1, 1, "abstract", long), (1, 2, "other", "short"), (2, 1, "methods", ""), (3, 1, "methods", None), (3, 2, None, "x" * 2500)]
    sections = spark.createDataFrame(rows, "doc_id long, section_no long, section_type string, content string")
    out = chunking.section_chunks(sections, {"abstract": 1500}).orderBy("doc_id", "chunk_index").collect()
    assert "".join(r.text for r in out if (r.doc_id, r.section_no) == (1, 1)) == long
    assert max(len(r.text) for r in out if r.section_type == "abstract") <= 1500
    assert [len(r.text) for r in out if r.doc_id == 3] == [1000, 1000, 500]
    assert [r.chunk_index for r in out if r.doc_id == 1] == list(range(sum(r.doc_id == 1 for r in out))) and not [r for r in out if r.doc_id == 2]
    assert chunking.section_chunks(sections.limit(0), {}).count() == 0


def test_text_vectors(spark):
    rows = [(1, "green valley coal"), (2, "green valley coal"), (3, "steel works and rivers"), (4, None), (5, "")]
    found = {r.chunk_id: r.embedding for r in dense.text_vectors(spark.createDataFrame(rows, "chunk_id long, text string")).collect()}
    assert found[1] == found[2] != found[3] and abs(sum(x * x for x in found[3]) - 1) < 1e-5
    assert not any(found[4]) and not any(found[5])


def test_quotes_without_text_or_document(spark):
    cases = spark.createDataFrame([(1, 1, "a b c"), (2, 1, ""), (3, 9, "a b c"), (4, 1, None), (5, None, "a b c")], "case_id long, doc_id long, quote string")
    docs = spark.createDataFrame([(1, "x A b  c y"), (2, None)], "doc_id long, text string")
    assert {r.case_id: r.similarity for r in knowledge.quote_similarity(cases, docs).collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}


def test_authors_and_years_of_awkward_texts(spark):
    rows = spark.createDataFrame([(None,), ("",), ("by Karl Weber and by Karl Weber",), ("BY KARL WEBER",), ("© 2004 in 1999",), ("2099",)], "text string")
    out = rows.select(T.text_authors(F.col("text")).alias("a"), T.plain_year(F.col("text"), 2024).alias("y")).collect()
    assert [r.a for r in out] == [None, [], ["Karl Weber"], [], [], []] and [r.y for r in out] == [None, None, None, None, 2004, None]


def test_all_names_of_a_line_are_mentions_and_edges(spark):
    names = [f"{a}{b} Mc" + "abcdefghijklmnopqrstuvwxyz"[k % 26] for k, (a, b) in enumerate((a, b) for a in ("Ada", "Bela", "Cora", "Dora", "Eva", "Fay") for b in "abcde")]
    names = [n.replace("Mc", "M") for n in names]
    docs = spark.createDataFrame([(1, ", ".join(names) + f"; {names[0]}\n{names[0]}, {names[29]}"), (2, f"{names[28]}, {names[29]}")], "doc_id long, text string")
    mentions = knowledge.entity_mentions(docs)
    assert {r.name for r in mentions.where("doc_id = 1 and paragraph = 1").collect()} == set(names) and mentions.count() == 34
    found = {r.name: (r.mentions, r.n_docs) for r in knowledge.upsert_entities(mentions, ["doc_id", "paragraph"]).collect()}
    assert found[names[29]] == (3, 2) and len(found) == 30
    want = {tuple(sorted((x, y))): 1 for x in names for y in names if x != y}
    want[tuple(sorted((names[0], names[29])))] += 1
    want[tuple(sorted((names[28], names[29])))] += 1
    for part in (256, 7):
        assert {(r.source, r.target): r.weight for r in knowledge.cooccurrence_edges(mentions, part=part).collect()} == want


def test_file_names_and_plain_authors(spark):
    names = ["2012_Keller_Report.pdf", "Stein-2011.pdf", "a/Keller_Stein_2010.docx", "brandt2009_x", "Review_2003", "notes", None]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k long, n string").orderBy("k")
    got = rows.select(T.filename_authors(F.col("n")).alias("a"), T.filename_year(F.col("n"), 2024).alias("y")).collect()
    assert [r.a for r in got] == [["Keller"], ["Stein"], ["Keller", "Stein"], ["Brandt"], None, None, None] and [r.y for r in got] == [None, 2011, None, None, None, None, None]
    texts = [("Head\nOn Rivers\nSandra Anders and Jo Land1\nAbstract\nBy No One", "on rivers"), ("x\nby Ann Lee & Bo Ray", None), ("", "t"), (None, None)]
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "k long, t string, h string").orderBy("k")
    assert [r[0] for r in rows.select(T.plain_authors(F.col("t"), F.col("h"))).collect()] == [["Sandra Anders", "Jo Land"], ["by Ann Lee", "Bo Ray"], None, None]


def test_candidate_sizes_and_reranking(spark):
    assert fusion.candidate_sizes(5) == {"sparse": 50, "dense": 50, "fused": 10} and fusion.candidate_sizes(30, rerank=40) == {"sparse": 50, "dense": 90, "fused": 60}
    assert fusion.candidate_sizes(20, "base") == {"sparse": 50, "dense": 60, "fused": 40} and fusion.candidate_sizes(5, "dense", 20)["dense"] == 20
    rows = spark.createDataFrame([(1, k, k + 1, 0.5) for k in range(4)], "query_id long, chunk_id long, rank long, score double")
    scores = spark.createDataFrame([(1, 2, 0.9), (1, 0, 0.1)], "query_id long, chunk_id long, score double")
    assert [r.chunk_id for r in fusion.rerank_by(rows, scores, 3).orderBy("rank").collect()] == [2, 0, 1]


def test_saved_index_is_built_once(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "green valley"), (2, "coal valley")], "chunk_id long, text string")
    first = bm25.ensure_index(spark, f"{tmp_path}/i", chunks)
    again = bm25.ensure_index(spark, f"{tmp_path}/i", chunks.limit(0))
    assert first.postings.count() == again.postings.count() == 4 and {r.df for r in again.terms.where("term = 'valley'").collect()} == {2}


def test_models_of_the_caller(spark):
    out = io.with_model(spark.range(5), lambda frame: frame.assign(score=frame["id"] * 0.5), "id long, score double")
    assert {r.id: r.score for r in out.collect()} == {k: k / 2 for k in range(5)}


def test_hierarchy_without_repeated_chunks(spark):
    same, other, tail = "a " * 60, "b " * 60, "c " * 60
    rows = [(0, 0, same, [same + "x", other]), (1, 1, same, [tail]), (2, 2, tail, [tail + "y", other, "d " * 60])]
    chunks = [(7, f"7_parent_{n}", None, "parent", None, text) for n, _, text, _ in rows]
    chunks += [(7, f"7_child_{n}{k}", f"7_parent_{n}", "child", k, text) for n, _, _, below in rows for k, text in enumerate(below)]
    df = spark.createDataFrame(chunks, "doc_id long, chunk_id string, parent_id string, chunk_type string, child_position long, text string")
    got = {(r.chunk_id, r.parent_id, r.text[0]) for r in chunking.hierarchy_dedupe(df).collect()}
    # the second parent repeats the first and takes its child along, so the third, which begins like that child, stays; first children repeat their parents
    want = {("7_parent_0", None, "a"), ("7_child_0", "7_parent_0", "b"), ("7_parent_2", None, "c"), ("7_child_1", "7_parent_2", "d")}
    assert got == want
    assert chunking.hierarchy_dedupe(df.limit(0)).count() == 0


def test_overlapping_sections_give_themselves_again(spark):
    text = " ".join(f"word{k}." for k in range(600))
    out = chunking.section_chunks(spark.createDataFrame([(1, 0, "abstract", text)], "doc_id long, section_no int, section_type string, content string"), {"abstract": 1500}, overlap=300)
    rows = out.orderBy("chunk_index").collect()
    assert "".join(r.text[r.shared :] for r in rows) == text and all(len(r.text) <= 1500 for r in rows) and all(0 < r.shared <= 300 for r in rows[1:])


def test_deleting_reaches_tables_below(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, chunk_id string")
    postings = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "chunk_id string, term string")
    gone = spark.createDataFrame([(2,)], "doc_id long")
    left = tenancy.delete_document({"chunks": chunks, "postings": postings}, gone, {"postings": ("chunks", "chunk_id")})
    assert [tuple(r) for r in left["postings"].collect()] == [("a", "x")]


def test_sections_of_awkward_texts(spark):
    long = "Methods: \n" + "word " * 30_000 + "\nAbstract: x"
    texts = ["lead\nAbstract: " + "a" * 100 + "\n\n \tb\nAbstract\nSummary " + "c" * 100 + "\n  Results:", None, "", "\n \n", "no heading", long]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").unionByName(spark.createDataFrame([(9, texts[0])], "doc_id int, text string"))
    found = T.sections(rows, P.SECTION_HEADINGS, P.EXPECTED_SECTIONS)
    first = [(1, "abstract", "Abstract: " + "a" * 100 + "\n \tb\nAbstract"), (2, "abstract", "Summary " + "c" * 100)]
    out = sorted((r.doc_id, r.section_no, r.section_type, r.content, r.confidence) for r in found.collect())
    assert out == [(0, *f, 0.2) for f in first] + [(5, 1, "methods", long[: -len("\nAbstract: x")].strip(), 0.2)] + [(9, *f, 0.2) for f in first]
    assert T.sections(rows.limit(0), P.SECTION_HEADINGS, P.EXPECTED_SECTIONS).count() == 0
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_keywords_of_awkward_texts(spark):
    rows = spark.createDataFrame([("Über Bonn and Bonn\nLa Tour_d Café",), ("Keywords - abc;\td e f \nghi, no\nlast",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.topical_keywords(F.col("t"), [r"and \w+"])).collect()] == [["Bonn", "Bonn\nLa", "and Bonn"], ["Keywords"], [], None]
    assert [r[0] for r in rows.select(T.keyword_line(F.col("t"))).collect()] == [[], ["abc", "d e f \nghi"], [], None]


def test_csv_keeps_values(spark, tmp_path):
    kept = [(1, ' a "b", c '), (2, "back\\slash"), (3, "x")]
    io.write_csv(spark.createDataFrame(kept, "k int, v string"), f"{tmp_path}/c")
    spaces = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    assert sorted(tuple(r) for r in spark.read.options(header="true", escape='"', **spaces).schema("k int, v string").csv(f"{tmp_path}/c").collect()) == kept

"""The pipeline on a small corpus with planted cases."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm.test_operators import prose


def test_stages_take_effect(spark, tmp_path):
    draw = random.Random(21)
    items = [prose(draw, 60) for _ in range(3)]
    good = [prose(draw, 120) + "." for _ in range(60)]
    junk = [" | ".join(w.upper() + "!!" for w in prose(draw, 120).split()) for _ in range(30)]
    texts = [*good, *junk, good[0], f"{good[1]} {items[2]} {prose(draw, 40)}.", f"{prose(draw, 100)}. mail me@site.example.com {prose(draw, 20)}."]
    rows = [(k, t, "en", "s", len(t), "extra") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, predicted string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, int(k < 60), 0) for k in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    kept, ids = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == docs.columns
        ids.append({r.doc_id for r in kept.collect()})
    assert ids[0] == set(range(93)) - set(range(60, 90))
    assert ids[1] == ids[0] - {90} and ids[2] == ids[1] - {91} and ids[3] == ids[2]
    redacted = kept.where("doc_id = 92").first()
    assert "[EMAIL]" in redacted.text and "@" not in redacted.text and redacted.n_chars == len(redacted.text)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids[3]


def test_stages_of_awkward_and_empty_tables(spark, tmp_path):
    draw = random.Random(22)
    text = prose(draw, 120) + "."
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (None, text, None, None, None), (None, None, None, None, None), (2, "", "en", "s", 0), (2, prose(draw, 130), None, "s", 1), (3, " ".join(f"word{k}." for k in range(40_000)), "en", None, 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, part, labels in (("full", rows, [(1, 1, 0), (2, 1, 0), (None, 0, 0), (9, None, None)]), ("empty", [], []), ("unlabelled", rows, [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(part, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(0, prose(draw, 30)), (None, None)] if part else [], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        docs = spark.createDataFrame(part, schema)
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            docs = stage(spark, docs, at).cache()
            assert docs.columns == schema.replace(",", "").split()[::2]
        kept = sorted((r.doc_id or 0, len(r.text or "")) for r in docs.collect())
        assert [k for k, _ in kept] == ([1, 2, 2, 3] if part else [])
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, at)
        assert pieces.select("doc_id").distinct().count() == len({k for k, _ in kept})
        assert corpus_pipeline.run(spark, at).count() >= 0

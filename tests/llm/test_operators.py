"""Each operator on small tables: brute force, edge cases, recovery of planted cases."""

from __future__ import annotations

import os
import random
import re
import time
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import decontam, html_text, langid, packing, pii, quality_model, quality_rules, queries, sharding, simhash, token_counts
from corpusloom.llm.tokens import WordEncoder, default_path
from corpusloom.operators import sampling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, words string, rank string"


def table(spark, texts, start=0):
    """Rows with null columns, and columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(start + k, t, None, "s" if k % 3 else None, None, "x", "y", "z", "r") for k, t in enumerate(texts)], SCHEMA)


def awkward(spark):
    long = " ".join(f"word{k} and" for k in range(30_000))
    rows = table(spark, [None, "", " \n\t ", "word", "a b", long, "same text here", "same text here", "日本語 text é", "#" * 50])
    return rows.unionByName(rows.where("doc_id = 6")).unionByName(rows.where("doc_id = 7").withColumn("doc_id", rows.doc_id + None))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


WORDS = [a + b + c for a in ("ba", "ko", "mi", "tu", "re", "sa") for b in ("lo", "n", "ri", "mu", "") for c in ("da", "s", "ve", "nt", "o")]


def prose(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


# -- 1


def brute_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_pii_accounts_after_any_cue_and_fillers():
    finder = pii.PiiFinder()
    forms = ["Account No: {}", "Account Number: {}", "account number is {}", "ACCOUNT ID = {}", "apiKey {}", "ApiKey: {}", "account no. {}", "Account No. is: {}", "İ aCcOuNt NUMBER IS '{}'", "account id{}", "acct: number {}"]
    for form in forms:
        text, at = form.format("12345678"), form.index("{")
        assert ("account", at, at + 8) in finder.spans(text), text
    for cue in ("iBan", "IBAN", "IBAN No", "Iban number is"):
        for value in ("NO9386011117947", "NO93 8601 1117 947", "IS140159260076545510730339"):
            assert ("account", len(cue) + 1, len(cue) + 1 + len(value)) in finder.spans(f"{cue} {value}"), (cue, value)
    assert pii.redact_text("Account Number: 12345678.", finder.spans("Account Number: 12345678.")) == "Account Number: [ACCOUNT]."
    assert not finder.spans("account no way") and not finder.spans("account " + " " * 20_000 + "is")


def test_pii_base_kinds_equal_brute_force():
    draw, finder = random.Random(3), pii.PiiFinder()
    parts = ["@", ".", "+", "-", " ", "1", "2", "45", "0", "(", ")", "a", "b.c", "é", "255", "4111111111111111", "\n", "x@y.z", "://", "token", "IBAN ", "=", "1.2.3.4", "٣"]
    for _ in range(8000):
        t = "".join(draw.choice(parts) for _ in range(draw.randint(0, 30)))
        assert [s for s in finder.spans(t) if s[0] in pii.KINDS[:4]] == brute_pii(t)


def test_pii_method_kinds_and_redaction(spark):
    text = 'to a.b@c.de. IBAN DE89 3704 0044 0532 0130 00 token = "9af3c2b1" see https://h.org/x?y. Password: none'
    found = pii.PiiFinder().spans(text)
    assert [text[a:b] for _, a, b in found] == ["a.b@c.de", "DE89 3704 0044 0532 0130 00", "9af3c2b1", "https://h.org/x?y"]
    df = table(spark, [text, None, ""])
    out = pii.redact_pii(df).orderBy("doc_id").collect()
    assert out[0].text == 'to [EMAIL]. IBAN [ACCOUNT] token = "[ACCOUNT]" see [ADDRESS]. Password: none'
    assert out[1].text is None and out[2].text == "" and out[0].source == df.orderBy("doc_id").first().source
    assert pii.find_pii(awkward(spark)).count() == 12 and pii.find_pii(empty(spark)).count() == 0


# -- 2

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>First   para<br>line two.<p>Second <a href=x>link</a> &lt;b&gt;.</p><aside class="ad">Buy now</aside><script>var a="<p>no</p>";</script>
<ul><li>one<li>two</ul><form><label>Mail</label></form></article><section id="comments"><div class="comment"><p>Nice post.</p></div></section><footer>&copy; me</footer>"""


@pytest.fixture(scope="module")
def labeller():
    said = prose(random.Random(41), 3000).split()
    return html_text.fit_labeller([*[html_text.page_lesson(PAGE, html_text.Featurizer())] * 5, ([], said)])


def test_html_blocks_decode_and_close():
    texts = [b.text for b in html_text.blocks(PAGE)]
    assert texts == ["T", "Home", "We use cookies", "Title & more", "First para line two.", "Second link <b>.", "Buy now", "one", "two", "Mail", "Nice post.", "© me"]
    assert html_text.blocks(None) == [] and html_text.blocks("<!-- open") == []
    assert [b.text for b in html_text.blocks('a < b <p title="x>y">c &am')] == ["a < b", "c &am"]


def test_html_main_text(spark, labeller):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", "t"), (1, "u", PAGE, "t")], "page_id long, url string, html string, text string")
    rows = html_text.extract_text(pages, labeller).collect()
    assert len(rows) == 4
    assert [r.text for r in rows if r.page_id == 1] == ["Title & more\nFirst para line two.\nSecond link <b>.\none\ntwo"] * 2
    assert [(r.text, r.n_chars) for r in rows if r.page_id != 1] == [("", 0)] * 2
    assert html_text.extract_text(pages.limit(0), labeller).count() == 0
    texts = [t for t in html_text.extract_text(awkward(spark).withColumn("html", F.col("text")), labeller, "doc_id", keep=("words", "id")).collect()]
    assert len(texts) == 12 and {(t.words, t.id) for t in texts} == {("z", "x")}
    learnt = html_text.learn_blocks(pages.unionByName(pages))
    assert [r.text for r in html_text.extract_text(pages, learnt).where("page_id = 1").collect()] == ["Title & more\nFirst para line two.\nSecond link <b>.\none\ntwo"] * 2
    assert html_text.extract_text(pages, html_text.learn_blocks(pages.limit(0))).count() == 4


def test_html_very_long_pages_are_read_whole(spark, labeller):
    words = [f"word{k}" for k in range(60_000)]
    tall = "".join(f"<p>{w} and some more of it.</p>" for w in words[:20_000])
    pages = spark.createDataFrame([(1, f"<article><p>{' '.join(words)}</p></article>"), (2, f"<article>{tall}</article>")], "page_id long, html string")
    got = {r.page_id: r for r in html_text.extract_text(pages, labeller, keep=()).collect()}
    assert got[1].text == " ".join(words) and got[2].n_blocks == 20_000 and got[2].n_main > 19_000
    taught, said = html_text.page_lesson(f"<article>{tall}</article>", html_text.Featurizer())
    assert len(taught) == html_text.TRAIN_RUNS and max(len(y) for _, y in taught) <= html_text.TRAIN_BLOCKS and len(said) <= html_text.TRAIN_WORDS


def test_html_text_of_formulas_and_fallbacks_stays():
    found = [b.text for b in html_text.blocks("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds <noscript>always</noscript><script>no()</script> here</p>")]
    assert found == ["so x=2 holds always here"]


def test_html_gradients_are_the_slopes_of_the_loss():
    draw, model = np.random.default_rng(5), html_text.BlockLabeller.fresh()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, mask = draw.normal(size=(5, 3, html_text.INPUTS)), np.ones((5, 3))
    mask[3:, 1] = mask[1:, 2] = 0
    gold = draw.integers(0, 2, (5, 3)).astype(float)

    def loss():
        p = model.forward(x, mask)[0]
        return -(np.log(np.where(gold == 1, p, 1 - p)) * mask).sum() / mask.sum()

    for name, slope in model.gradients(x, mask, gold).items():
        for at in [tuple(draw.integers(0, n) for n in slope.shape) for _ in range(6)]:
            kept = model.w[name][at]
            model.w[name][at] = kept + 1e-3
            high = loss()
            model.w[name][at] = kept - 1e-3
            low = loss()
            model.w[name][at] = kept
            assert abs((high - low) / 2e-3 - slope[at]) < 2e-4, name


@pytest.mark.parametrize("kind, least", [("usual", 0.97), ("words", 0.93), ("none", 0.9)])
def test_html_held_out_layouts(labeller, kind, least):
    draw, features, right, total = np.random.default_rng(99), html_text.Featurizer(), 0, 0
    for _ in range(100):
        found, gold = html_text.lay_out(WORDS, draw, kind)
        right += int(((labeller.label([features.page(found)])[0] >= 0.5) == np.array(gold)).sum())
        total += len(gold)
    assert right / total > least


@pytest.mark.parametrize("menu, comments, footer", [("menu", "comments", "footer"), ("navi", "kommentare", "fuss"), ("k1", "k3", "k2"), ("site-links", "responses", "bottom")])
def test_html_labels_do_not_hang_on_names(labeller, menu, comments, footer):
    draw = random.Random(40)
    body = [prose(draw, n) for n in (5, 40, 25, 60, 30)]
    page = f"""<html><body><div class="{menu}"><ul><li><a href=x>{prose(draw, 1)}</a></li><li><a href=x>{prose(draw, 2)}</a></li><li><a href=x>{prose(draw, 1)}</a></li></ul></div>
    <div class="post"><h1>{body[0]}</h1><p>{body[1]}</p><p>{body[2]}</p><p>{body[3]}</p><p>{body[4]}</p></div>
    <div class="{comments}"><div class="c"><p>{prose(draw, 6)}</p></div><div class="c"><p>{prose(draw, 9)}</p></div></div><div class="{footer}">{prose(draw, 5)}</div></body></html>"""
    found = html_text.blocks(page)
    shown = labeller.label([html_text.Featurizer().page(found)])[0] >= 0.5
    assert [b.text for b, s in zip(found, shown, strict=True) if s] == body


@pytest.mark.parametrize("page, blocks", [("<div>x" * 100_000, 100_000), ("<div><p>x</b></p></i>" * 50_000, 50_000), ("<b>" * 200_000 + "<div>x", 1), ("<li><span>y</td>" * 50_000, 50_000)])
def test_html_time_is_linear_in_nesting(labeller, page, blocks):
    began = time.time()
    found = html_text.blocks(page)
    rows = html_text.Featurizer().page(found)
    assert len(found) == blocks and len(labeller.label([rows])[0]) == blocks
    assert time.time() - began < 20  # a few seconds; what grows with the square takes hours


def test_html_both_directions_at_once_are_each_alone(labeller):
    draw = np.random.default_rng(6)
    x, mask = draw.normal(size=(7, 3, html_text.INPUTS)).astype(np.float32), np.ones((7, 3), dtype=np.float32)
    mask[4:, 1] = mask[1:, 2] = 0
    one, together = labeller.forward(x, mask)[0], labeller.forward(x, mask, learning=False)[0]
    assert np.allclose(one * mask, together * mask, atol=1e-5)


# -- 3


def brute_alignment(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), dtype=int), 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment_equals_brute_force():
    draw = np.random.default_rng(4)
    for _ in range(300):
        a, b = draw.integers(0, 4, draw.integers(1, 12)), draw.integers(0, 4, draw.integers(1, 20))
        score, first, last = decontam.alignment(a, b)
        assert score == brute_alignment(a, b)
        assert not score or brute_alignment(a, b[first:last]) == score


def test_decontamination_finds_copies_and_edits(spark):
    draw = random.Random(8)
    items = [prose(draw, 60) for _ in range(6)]
    words = items[1].split()
    edited = " ".join(draw.choice(WORDS) if k % 7 == 3 else w for k, w in enumerate(words) if k % 11 != 5)
    docs = [prose(draw, 300) for _ in range(40)] + [f"{prose(draw, 50)} {items[0].upper()}. {prose(draw, 90)}", f"{prose(draw, 20)}\n{edited}, {prose(draw, 30)}", None, ""]
    bench = spark.createDataFrame([(k, t, 0) for k, t in enumerate([*items, None, "too short"])], "item_id long, text string, doc_id long")
    df = table(spark, docs)
    found = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated_passages(df, bench).collect()}
    assert set(found) == {(40, 0), (41, 1)} and found[40, 0] == 1.0 and found[41, 1] < 1.0
    assert {r.doc_id for r in decontam.decontaminate(df, bench).collect()} == set(range(44)) - {40, 41}
    same = df.withColumn("doc_id", F.when(F.col("doc_id") < 41, F.lit(7).cast("long")))
    assert decontam.decontaminate(same, bench).count() == 42 and decontam.decontaminate(same, bench).columns == same.columns
    assert decontam.decontaminate(empty(spark), bench).count() == 0 and decontam.decontaminate(awkward(spark), bench).count() == 12
    assert decontam.decontaminate(df, bench.limit(0)).count() == 44
    assert decontam.contaminated_passages(empty(spark), bench).count() == 0
    assert decontam.contaminated_passages(df, bench.limit(0)).count() == 0
    assert decontam.contaminated_passages(awkward(spark), bench).count() == 0


def test_decontamination_finds_an_edit_that_is_far_more_common_than_the_item(spark):
    draw = random.Random(9)
    item = prose(draw, 40).split()
    edited = " ".join([*item[:18], "otherwise", "put", *item[20:]])
    docs = [f"{prose(draw, 9)} {' '.join(item)}", *(f"{prose(draw, 9)} {edited} {k}" for k in range(60)), " ".join(item[:6])]
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in decontam.contaminated_passages(table(spark, docs), bench).collect()} == set(range(61))


def test_decontamination_finds_items_with_every_fifth_or_third_word_replaced(spark):
    draw = random.Random(10)
    items = [prose(draw, n).split() for n in (59, 15, 20, 38)]
    fifth = [" ".join(f"new{k}" if k % 5 == 4 else w for k, w in enumerate(item)) for item in items]
    third = [" ".join(f"new{k}" if k % 3 == 2 else w for k, w in enumerate(item)) for item in items]
    spread = [" ".join(f"{w} new{k}" if k % 2 else w for k, w in enumerate(item)) for item in items]
    docs = [f"{prose(draw, 40)} {t} {prose(draw, 40)}" for t in (*fifth, *third, *spread)] + [prose(draw, 400) for _ in range(30)]
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated_passages(table(spark, docs), bench).collect()}
    hashes = [decontam.word_hashes(" ".join(t)) for t in items]
    true = {(d, k) for d, t in enumerate(docs) for k, h in enumerate(hashes) if decontam.alignment(h, decontam.word_hashes(t))[0] >= len(h)}
    assert found == true and {(k, k % 4) for k in range(4)} <= found and len(found) >= 12


def test_decontamination_finds_a_common_edit_that_shares_one_run_of_five_words(spark):
    draw = random.Random(12)
    item = [f"w{k}" for k in range(15)]
    edited = " ".join("other" if k in (4, 9) else w for k, w in enumerate(item))
    docs = [" ".join(item), *(f"{prose(draw, 9)} {edited} {k}" for k in range(60)), *(f"{edited} {prose(draw, 9)}" for _ in range(60)), edited]
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    found = {r.doc_id: r.score for r in decontam.contaminated_passages(table(spark, docs), bench).collect()}
    assert set(found) == set(range(122)) and found[0] == 1.0 and all(abs(found[k] - 0.8) < 1e-9 for k in range(1, 122))


def test_decontamination_equals_alignment_of_all_pairs(spark):
    """Recall of copies with every k-th word edited, replaced, dropped or doubled, against all pairs."""
    draw = random.Random(14)
    items = [prose(draw, n).split() for n in (7, 12, 15, 20, 28, 38, 60)]
    edits = {
        "replaced": lambda w, k: [f"new{k}"],
        "dropped": lambda w, k: [],
        "doubled": lambda w, k: [w, f"new{k}"],
        "swapped": lambda w, k: [f"other{k}", w],
    }
    docs = [f"{prose(draw, 30)} {' '.join(x for k, w in enumerate(item) for x in (edit(w, k) if k % every == every - 1 else [w]))} {prose(draw, 30)}" for every in (3, 4, 5, 6, 8) for edit in edits.values() for item in items]
    docs += [prose(draw, 200) for _ in range(40)]
    hashes, texts = [decontam.word_hashes(" ".join(t)) for t in items], [decontam.word_hashes(t) for t in docs]
    true = {(d, k): decontam.alignment(h, t)[0] / (2 * len(h)) for d, t in enumerate(texts) for k, h in enumerate(hashes) if decontam.alignment(h, t)[0] >= len(h)}
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated_passages(table(spark, docs), bench).collect()}
    assert got == pytest.approx(true) and len(true) > 120


def test_every_alignment_of_the_score_holds_the_seeds():
    draw = random.Random(11)
    near = 0
    for _ in range(6000):
        n = draw.randint(7, 26)
        item, text, fresh = np.arange(n), [], 1000
        rates = [draw.random() for _ in range(3)]
        for word in item:
            for _ in range(draw.choice((0, 1, 2, 3)) if draw.random() < rates[0] else 0):
                text.append(fresh := fresh + 1)
            if draw.random() < rates[1] / 2:
                if draw.random() < rates[2]:
                    text.append(fresh := fresh + 1)
            else:
                text.append(int(word))
        text = np.array([*range(500, 520), *text, *range(600, 620)])
        if decontam.alignment(item, text)[0] >= n:
            near += 1
            passages = list(decontam.SeedIndex([item], 0.5).passages([text]))
            assert max(decontam.alignment(item, text[first:end])[0] for _, _, first, end in passages) == decontam.alignment(item, text)[0]
    assert near > 1000


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 6, 7])
def test_decontamination_finds_short_items(spark, size):
    """Every copy of an item of few words, and every edited one from five words on, against all pairs."""
    draw = random.Random(30 + size)
    items = [[f"q{size}x{k}y{j}" for j in range(size)] for k in range(12)]
    docs = [prose(draw, 60) for _ in range(10)]
    for item in items:
        for _ in range(4):
            text = []
            for w in item:
                text += [draw.choice(WORDS)] * draw.choice((0, 0, 0, 1, 2))
                text += [w] if draw.random() < 0.75 else [draw.choice(WORDS)] * draw.choice((0, 1))
            docs.append(f"{prose(draw, 15)} {' '.join(text)} {prose(draw, 15)}")
        docs += [f"{prose(draw, 5)} {' '.join(item).upper()}, {prose(draw, 5)}", " ".join(item)]
    hashes, texts = [decontam.word_hashes(" ".join(t)) for t in items], [decontam.word_hashes(t) for t in docs]
    score = {(d, k): decontam.alignment(h, t)[0] / (2 * size) for d, t in enumerate(texts) for k, h in enumerate(hashes)}
    true = {at: s for at, s in score.items() if s >= (0.5 if size >= 5 else 1)}
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    df = table(spark, docs)
    assert {(r.doc_id, r.item_id): r.score for r in decontam.contaminated_passages(df, bench).collect()} == pytest.approx(true) and len(true) >= 24
    assert {r.doc_id for r in decontam.decontaminate(df, bench).collect()} == set(range(len(docs))) - {d for d, _ in true}


def test_decontamination_reads_scripts_without_spaces(spark):
    item, other = "機械学習の評価に使われる文章は訓練資料から除かれる", "ภาษาไทยไม่มีช่องว่างระหว่างคำในประโยคเดียวกัน"
    docs = [f"前置きの文。{item}そして続き。", f"本文の前{item[:9]}別の{item[10:]}後", "全く別の日本語の文章であり何も含まない。", f"ก่อน{other}หลัง", "plain text"]
    bench = spark.createDataFrame([(0, item), (1, other)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated_passages(table(spark, docs), bench).collect()}
    assert set(found) == {(0, 0), (1, 0), (3, 1)} and found[0, 0] == found[3, 1] == 1.0 and 0.8 < found[1, 0] < 1


def test_rare_middles_let_every_document_with_enough_seeds_meet():
    draw = random.Random(31)
    items = [np.array([draw.randrange(30) for _ in range(draw.randint(1, 20))]) for _ in range(40)]
    index = decontam.SeedIndex(items, 0.5)
    index.rare = index.rare_entries({int(m): draw.randrange(9) for m in index.middles})
    for k, least in enumerate(index.least):
        own = set(index.middles[index.owners == k].tolist())
        rare = set(index.middles[(index.owners == k) & index.rare].tolist())
        assert len(rare) == max(0, len(own) - least + 1) and (len(items[k]) < 7 or len(rare) < len(own) or least == 1)
    loose = decontam.SeedIndex(items, 0.5)
    loose.rare = np.ones(len(loose.owners), bool)
    texts = [np.array([draw.randrange(30) for _ in range(60)]) for _ in range(60)]
    found = [{(t, k) for t, k, *_ in decontam._alignments(i, texts, 0.5, {})} for i in (index, loose)]
    assert found[0] == found[1] and found[0]


# -- 4


def test_shards_are_even_and_hold_the_mixture(spark):
    rows = spark.createDataFrame([(k, "x" * (k % 50), "hot" if k % 3 == 0 else f"s{k % 7}") for k in range(3000)], "doc_id long, text string, source string")
    out = sharding.stratified_shards(rows).join(rows.drop("text"), "doc_id").collect()
    by = Counter(r.shard for r in out)
    assert sorted(by) == list(range(16)) and max(by.values()) - min(by.values()) <= 1
    for s in by:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(by[s]))
        mixture = Counter(r.source for r in out if r.shard == s)
        assert abs(mixture["hot"] - by[s] / 3) <= 2
    assert all(r.size == r.doc_id % 50 + 1 and r.text_crc32 == crc32(b"x" * (r.doc_id % 50)) for r in out)


def test_shards_of_awkward_tables(spark):
    out = sharding.stratified_shards(awkward(spark)).collect()
    assert len(out) == 12 and all(r.grown_shard is None and r.law == "rows" for r in out)
    assert sharding.stratified_shards(empty(spark)).count() == 0


# -- 5


def brute_rules(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    seen, dup = [], 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.append(line)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": dup, "n_repeat_words": len(covered)}


def test_rule_counts_equal_brute_force():
    draw = random.Random(1)
    for _ in range(3000):
        t = "".join(draw.choice(["a ", "b ", "c ", "é", "\n", "\n", " ", "a b\n", "\x0b", "\x1c", "#", "日"]) for _ in range(draw.randint(0, 40)))
        assert quality_rules.base_counts(t) == brute_rules(t)


def test_rules_verdicts(spark):
    draw = random.Random(2)
    noise = "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/" + " " * 2) for _ in range(9000))
    stamps = " ".join(f"{w} {w}" for w in ["lorem"] * 4000)
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(table(spark, [prose(draw, 900), noise, stamps, None, "few words"])).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False, 4: False}
    assert quality_rules.quality_rules(awkward(spark)).count() == 12 and quality_rules.quality_rules(empty(spark)).count() == 0


def rule_texts(draw):
    texts = [prose(draw, draw.randint(55, 400)) for _ in range(900)]
    texts += [" ".join(" ".join(w.split()[:1]) + " " + draw.choice(("one", "two")) for w in (prose(draw, 1) for _ in range(draw.randint(60, 200)))) for _ in range(60)]
    texts += ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789 ") for _ in range(draw.randint(500, 2000))) for _ in range(30)]
    return texts + [texts[0]] * 700 + [None, "", "short"]


def test_rules_verdicts_equal_brute_force(spark):
    """The curve from plain lists of the ratios of all different texts, the verdicts text by text."""
    texts = rule_texts(random.Random(17))
    bands, compressor = quality_rules.Bands(), zstandard.ZstdCompressor(level=3)
    ratio = {t: len(compressor.compress(t.encode())) / len(t.encode()) for t in texts if t}
    counts = {t: brute_rules(t or "") for t in texts}
    base = {t: c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"] for t, c in counts.items()}
    histogram = Counter((int(np.floor(np.log2(len(t.encode())) * 8)), int(np.floor(np.log(r) * 500))) for t, r in ratio.items() if not base[t])
    curve = quality_rules.fit_curve([(c, step, n) for (c, step), n in histogram.items()])

    def kept(t):
        if not t or base[t] or not quality_rules.compression(t, bands, compressor)[3]:
            return False
        centre, width = (float(v[0]) for v in curve.at(np.log2([len(t.encode())])))
        return abs(np.log(ratio[t]) - centre) <= (0.5 + bands.fence) * width

    found = quality_rules.quality_rules(table(spark, texts))
    got = {r.doc_id: r for r in found.collect()}
    verdicts = {t: bool(kept(t)) for t in set(texts)}
    assert [got[k].kept for k in range(len(texts))] == [verdicts[t] for t in texts]
    assert all(got[k].kept for k in range(900)) and sum(not got[k].kept and not got[k].base_failed for k in range(900, 990)) > 60
    fixed = quality_rules.learn_curve(quality_rules.quality_figures(table(spark, texts)))
    for part in (texts[::20], texts[905:908], texts[-4:]):  # the verdict of a text hangs on the curve, not on its table
        some = quality_rules.quality_rules(table(spark, part), curve=fixed)
        assert {r.doc_id: r.kept for r in some.collect()} == {k: verdicts[t] for k, t in enumerate(part)}


def test_curve_of_ratios_bends_little_with_the_number_of_texts():
    draw = random.Random(18)
    compressor = zstandard.ZstdCompressor(level=3)
    sized = [(len(t), len(compressor.compress(t.encode())) / len(t)) for t in (prose(draw, draw.randint(55, 900)) for _ in range(2000))]
    steps = [(int(np.floor(np.log2(n) * 8)), int(np.floor(np.log(r) * 500))) for n, r in sized]
    fits = [quality_rules.fit_curve([(c, s, k) for (c, s), k in Counter(steps[:n]).items()]) for n in (0, 3, 20, 100, 500, 2000)]
    at = np.linspace(9, 12, 13)
    centres, widths = zip(*(f.at(at) for f in fits), strict=True)
    assert np.abs(centres[-1] - centres[-2]).max() < 0.01 and np.abs(centres[-1] - centres[-3]).max() < 0.05
    assert all((a >= b - 1e-9).all() for a, b in zip(widths[1:-1], widths[2:], strict=True))  # more texts, narrower limits; never a jump to none
    odd = steps + [(c, s - 400) for c, s in steps[:100]]
    bent = quality_rules.fit_curve([(c, s, k) for (c, s), k in Counter(odd).items()])
    assert np.abs(bent.at(at)[0] - centres[-1]).max() < 0.02


def test_rules_see_repetition_in_every_part_of_a_text(spark):
    draw, whole = random.Random(4), []
    for size in (600, 1000, 2000, 3000, 4090, 5000, 8190, 12000, 20000):
        clean = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(size * 55 // 100))
        filler = ("and so the same words come again. " * size)[: size - len(clean)]
        plain = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(size))
        whole += [f"{clean}{filler}", f"{filler}{clean}", plain]
    got = {r.doc_id: r for r in quality_rules.quality_rules(table(spark, whole)).collect()}
    assert [got[k].kept for k in range(len(whole))] == [k % 3 == 2 for k in range(len(whole))]
    for size in (256, 300, 2047, 2048, 5000, 8190, 16385):
        begins, chunk, *_ = quality_rules.Bands().cut(size)
        assert {b for at in begins for b in range(at, at + chunk)} == set(range(size))


# -- 6


def test_language_codes_are_far_apart():
    for k in (2, 3, 4, 5, 9, 40):
        codes = langid.codewords(k)
        assert len({tuple(c) for c in codes.tolist()}) == k and all(abs(s) < k for s in codes.sum(axis=0))


def test_language_held_out_accuracy(spark):
    draw = random.Random(6)
    letters = {"aa": "abcde fg", "bb": "hijkl mn", "cc": "opqrs tu", "dd": "aehko st"}
    rows = [(k, "".join(draw.choice(letters[x]) for _ in range(200)), x) for k, x in enumerate(list(letters) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn_languages(df.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in langid.identify_language(df, model).collect()}
    assert sum(got[k].lang_pred == x for k, _, x in rows if k % 5 == 0) >= 47
    odd = langid.identify_language(awkward(spark), model).collect()
    assert len(odd) == 12 and {r.lang_pred for r in odd if r.doc_id in (0, 1, 2, 9)} == {"und"} and all(0 <= r.score <= 1 for r in odd)
    none = langid.learn_languages(empty(spark))
    assert {r.lang_pred for r in langid.identify_language(df, none).collect()} == {"und"}
    one = langid.learn_languages(df.where("lang = 'aa'"))
    assert {r.lang_pred for r in langid.identify_language(df, one).collect()} == {"aa"}
    assert langid.identify_language(empty(spark), model).count() == 0


# -- 7 and 8


def test_encoder_equals_tokenizer():
    whole, own = Tokenizer.from_file(default_path()), WordEncoder(default_path())
    odd = ["it's <|endoftext|> x<|endoftext|>y a\x1cb  z ﬁ éa 12ab3 don't. 'S I'LL ... ,, a,, ß,ẞ. ΣΑΣ. 日本語。テ", "", None, "É é́a. K Å Ω abc%%% d' e'' f's İstanbul", prose(random.Random(5), 500)]
    for text in odd:
        assert own.encode([text])[0] == np.array(whole.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_packing_rebuilds_every_document(spark):
    draw = random.Random(7)
    texts = [prose(draw, draw.choice([1, 5, 40, 300, 3000])) for _ in range(120)] + ["dup text"] * 300 + [None, ""]
    out = packing.pack_documents(table(spark, texts)).collect()
    ids = {k: np.array([*Tokenizer.from_file(default_path()).encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for k, t in enumerate(texts)}
    assert Counter(r.doc_id for r in out) == Counter({k: -(-len(v) // 4096) for k, v in ids.items()})
    for r in out:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and crc32(part.tobytes()) == r.ids_crc32 and r.start == 4096 * r.piece
    sequences: dict = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(map(len, ids.values())) // 4096) + 1
    assert packing.pack_documents(awkward(spark)).select("doc_id").distinct().count() == 11 and packing.pack_documents(empty(spark)).count() == 0


def optimum(items, capacity):
    best = len(items)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[j] >= items[k]:
                place(k + 1, [*rooms[:j], rooms[j] - items[k], *rooms[j + 1 :]])
        place(k + 1, [*rooms, capacity - items[k]])

    place(0, [])
    return best


def test_dominance_keeps_the_optimum():
    draw = random.Random(9)
    for _ in range(150):
        items = sorted((draw.randint(1, 20) for _ in range(draw.randint(1, 9))), reverse=True)
        plan = packing._Plan(np.bincount(items, minlength=21), 20)
        there = sorted(plan.used)
        for length in reversed(list(there)):
            while plan.left[length]:
                lengths = packing._dominant(plan, there, length)
                if lengths is None or not plan.fix(*lengths):
                    break
            there = [n for n in there if plan.left[n]]
        rest = [n for n in there for _ in range(plan.left[n])]
        assert plan.sequences + optimum(sorted(rest, reverse=True), 20) == optimum(items, 20)


def test_token_counts_equal_brute_force(spark):
    draw = random.Random(10)
    texts = [prose(draw, draw.randint(0, 700)) for _ in range(60)] + [None, ""]
    sizes = [len(Tokenizer.from_file(default_path()).encode(t or "", add_special_tokens=False).ids) for t in texts]
    for r in token_counts.token_counts(table(spark, texts)).collect():
        n = r.context_limit
        assert r.n_docs == sizes.count(n) and r.docs_longer == sum(s > n for s in sizes) and r.total_tokens == sum(sizes)
        assert r.truncated_tokens == sum(min(s, n) for s in sizes) and r.tokens_longer == sum(s for s in sizes if s > n)
        assert abs(r.quantile - sum(s <= n for s in sizes) / len(sizes)) < 1e-9
    histogram = token_counts.length_histogram(token_counts.token_lengths(table(spark, texts)))
    got = {r.context_limit: r.truncated_tokens for r in token_counts.truncated_totals(histogram, [0, 7, 100, 10**6]).collect()}
    assert got == {n: sum(min(s, n) for s in sizes) for n in (0, 7, 100, 10**6)}
    assert token_counts.token_counts(empty(spark)).count() == 0 and token_counts.token_counts(awkward(spark)).count() > 1


# -- 9


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_equals_brute_force(spark):
    draw = random.Random(11)
    base = [prose(draw, 80) for _ in range(12)]
    texts = base + [t.replace(" ", "  ").upper() for t in base[:4]] + [f"{t} {draw.choice(WORDS)}" for t in base] + ["a b", "A\tB", None, "", "É x y z"]
    rows = {r.doc_id: r for r in simhash.simhash_components(table(spark, texts)).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    assert [rows[k].fingerprint for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    parent = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    parent[i] = parent[j] = min(parent[i], parent[j])
    assert [rows[k].component_id for k in range(len(texts))] == parent


def test_links_over_random_fingerprints(spark):
    draw = random.Random(12)
    prints = set()
    for _ in range(25):
        p = draw.getrandbits(64)
        for _ in range(12):
            prints.add(p)
            for b in draw.sample(range(64), draw.choice([1, 2, 3, 3, 3, 4])):
                p ^= 1 << b
    signed = sorted(simhash._signed(p) for p in prints)
    got = {r.fp: r.component for r in simhash.link_fingerprints(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    group = {p: {p} for p in signed}
    for a in signed:
        for b in signed:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3 and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    for a in signed:
        assert {x for x in signed if got[x] == got[a]} == group[a]


def test_variants_of_few_fingerprints_are_not_broadcast(spark, tmp_path):
    """The rows of an explode are sized like those before it: a small table of fingerprints has 132 times as many variants."""
    spark.range(500).selectExpr("xxhash64(id) as fp", "xxhash64(id) as component").write.parquet(f"{tmp_path}/labelled")
    edges = simhash._three_bit_edges(spark.read.parquet(f"{tmp_path}/labelled"))
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_dedup_and_edges(spark):
    df = awkward(spark)
    assert simhash.simhash_components(df).count() == 12 and simhash.simhash_components(empty(spark)).count() == 0
    kept = simhash.near_dedup(df)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5, 6, 8, 9] and kept.columns == df.columns
    assert simhash.near_dedup(empty(spark)).count() == 0


def test_near_dedup_loses_no_text_and_keeps_no_copy(spark):
    draw = random.Random(15)
    a, b, c = (prose(draw, 60) for _ in range(3))
    rows = [(3, a), (5, a), (5, c), (None, b), (None, b), (None, c), (9, b), (9, b), (None, None), (None, "x y z"), (None, "x y z"), (7, c)]
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, fp string")
    assert Counter((r.doc_id, r.text) for r in simhash.near_dedup(df).collect()) == Counter([(3, a), (5, c), (9, b), (None, None), (None, "x y z")])
    many = df.unionByName(df).unionByName(df).repartition(7)
    assert Counter((r.doc_id, r.text) for r in simhash.near_dedup(many).collect()) == Counter([(3, a), (5, c), (9, b), (None, None), (None, "x y z")])


# -- 10


def test_quality_held_out(spark):
    draw = random.Random(13)
    rows = [(k, prose(draw, 150) + "." if k % 2 else " | ".join(draw.choice(WORDS).upper() + "!!" for _ in range(150))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.learn_quality(docs.where("doc_id % 4 <> 2"), labels)
    got = {r.doc_id: r for r in quality_model.score_quality(docs, model).collect()}
    assert all(got[k].predicted == k % 2 for k in range(0, 300) if k % 4 == 2 or k % 4 == 1)
    odd = quality_model.score_quality(awkward(spark), model).collect()
    assert len(odd) == 12 and all(0 <= r.score <= 1 for r in odd)
    untrained = quality_model.learn_quality(empty(spark), labels)
    assert quality_model.score_quality(docs, untrained).count() == 300 and quality_model.score_quality(empty(spark), model).count() == 0


def test_attention_gradients_are_the_slopes_of_the_loss():
    draw = np.random.default_rng(16)
    bags = [draw.normal(size=(n, quality_model.FEATURES)) for n in (3, 1, 4)]
    y, x, starts = np.array([1.0, 0, 1]), np.concatenate(bags), np.array([0, 3, 4])
    model = quality_model.fit_attention(bags, y, rounds=0)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}

    def loss():
        s = model.forward(x, starts)["score"]
        return -np.log(np.where(y == 1, s, 1 - s)).mean()

    for name, slope in model.gradients(x, starts, y).items():
        for at in [tuple(draw.integers(0, n) for n in slope.shape) for _ in range(8)]:
            kept = model.weights[name][at]
            model.weights[name][at] = kept + 1e-4
            high = loss()
            model.weights[name][at] = kept - 1e-4
            low = loss()
            model.weights[name][at] = kept
            assert abs((high - low) / 2e-4 - slope[at]) < 1e-5, name


def test_samples_are_the_least_hashes_of_each_group(spark):
    rows = spark.range(20_000).selectExpr("id", "if(id % 10 = 0, 'rare', 'often') as lang").unionByName(spark.range(50).selectExpr("id", "'often' as lang"))
    marks = {r.id: r.m for r in rows.select("id", F.pmod(F.xxhash64("id"), F.lit(sampling.RANGE)).alias("m")).collect()}
    both = Counter(r.lang for r in sampling.hash_sample(rows, 100, ("lang",)).collect())
    assert both == {"rare": 100, "often": 100}
    assert {r.id for r in sampling.hash_sample(rows.select("id"), 300).collect()} == set(sorted(marks, key=lambda i: (marks[i], i))[:300])
    assert sampling.hash_sample(rows.select("id").limit(7), 300).count() == 7 and sampling.hash_sample(rows.limit(0), 3, ("lang",)).count() == 0


def test_attention_learns():
    """A few steps lower the loss."""
    draw = np.random.default_rng(14)
    bags = [draw.normal(size=(n, quality_model.FEATURES)).astype(np.float32) for n in (3, 1, 4)]
    y = np.array([1, 0, 1], dtype=np.float32)
    before = quality_model.fit_attention(bags, y, rounds=0)
    after = quality_model.fit_attention(bags, y, rounds=40)
    starts = np.array([0, 3, 4])
    loss = lambda m: -np.log(np.where(y == 1, s := m.forward(np.concatenate(bags), starts)["score"], 1 - s)).mean()
    assert loss(after) < 0.2 * loss(before)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_sharding_is_the_same_in_sql(spark):
    db = duckdb.connect()
    db.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    twin = db.sql(queries.oracles()["op4_sharding"])
    ours = queries.op4_sharding(spark, "/root/testdata/sf0.001").select(*twin.columns).collect()
    assert sorted(map(tuple, ours)) == sorted(twin.fetchall())

"""Language, toxicity and page text: accuracy on rows that were not learned from, and the edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonewise.llm import html_text, language, queries, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    out = queries.op2_language_id(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in tested) >= 0.97 * len(tested)


def test_language_edge_cases(spark, docs):
    words = {"aa": "lorem dolor amet tempor", "bb": "schnee wurzel bäume kräfte"}
    rows = [(i, " ".join(random.Random(i).choices(words[k].split(), k=30)), k) for i, k in enumerate(["aa", "bb"] * 40)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    given = docs([(1, None), (2, ""), (3, "123 !!"), (4, words["aa"]), (4, words["aa"]), (5, words["bb"] * 9_000), (None, "É")])
    got = {(r.doc_id, r.lang_pred) for r in language.predict(given, model, ["doc_id"]).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "aa"), (5, "bb")} <= got
    assert language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"), F.lit(True)) is None
    assert {r.lang_pred for r in language.predict(given, None, ["doc_id", "score"]).collect()} == {"und"}
    assert language.predict(docs([]), model, ["doc_id"]).collect() == []


def test_language_scores_do_not_depend_on_the_batch(monkeypatch):
    draw = np.random.default_rng(0)
    scores = draw.integers(-1000, 1000, (language.BUCKETS, 3))
    model = language.Model(["a", "b", "c"], scores, np.zeros(3), 1.0, 0.0)
    texts = ["", "a", "ab cd", "été à la plage", "word " * 500, "x"]
    together = model.logits(texts)
    assert np.array_equal(together, np.vstack([model.logits([t]) for t in texts]))
    monkeypatch.setattr(language, "SLICE", 100)
    assert np.array_equal(together, model.logits(texts))


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = queries.op5_toxicity_fm(spark, folder).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    clean = [r for r in rows if r.toxic == 0]
    assert right >= 0.96 and sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_pairs_carry_what_single_terms_do_not():
    draw = random.Random(2)
    rows, label = [], []
    for _ in range(1_500):
        words = [w for w in ("fool", "group") if draw.random() < 0.5] + draw.choices([f"f{i}" for i in range(50)], k=4)
        rows.append(toxicity.terms(" ".join(words)))
        label.append(float("fool" in words and "group" in words))
    model = toxicity.train(rows, np.array(label))
    score = {t: model.score(toxicity.terms(t)) for t in ("fool group", "fool", "group", "f1 f2")}
    assert score["fool group"] > 0.9 and max(score["fool"], score["group"], score["f1 f2"]) < 0.3


def test_toxicity_edge_cases(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs([(1, "a")]), labels, F.lit(True))
    given = docs([(1, None), (2, ""), (None, "word"), (3, "many words " * 9_000)])
    assert {(r.score, r.predicted) for r in toxicity.score(given, model, ["doc_id"]).collect()} == {(0.5, 0)}
    assert toxicity.score(docs([]), model, ["doc_id", "score"]).collect() == []


def test_page_text_equals_the_sections(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    want = {}
    for r in pages.collect():
        found = [b.text for b in html_text.blocks(r.html) if html_text.is_main(b.path)]
        want[r.page_id] = (r.url, "\n\n".join(found), len("\n\n".join(found)))
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op6_html_lstm(spark, FOLDER).collect()}
    wrong = [i for i in want if got[i] != want[i]]
    assert len(got) == len(want) and len(wrong) <= 0.01 * len(want)


def test_blocks_of_broken_markup():
    html = (
        "<html><body><nav><a href=x>menu</a></nav><article><h1>T &amp;  t</h1><p><b>one<br>two<p>three</b> four &lt;5"
        "<script>var a='<p>no</p>'</script></p></p></article><!-- no --><footer>end"
    )
    found = [(b.text, html_text.is_main(b.path)) for b in html_text.blocks(html)]
    assert found == [("menu", False), ("T & t", True), ("one two", True), ("three four <5", True), ("end", False)]
    drawn = "<article><svg class='i'/>one<p>two <svg><path d='M0'/><g/>no</svg> three</p><div/>four</article><p>five"
    found = [(b.text, b.path) for b in html_text.blocks(drawn)]
    assert [t for t, _ in found] == ["one", "two three", "four", "five"] and found[0][1] == ("article",)
    assert html_text.blocks(None) == html_text.blocks("") == html_text.blocks("<p> </p>") == []


def test_whole_paths_tell_sections_apart():
    classes = " ".join(f"u{k}" for k in range(14))

    def page(wrappers):
        inner = f"<div class='{classes}'>" * wrappers + "<p>same words</p>" + "</div>" * wrappers
        return f"<body><article>{inner}</article><aside class=comments>{inner}</aside></body>"

    features = html_text.Features()
    for wrappers in (1, 2, 3, 40):
        main, side = html_text.blocks(page(wrappers))
        assert html_text.is_main(main.path) and not html_text.is_main(side.path)
        paths = features.of([main, side])[0]
        assert sorted(paths[0]) != sorted(paths[1])
        assert all(len(ids) == len(b.path) + 1 for ids, b in zip(paths, (main, side)))


def test_pages_edge_cases(spark):
    pages = spark.createDataFrame([(1, "u", None, 3), (2, None, "", 3), (2, None, "", 3)], "page_id long, url string, html string, text int")
    model = html_text.fit(pages)
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(pages, model).collect()) == [(1, "", 0), (2, "", 0), (2, "", 0)]
    assert html_text.extract(pages.limit(0), model).collect() == []


def test_gradients_agree_with_differences():
    page = [html_text.Block(("html", "p"), "some words."), html_text.Block(("html", "nav", "a"), "menu", 4)]
    p, f = html_text.new_parameters(), html_text.Features()
    x, mask = html_text._inputs(p, [f.of(page)])
    y = np.array([[1.0, 0.0]])

    def loss():
        s = html_text._forward(p, x, mask)[0]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).sum()

    score, _, kept_f, kept_b = html_text._forward(p, x, mask)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    d = (score - y)[:, :, None] * p["out"]
    html_text._lstm_back(p, "f", x, kept_f, d[:, :, : html_text.HIDDEN], grads)
    html_text._lstm_back(p, "b", x, kept_b, d[:, :, html_text.HIDDEN : 2 * html_text.HIDDEN], grads)
    for name in ("xf", "hf", "cf", "xb", "hb", "cb"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        before = p[name][at]
        p[name][at] = before + 1e-5
        up = loss()
        p[name][at] = before - 1e-5
        down = loss()
        p[name][at] = before
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-7)

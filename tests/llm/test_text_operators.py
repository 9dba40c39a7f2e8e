"""Decontamination, licenses, language, quality and pages, on small and odd tables."""

from __future__ import annotations

import random
import re


import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, html, langid, licenses, quality

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for item, t in items:
            w = words(t)
            for i in range(max(1, len(w) - 12) if w else 0):
                g = w[i : i + 13]
                for j in range(len(own) - len(g) + 1):
                    if own[j : j + len(g)] == g:
                        hit.update(range(j, j + len(g)))
                        found.add(str(item))
        out.append((doc, len(own), len(hit), len(found), decontaminate.items_digest(list(found)), bool(hit) and 20 * len(hit) >= len(own)))
    return out


def test_contamination_equals_brute_force(spark, documents):
    rng = random.Random(4)
    vocabulary = ["a", "b", "É", "é", "x1", "日本"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 13, 14, 30])))) for i in range(12)] + [(50, None), (51, "..."), (3, "repeated id"), (52, "a, B! é")]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "!?"), (103, items[4][1].upper()), (103, items[4][1]), (104, "q " * 5000 + items[5][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (decontaminate.BLOCK_BYTES, 40):  # in one block and in many
        found = decontaminate.contamination(spark, documents(docs, extra=True), bench, block_bytes=limit)
        got = [(r["doc_id"], r["contamination"]["n_words"], sum(b - a for a, b in zip(r["contamination"]["spans"][::2], r["contamination"]["spans"][1::2], strict=True)), len(r["contamination"]["items"])) for r in found.collect()]
        assert sorted(got) == sorted(b[:4] for b in brute(docs, items))
    report = [tuple(r) for r in decontaminate.decontamination_report(spark, documents(docs), bench).collect()]
    assert sorted(report) == sorted(brute(docs, items))
    clean = decontaminate.clean_documents(spark, documents(docs), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(b[0] for b in brute(docs, items) if not b[5])
    clash = documents(docs).withColumn("contamination", F.lit(7))
    kept = decontaminate.clean_documents(spark, clash, bench)
    assert kept.columns == clash.columns and {r["contamination"] for r in kept.collect()} == {7} and kept.count() == clean.count()
    assert decontaminate.decontamination_report(spark, documents([]), bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.decontamination_report(spark, documents(docs), bench.limit(0)).collect()} == {0}


def test_licenses(spark, documents):
    mit = dict(licenses.TEMPLATES)["MIT"]
    edited = mit.replace("obtaining", "getting")
    rows = [(1, "x y z. Licensed under CC BY-NC 4.0. more"), (2, None), (3, ""), (4, "word " * 500 + mit + " tail " * 50), (5, "intro " + edited), (6, "Released under the MIT License." * 3), (6, "Released under the"), (7, "MIT License under released the")]
    out = {(r["doc_id"], r["n_templates"]): r for r in licenses.license_report(spark, documents(rows, extra=True)).collect()}
    assert out[(1, 1)]["templates"] == "CC-BY-NC-4.0-short" and out[(1, 1)]["best"] == 1.0
    assert (2, 0) in out and (3, 0) in out and out[(4, 1)]["templates"] == "MIT" and 0.8 <= out[(5, 1)]["best"] < 1
    assert (6, 1) in out and (6, 0) in out and (7, 0) in out
    assert licenses.license_report(spark, documents([])).count() == 0
    assert {r["n_templates"] for r in licenses.license_report(spark, documents(rows), templates=[]).collect()} == {0}
    few = licenses.license_report(spark, documents([*rows, (8, "x Under; THE y"), (9, "the under")]), templates=[("t", "under the"), ("none", " . ")])
    assert sorted(r["doc_id"] for r in few.where("n_templates > 0").collect()) == [6, 6, 8]


def brute_licenses(text, templates):
    """Best containment of any window, window by window."""
    own, out = words(text), {}
    for name, t in templates:
        w = words(t)
        size = min(5, len(w))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        step = max(1, len(w) // 4)
        for at in range(0, max(1, len(own)), step):
            part = own[at : at + len(w) + step - 1]
            have = {tuple(part[i : i + size]) for i in range(len(part) - size + 1)}
            share = len(grams & have) / len(grams)
            if share >= 0.8:
                out[name] = max(out.get(name, 0), share)
    return out


@pytest.mark.parametrize("block", [licenses.BLOCK_WORDS, 60])
def test_licenses_equal_brute_force(spark, documents, block):
    """Whole and edited notices in long texts, in one pass and in many."""
    rng = random.Random(12)
    templates = [*licenses.TEMPLATES, ("short", "all rights reserved")]
    rows = []
    for i in range(60):
        text = " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 80)))
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(templates)[1].split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "edit"
            text += " " + " ".join(w) + " " + " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 40)))
        rows.append((i, text))
    _, found = licenses.found_licenses(spark, documents(rows, extra=True), templates, block)
    got: dict = {}
    ids, found = licenses.found_licenses(spark, documents(rows), templates, block)
    for r in found.join(ids, "row").collect():
        got.setdefault(r["doc_id"], {})[r["template"]] = round(r["containment"], 9)
    want = {i: {k: round(v, 9) for k, v in brute_licenses(t, templates).items()} for i, t in rows}
    assert got == {k: v for k, v in want.items() if v}


def test_languages(spark, documents):
    rng = random.Random(1)
    sounds = {"en": ["the", "ing", "th", "er"], "de": ["sch", "ung", "der", "ö"], "fr": ["eau", "é", "que", "oi"]}
    make = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, make(lang, 30), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "de"), (1003, make("de", 5000), None), (None, make("fr", 20), None)]
    out = {r["doc_id"]: r for r in langid.language_report(spark, documents(rows, extra=True)).collect()}
    held = [r for r in rows[:180] if out[r[0]]["held_out"]]
    assert len(held) > 20 and np.mean([out[r[0]]["lang_pred"] == r[2] for r in held]) > 0.95
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 and out[i]["rejected"] for i in (1000, 1001, 1002))
    assert out[1003]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in out.values())
    kept = langid.identified(spark, documents(rows, extra=True))
    assert kept.columns == documents(rows, extra=True).columns and kept.where("doc_id IN (1000, 1001, 1002)").count() == 0
    assert langid.language_report(spark, documents([])).count() == 0
    assert {r["lang_pred"] for r in langid.language_report(spark, documents([(1, "abc", None)])).collect()} == {"und"}


def test_quality(spark, documents):
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choice("aeioutnrs") for _ in range(rng.randint(2, 8))) for _ in range(60)) + "."
    junk = lambda: " ".join([rng.choice(["BUY", "NOW", "$$$"])] * 40)
    rows = [(i, good() if i % 3 else junk()) for i in range(240)] + [(900, None), (901, ""), (902, good() * 300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 200)] + [(5, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.quality_report(spark, documents(rows, extra=True), labels).collect()}
    judged = [out[i]["kept"] == (i % 3 > 0) for i in range(200, 240)]
    assert np.mean(judged) > 0.95 and out[902]["kept"] and len(out) == 243
    kept = quality.good_documents(spark, documents(rows, extra=True), labels)
    assert kept.columns == documents(rows, extra=True).columns
    alone = quality.quality_report(spark, documents(rows), labels.limit(0)).collect()
    assert all(r["kept"] and r["score"] == 0.5 for r in alone)
    assert quality.quality_report(spark, documents([]), labels).count() == 0


def test_many_languages_are_all_learned(spark, documents):
    """Far more languages than there are dimensions, one of them rare."""
    rng = random.Random(6)
    rows = []
    for k in range(300):
        alphabet = [chr(97 + (k * 7 + j * (1 + k % 5)) % 26) + chr(97 + (k * 3 + j) % 26) for j in range(6)]
        rows += [(len(rows) + i, " ".join("".join(rng.choice(alphabet) for _ in range(3)) for _ in range(30)), f"l{k:03d}") for i in range(12 if k else 4)]
    model = langid.fit(spark, documents(rows))
    assert len(model.languages) == 300 and model.embeddings.shape == (langid.BUCKETS, langid.DIMENSIONS)
    lang, score = model.predict([r[1] for r in rows[:200]])
    assert set(lang) <= set(model.languages) and ((0 <= score) & (score <= 1)).all()


def test_repeats_do_not_grow_the_sample(spark, documents):
    rows = [(1, f"good text number {i} of one id") for i in range(300)] + [(None, "no id")] * 300 + [(i, f"bad {i}") for i in range(2, 40)]
    labels = spark.createDataFrame([(1, 1, 0)] + [(i, 0, 0) for i in range(2, 40)], "doc_id bigint, quality int, toxic int")
    out = quality.quality_report(spark, documents(rows, extra=True), labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    view = lambda noise: np.stack([y + noise * rng.standard_normal(300), np.ones(300)], 1)
    a, b = view(0.2), view(0.4)
    model = quality.co_train(a[:24], b[:24], y[:24], a[24:200], b[24:200])
    assert ((model.scores(a[200:], b[200:])[2] > 0.5) == y[200:]).mean() > 0.95


PAGES = [
    (None, ""),
    ("", ""),
    ("plain text only", "plain text only"),
    ("<p>a&amp;b &#8212; c&nbsp;&nbsp;d<br>e</p>", "a&b — c d e"),
    ("<body><nav><a href=x>menu</a></nav><article><h1>T</h1><p>One <b>bold</b>.<p>Two<ul><li>a<li>b</ul></article><footer>f</footer>", "T\n\nOne bold.\n\nTwo\n\na\n\nb"),
    ("<body><div class='post'><h2>Head</h2><div><p>" + "Long enough text here. " * 20 + "</p><p>Short.</p></div></div><div class='comments'><p>" + "reader says " * 60 + "</p></div>", "Head\n\n" + ("Long enough text here. " * 20).strip() + "\n\nShort."),
    ("<article><p>x<script>var t='</p>';</script>y</p><style>p{}</style><form><input>no</form><aside>no</aside><!-- no --></article>", "xy"),
    ("<article><p title='a>b'>x < y & z</p><p hidden>no</p></article>", "x < y & z"),
    ("<div>" * 2000 + "deep" + "</div>" * 2000, "deep"),
    ("<body><ul><li><a href=1>one</a><li><a href=2>two</a></ul><div><p>" + "First half of it. " * 9 + "</p><p>More of it.</p></div><div><p>" + "Second half of it. " * 9 + "</p></div>", ("First half of it. " * 9).strip() + "\n\nMore of it.\n\n" + ("Second half of it. " * 9).strip()),
    ("<table><tr><td>A<td>B<tr><td>C</table>", "A\n\nB\n\nC"),
    ("<article><p>it's <a title=it's href=q>fine</a> here</p><div class='cookie-notice'>no</div></article>", "it's fine here"),
]


def test_pages(spark):
    rows = [(i, "u", h) for i, (h, _) in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = {r["page_id"]: r for r in html.page_texts(df).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert out[i]["text"] == want and out[i]["n_chars"] == len(want)
    assert html.page_texts(df.limit(0)).count() == 0


def test_pages_against_a_plain_reading_of_the_generated_articles(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    import html as entities

    for r in df.join(html.page_texts(df).select("page_id", "text"), "page_id").collect():
        body = r["html"].split("<article>", 1)[1].split("</article>", 1)[0]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body).replace("<br>", " "))
        want = [re.sub(r"\s+", " ", entities.unescape(p)).strip() for p in parts]
        assert r["text"] == "\n\n".join(p for p in want if p)


def test_elements_may_be_called_anything():
    """Density decides: pages give the same text without article and main elements."""
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column("html").to_pylist():
        assert html.main_text(page) == html.main_text(re.sub(r"(</?)(article|main)\b", r"\1div", page)) != ""


STORY = "<h1>Title</h1><p>" + "Some words of the story here. " * 10 + "</p><p>" + "More words follow. " * 8 + "</p>"
STORY_TEXT = "Title\n\n" + ("Some words of the story here. " * 10).strip() + "\n\n" + ("More words follow. " * 8).strip()


@pytest.mark.parametrize("names", ["layout has-sidebar", "content no-sidebar", "page search-results", "hidden-xs main-col", "entry-content share-enabled", "page-with-menu", "wrapper modal-open", "site search", "widget-area"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_names_only_weigh(names, inner):
    side = "<div class=sidebar>Side words</div>"
    comments = "<div class='comments'><p>" + "reader says " * 100 + "</p></div>"
    page = f"<body><nav><a href=1>x</a></nav><div class='{names}'>{side}<{inner}>{STORY}</{inner}>{comments}</div><footer>f</footer></body>"
    assert html.main_text(page) == STORY_TEXT


def test_forms_headers_and_teasers():
    assert html.main_text(f"<body><form><div>{STORY}</div><input><label>no</label></form></body>") == STORY_TEXT
    teaser = "<div class=list><article class=teaser><p>" + "teaser words " * 30 + "</p></article></div>"
    assert "teaser" not in html.main_text(f"<body><header><h1>Site</h1></header><div>{STORY * 3}</div><div class=related>{teaser}</div></body>")
    assert html.main_text("<body><header><h1>Site</h1></header><div><header><h1>T</h1></header><p>" + "long text. " * 30 + "</p></div></body>").startswith("T\n\nlong")
    assert html.main_text("<body><nav>a menu</nav><footer>f</footer></body>") == ""


def test_odd_pages(spark):
    long = "<article>" + STORY * 3000 + "</article>"
    rows = [(1, "u", long, 1), (1, "u", long, 1), (None, None, None, 2), (2, None, STORY, 3), (2, "v", "", 3)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int").withColumn("n_chars", F.lit("clash"))
    out = html.page_texts(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r["page_id"] or 0, r["url"] or "", r["n_chars"]) for r in out.collect()))
    want = 3000 * len(STORY_TEXT) + 2 * 2999
    assert got == [(0, "", 0), (1, "u", want), (1, "u", want), (2, "", len(STORY_TEXT)), (2, "v", 0)]


def test_random_pages_do_not_fail():
    rng = random.Random(8)
    bits = ["<p>", "</p>", "<div class=ad>", "</div>", "<a href='", "'>", "x", "&amp", "<!--", "-->", "<script>", "</script>", "<b", ">", "<li>", "</ul>", "<body>", "</html>", "\"", "<td>", "</article>", "<article>"]
    for _ in range(400):
        html.main_text("".join(rng.choice(bits) for _ in range(rng.randint(1, 40))))


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))

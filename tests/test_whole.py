"""Registered queries do the whole job: small tables with rows that a cut would lose."""

from __future__ import annotations

import hashlib
import math
import re

from oracle_support import SMALL

from plumbline.functions.text import osa_similarity
from plumbline.operators import documents
from plumbline.plans import registry


def linked(mentions, names):
    """(mention, element, score) by comparing every mention with every name that shares a word."""
    out = set()
    for mention, phrase in mentions:
        near = [(e, n) for e, n in sorted(set(names)) if set(phrase.lower().split()) & set(n.lower().split())]
        if not near or len(near) > documents.CANDIDATES:
            continue
        best: dict = {}
        for e, n in near:
            best[e] = max(best.get(e, 0.0), osa_similarity(phrase.lower(), n.lower()))
        (element, score), *rest = sorted(best.items(), key=lambda x: (-x[1], x[0]))
        if score >= documents.FUZZY and score - (rest[0][1] if rest else 0.0) >= documents.MARGIN:
            out.add((mention, element, round(score, 9)))
    return out


def test_fuzzy_candidates_equal_brute_force(spark):
    names = [(i, f"the {a} {b}") for i, (a, b) in enumerate((a, b) for a in ("green", "yellow", "wooden") for b in ("window", "door", "staircase"))]
    names += [(0, "the verdant window"), (90, "The Boiler"), (91, "the boiler"), *((100 + i, f"crowd {i}") for i in range(documents.CANDIDATES + 1))]
    mentions = [(1, "the green windwo"), (2, "the green windwo"), (3, "THE wooden staircasx"), (4, "the boilr"), (5, "crowd 7x"), (6, "nothing alike"), (7, "the verdant windov"), (8, "the yellow"), (9, "")]
    got = documents.fuzzy_candidates(spark.createDataFrame(mentions, "mention_id bigint, phrase string"), spark.createDataFrame(names, "element bigint, phrase string"))
    want = linked(mentions, names)
    assert {(r["mention_id"], r["element"], round(r["score"], 9)) for r in got.collect()} == want
    assert {m for m, _, _ in want} == {1, 2, 3, 7}


def test_every_part_is_a_mention(spark, tmp_path):
    rows = [(i, name) for i, name in enumerate(("marble column", "copper gutter", "hot ring"))]
    rows = [(i + at, name) for at in (0, 199, 5000) for i, name in rows]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = registry.queries()["D10_fuzzy_join"](spark, str(tmp_path)).collect()
    names = {(n, f"the {n}") for _, n in rows}
    want = linked([(i, f"the {n[:-1]}x") for i, n in rows], names)
    assert {(r["mention_id"], round(r["score"], 9)) for r in got} == {(m, s) for m, _, s in want}
    assert max(r["mention_id"] for r in got) >= 5000


def bm25(docs, queries):
    """query -> {doc: score} over text and section title, every term of a query asked."""
    cut = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    out: dict = {}
    for field, weight in ((1, 1.0), (2, 0.5)):
        words = {r[0]: cut(r[field]) for r in docs if cut(r[field])}
        mean = sum(map(len, words.values())) / len(words)
        for q, text in queries:
            for term in set(cut(text)):
                df = sum(term in w for w in words.values())
                for i, w in words.items():
                    if tf := w.count(term):
                        idf = math.log(1 + (len(words) - df + 0.5) / (df + 0.5))
                        out.setdefault(q, {}).setdefault(i, 0.0)
                        out[q][i] += weight * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return out


def test_bm25_asks_every_term(spark, tmp_path):
    queries = [(0, "one two three four five six marble gutter"), (20, "seven"), (1, "not asked")]
    docs = [(1, "only a marble gutter", "web"), (2, "one and six", "seven web"), (3, "nothing of it", "web"), (4, "marble, marble", "gutter")]
    spark.createDataFrame(queries, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["query_id"], r["id"]): r["score"] for r in registry.queries()["G3_bm25_chunks"](spark, str(tmp_path)).collect()}
    want = {(q, i): v for q, own in bm25(docs, queries[:2]).items() for i, v in own.items()}
    assert got.keys() == want.keys() and (0, 1) in got and (0, 4) in got
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_dense_queries_are_the_stated_set(spark):
    for name in ("G4_dense", "G5_engine_score", "N9_ranking_quality"):
        asked = {r["query_id"] for r in registry.queries()[name](spark, str(SMALL)).collect()}
        assert asked == set(range(0, 500, 20))
    kept = sum(r["kept"] for r in registry.queries()["N15_thresholds"](spark, str(SMALL)).collect() if r["threshold"] == 0.2)
    assert kept == registry.queries()["G4_dense"](spark, str(SMALL)).where("score >= 0.2").count()


def test_whole_pages_are_escaped(spark, tmp_path):
    page = "x" * 400 + r"[a]<b>\ "
    spark.createDataFrame([(1, page)], "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.queries()["A20_markdown"](spark, str(tmp_path)).first()["md"]
    assert got == hashlib.md5(("x" * 400 + r"\[a\]\<b\>\\ ").encode()).hexdigest()


def test_every_order_element_and_box_counts(spark, tmp_path):
    q, d = registry.queries(), str(tmp_path)
    spark.createDataFrame([(39, 1), (40, 1), (9000, 2)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey bigint").write.parquet(f"{d}/customer.parquet")
    assert {tuple(r) for r in q["E6_zero_filled"](spark, d).select("c_custkey", "n").collect()} == {(1, 2), (2, 1), (3, 0)}
    parts = [(7, "red bolt", "Brand#1", "LARGE", 50, 100.25), (900, "old ring", "Brand#2", "SMALL", 3, 10.0), (901, "hot gear", "Brand#2", "LARGE", 4, 10.0)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{d}/part.parquet")
    hits = {r["key"]: r["t"].splitlines()[-1] for r in q["A30_hit_text"](spark, d).collect()}
    assert hits == {7: "metrics: height=50, area=100.25", 900: "metrics: height=3, area=10, volume=0.3", 901: "metrics: height=4, area=10, volume=0.4"}
    assert {r["name"] for r in q["O1_union"](spark, d).collect()} == {"red bolt", "old ring"}
    spark.createDataFrame([(i,) for i in (1, 499, 500, 7000)], "s_suppkey bigint").write.parquet(f"{d}/supplier.parquet")
    assert {tuple(r) for r in q["D7_exhaustive_pairs"](spark, d).collect()} == {(1, 499), (1, 500), (1, 7000), (499, 500), (499, 7000), (500, 7000)}


def covered(text, names):
    """element -> mentions by trying the longest name at each word."""
    cut = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    by_words: dict = {}
    for e, phrase in names:
        if 1 <= len(cut(phrase)) <= documents.LONGEST_NAME:
            by_words.setdefault(tuple(cut(phrase)), set()).add(e)
    own, i, out = cut(text), 0, {}
    while i < len(own):
        for n in range(min(documents.LONGEST_NAME, len(own) - i), 0, -1):
            if hit := by_words.get(tuple(own[i : i + n])):
                for e in hit:
                    out[e] = out.get(e, 0) + 1
                i += n
                break
        else:
            i += 1
    return out


def test_mentions_are_longest_first_and_apart(spark):
    names = [(1, "a b c d e"), (2, "a b"), (3, "c d e f g h i j"), (4, "x x"), (5, "A-B"), (6, "k l m n o p q r s"), (7, "b"), (8, "f g h i j y")]
    docs = [(1, "A b, c d e! a b"), (2, "x x x x x"), (3, "c d e f g h i j"), (4, "a b c d e f g h i j y"), (5, "k l m n o p q r s b"), (1, "a b"), (6, None), (7, "")]
    got = documents.exact_mentions(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(names, "element bigint, phrase string"))
    want: dict = {}
    for i, t in docs:
        for e, n in covered(t or "", names).items():
            want[i, e] = want.get((i, e), 0) + n
    assert {(r["doc_id"], r["element"]): r["n"] for r in got.collect()} == want
    assert want[1, 1] == 1 and want[3, 3] == 1 and want[2, 4] == 2 and want[4, 8] == 1 and (5, 6) not in want


def test_registered_names_of_mixed_length(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    names = []
    for r in items:
        w = [w for w in re.split(r"[\W_]+", r["text"].lower()) if w]
        if len(w) >= r["item_id"] % 8 + 1:
            names.append((r["item_id"], " ".join(w[: r["item_id"] % 8 + 1])))
    got = {(r["doc_id"], r["element"]): r["n"] for r in registry.queries()["D9_phrase_join"](spark, str(SMALL)).collect()}
    assert got == {(r["doc_id"], e): n for r in docs for e, n in covered(r["text"] or "", names).items()}
    assert {e % 8 for _, e in got} & {4, 5, 6, 7}


def test_packs_take_every_document(spark, tmp_path):
    docs = [(i, "one\ntwo\nthree") for i in (59, *range(60, 160))]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.queries()["N1_pack"](spark, str(tmp_path)).collect()
    assert sum(r["n"] for r in rows) == 200 and all(r["truncated"] for r in rows)
    assert registry.queries()["N6_references"](spark, str(tmp_path)).count() == 50

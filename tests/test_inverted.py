"""The stored index and its pruned search, and dense search in blocks, against plain loops."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import inverted, retrieval

WORDS = [f"w{k}" for k in range(40)]


def corpus(n=400, seed=5):
    rng = random.Random(seed)
    draw = lambda m: " ".join(rng.choices(WORDS, weights=[1 / (k + 1) for k in range(40)], k=m))
    rows = [(k, draw(rng.randint(1, 30)), draw(rng.randint(0, 3)), [draw(rng.randint(1, 4)) for _ in range(rng.randint(0, 3))]) for k in range(n)]
    return [*rows, (n, None, None, None), (n + 1, "", " ", []), (n + 2, None, "w1", [None, "w2 w2"])]


def scores(rows, terms, weights, tie, boost):
    """BM25 of every field and part by its definition."""
    parts = [(i, f, p, (t or "").split()) for i, text, title, mats in rows for f, p, t in [("text", 0, text), ("title", 0, title), *(("mats", k, m) for k, m in enumerate(mats or []))]]
    parts = [x for x in parts if x[3]]
    out: dict = {}
    for field in ("text", "title", "mats"):
        own = [x for x in parts if x[1] == field]
        mean = sum(len(x[3]) for x in own) / len(own)
        df = Counter(t for x in own for t in set(x[3]))
        for i, _, p, words in own:
            tf = Counter(words)
            s = sum(math.log(1 + (len(own) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(words) / mean)) for t in terms if tf[t])
            if s:
                out.setdefault(i, {}).setdefault(field, []).append(s)
    final = {}
    for i, fields in out.items():
        plain = [weights[f] * s[0] for f, s in fields.items() if f != "mats"]
        final[i] = round((max(plain) + tie * (sum(plain) - max(plain)) if plain else 0) + boost * max(fields.get("mats", [0])), 6)
    return final


@pytest.fixture(scope="module")
def built(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id bigint, text string, title string, mats array<string>")
    t = retrieval.analysed
    block = inverted.BLOCK
    inverted.BLOCK = 8
    try:
        index = inverted.build(df, "id", {"text": t(F.col("text")), "title": t(F.col("title"))}, {"mats": F.transform("mats", t)})
    finally:
        inverted.BLOCK = block
    return rows, index


@pytest.mark.parametrize("tie", [1.0, 0.3])
def test_first_k_are_exact_and_little_is_read(spark, built, tie):
    rows, index = built
    queries = {1: ["w0", "w30"], 2: ["w0", "w1", "w2"], 3: ["w39"], 4: ["nowhere"], 5: ["w3", "w3", "w20", "w21"], 6: ["w5"]}
    asked = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query_id int, term string")
    weights = {"text": 1.0, "title": 0.5}
    got: dict = {}
    for r in inverted.search(index, asked, weights, tie, {"mats": 1.5}, depth=10).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    for q, terms in queries.items():
        all_ = scores(rows, set(terms), weights, tie, 1.5)
        want = sorted(all_.items(), key=lambda x: (-x[1], x[0]))[:10]
        assert [i for i, _ in got.get(q, [])] == [i for i, _ in want] and [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in want], abs=2e-6)
    one = asked.where("query_id = 6")
    read, all_ = (inverted.essential(index, one, {"text": 1.0}, n, {"text"}).count() for n in (5, 10**6))
    assert read < all_ / 2  # the levels of highest impact alone
    some = spark.range(0, 400, 7)
    among = inverted.search(index, asked, weights, tie, {"mats": 1.5}, depth=10, among=some).where("query_id = 2").orderBy("rank").collect()
    want = sorted(((i, s) for i, s in scores(rows, {"w0", "w1", "w2"}, weights, tie, 1.5).items() if i % 7 == 0 and i < 400), key=lambda x: (-x[1], x[0]))[:10]
    assert [r["id"] for r in among] == [i for i, _ in want]


def test_blocks_are_bounded(built):
    _, index = built
    assert index.blocks.agg(F.max(F.size("postings"))).first()[0] <= 40
    assert index.blocks.agg(F.sum(F.size("postings"))).first()[0] == index.bounds.agg(F.sum("n")).first()[0]


def test_empty_index_and_questions(spark):
    empty = spark.createDataFrame([], "id bigint, text string")
    index = inverted.build(empty, "id", {"text": retrieval.analysed(F.col("text"))})
    asked = spark.createDataFrame([(1, "a")], "query_id int, term string")
    assert inverted.search(index, asked, {"text": 1.0}).collect() == [] and inverted.search(index, asked.limit(0), {"text": 1.0}).collect() == []
    words = spark.createDataFrame([("Onde está the Wall, não?",), ("the of",), (None,)], "t string").select(inverted.asked_terms(F.col("t")).alias("t"))
    assert [r["t"] for r in words.collect()] == [["wall"], [], []]


def test_dense_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(5)]) for k in range(120)]
    rows += [(200, rows[7][1]), (201, rows[7][1]), (202, [0.0] * 5), (203, None), (204, [1.0, 2.0]), (205, [float("nan")] + [1.0] * 4), (206, [None] + [1.0] * 4), (207, [1e300] * 5), (208, [1e-300] * 5)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>").repartition(5)
    asked = df.where("id % 10 = 0 OR id > 200").select(F.col("id").alias("query_id"), "vector")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    scale = {207: [1.0] * 5, 208: [1.0] * 5}
    good = {k: scale.get(k, v) for k, v in rows if v and k not in (202, 205, 206)}
    want = {}
    for q in (k for k in good if k % 10 == 0 or k > 200):
        ranks = sorted(((-round(cos(good[q], v), 12), k) for k, v in good.items() if len(v) == len(good[q])))[:7]
        want |= {(q, k): n for n, (_, k) in enumerate(ranks, 1)}
    got = retrieval.dense(df, asked, depth=7)
    assert {(r["query_id"], r["id"]): r["rank"] for r in got.collect()} == want
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 300)
    assert {(r["query_id"], r["id"]): r["rank"] for r in retrieval.dense(df, asked, depth=7).collect()} == want
    assert retrieval.dense(df.limit(0), asked).collect() == [] and retrieval.dense(df, asked.limit(0)).collect() == []

"""Mixing: targets, quotas and what is taken, against plain loops."""

from __future__ import annotations

import heapq
import random
import re
from collections import Counter
from fractions import Fraction
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing
from plumbline.llm.common import written

SMALL = Path("/root/testdata/sf0.001")
DOCS = "doc_id bigint, text string, source string"


def targets(sizes: dict, weights=(5.0, 2.0, 1.0), repeats=3) -> dict:
    """Shares by weight, the excess of those over their most shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while free := [s for s in names if s not in fixed]:
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > repeats * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * level for s in free}
        fixed |= {s: repeats * sizes[s] for s in over}
    return fixed


def check(rows, texts) -> None:
    """Every document once with its size; sources near their targets; nothing over three times."""
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d, count(t)) for d, t, _ in texts)
    sizes: Counter = Counter()
    for _, t, s in texts:
        sizes[s] += count(t)
    wanted = targets(dict(sizes))
    taken: Counter = Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(wanted[r["source"]], rel=1e-12)
        assert r["taken"] == sum(s["length"] * s["times"] for s in r["spans"])
        assert all(0 <= s["start"] and s["start"] + s["length"] <= r["size"] and 1 <= s["times"] <= 3 for s in r["spans"])
        taken[r["source"]] += r["taken"]
    for s, want in wanted.items():
        assert abs(taken[s] - want) <= mixing.BLOCK_WORDS, (s, taken[s], want)


def test_table_and_reruns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = mixing.mixture(spark, docs).collect()
    check(rows, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    again = mixing.mixture(spark, docs.repartition(5, F.rand(3))).collect()
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in again}
    other = mixing.mixture(spark, docs, seed=12).collect()
    assert {(r["doc_id"], r["taken"]) for r in rows} != {(r["doc_id"], r["taken"]) for r in other}


def test_many_shards(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = mixing.mixture(spark, docs, shard_words=500, shard_rows=3).collect()
    taken = Counter()
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"], r["target"]] += r["taken"]
    for (_, target), n in taken.items():
        assert abs(n - target) <= 0.03 * target  # half a block for each of some ten shards


def test_edges(spark):
    texts = [(1, "a b c " * 40, "x"), (1, "a b c " * 40, "x"), (None, "q r", "x"), (2, None, "y"), (3, "", "y"), (4, "one two three four", None), (5, " \t\n", None), (6, "w " * 3000, "")]
    texts += [(7, "same words here", "z")] * 50 + [(8, None, "nothing")]
    docs = spark.createDataFrame(texts, DOCS)
    for name in ("size", "key", "rows", "target", "spans", "copy", "shard"):
        docs = docs.withColumn(name, F.lit("clash"))
    check(mixing.mixture(spark, docs).collect(), texts)
    empty = docs.limit(0)
    assert mixing.mixed_documents(spark, empty).collect() == []
    assert [tuple(r) for r in mixing.mixed_documents(spark, spark.createDataFrame([(1, None, None), (2, "", "s")], DOCS)).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_copies_beyond_one_step(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    texts = [(7, "same words here", "z")] * 50 + [(8, "other words", "z")] * 14
    check(mixing.mixture(spark, spark.createDataFrame(texts, DOCS)).collect(), texts)


def highest_quotients(cells: list[tuple], seats: int) -> dict:
    """One seat after another to the highest votes / (2 k + 1)."""
    heap = [(-Fraction(v), name, 0) for name, v, most in cells if most]
    heapq.heapify(heap)
    quota = {name: 0 for name, _, _ in cells}
    limits, votes = {n: m for n, _, m in cells}, {n: Fraction(v) for n, v, _ in cells}
    for _ in range(seats):
        _, name, k = heapq.heappop(heap)
        quota[name] += 1
        if k + 1 < limits[name]:
            heapq.heappush(heap, (-votes[name] / (2 * k + 3), name, k + 1))
    return quota


@pytest.mark.parametrize("kind", ["random", "ties", "tiny", "one"])
def test_apportionment_equals_highest_quotients(spark, kind):
    rng = random.Random(kind)
    votes = {"random": [rng.randint(0, 4000) / 8 for _ in range(60)], "ties": [2.5] * 40 + [7.5] * 9, "tiny": [0.25] * 50 + [3.0], "one": [123456.0]}[kind]
    cells = [(f"c{k:02}", v, max(3, int(3 * v))) for k, v in enumerate(votes)]
    df = written(spark, spark.createDataFrame(cells, "name string, votes double, most bigint"), "cells")
    got = {r["name"]: r["quota"] for r in mixing.apportioned(spark, df, ["name"]).collect()}
    assert got == highest_quotients(cells, round(sum(votes)))


def test_span_texts(spark):
    row = spark.sql("SELECT ' a b\tc  d ' AS text, array(named_struct('start', 1L, 'length', 2L, 'times', 2), named_struct('start', 3L, 'length', 1L, 'times', 1)) AS spans")
    assert row.select(mixing.span_texts(F.col("text"), F.col("spans")).alias("t")).first()["t"] == ["b c", "b c", "d"]

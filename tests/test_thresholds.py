"""The out-of-fold protocol against a plain sweep over every threshold."""

from __future__ import annotations

import math
import random

import pytest

from plumbline.operators import thresholds

CANDIDATES, QUERIES = "query_id string, rank int, score double, grade int", "query_id string, fold int, relevant_total bigint, ideal_grades array<int>"


def made(seed, n=40):
    rng = random.Random(seed)
    lists = {f"q{k}": sorted(((round(0.2 * g + rng.random() * 0.5, 2), g) for g in rng.choices(range(4), k=rng.randint(1, 14))), reverse=True) for k in range(n)}
    queries = {q: (k % 5, sum(g >= 2 for _, g in c) + rng.randint(0, 1), sorted((g for _, g in c), reverse=True)) for k, (q, c) in enumerate(lists.items())}
    return lists, queries


def judged(c, relevant, ideal, cut):
    kept = [(s, g) for s, g in c if cut is None or s >= cut]
    gain = lambda gs: sum((2**g - 1) / math.log2(k + 2) for k, g in enumerate(gs[:10]))
    true = sum(g >= 2 for _, g in kept)
    f1 = 2 * (true / len(kept)) * (true / relevant) / (true / len(kept) + true / relevant) if true else 0.0
    return f1, sum(g >= 2 for _, g in kept[:10]) / relevant, gain([g for _, g in kept]) / gain(ideal) if gain(ideal) else 0.0, 1 - len(kept) / len(c)


def by_hand(lists, queries):
    queries = {q: v for q, v in queries.items() if v[1]}
    mean = lambda f, cut: [round(sum(x) / len(x), 6) for x in zip(*(judged(lists[q], r, i, cut) for q, (fold, r, i) in queries.items() if fold == f), strict=True)]
    cuts = [None, *sorted({s for q in queries for s, _ in lists[q]})]
    means = {(f, c): mean(f, c) for f in range(5) for c in cuts}
    chosen = {}
    for h in range(-1, 5):
        best = None
        folds = [f for f in range(5) if f != h]
        for c in cuts:
            if c is not None and not any(s == c for q, v in queries.items() if v[0] in folds for s, _ in lists[q]):
                continue
            rec, nd = ([round(means[f, c][k] - means[f, None][k], 6) for f in folds] for k in (1, 2))
            if min(rec) < 0 or min(nd) < 0:
                continue
            avg = lambda x: round(sum(x) / len(x), 6)
            key = (-min(rec), -min(nd), -avg(rec), -avg(nd), avg([means[f, c][3] for f in folds]), c is not None, c or 0.0, -avg([means[f, c][0] for f in folds]))
            best = min(best or (key, c), (key, c), key=lambda x: x[0])
        chosen[h] = best[1]
    return chosen


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_sweep(spark, seed):
    lists, queries = made(seed)
    c = spark.createDataFrame([(q, k + 1, s, g) for q, own in lists.items() for k, (s, g) in enumerate(own)], CANDIDATES)
    q = spark.createDataFrame([(q, *v) for q, v in queries.items()], QUERIES)
    chosen, outcome = thresholds.protocol(c, q)
    want = by_hand(lists, queries)
    assert {r["held_out"]: r["threshold"] for r in chosen.collect()} == want
    got = outcome.first()
    held = [judged(lists[q], r, i, want[f]) for q, (f, r, i) in queries.items() if r]
    assert got["recall"] == pytest.approx(sum(x[1] for x in held) / len(held), abs=1e-6) and got["f1"] == pytest.approx(sum(x[0] for x in held) / len(held), abs=1e-6)
    assert got["passed"] == (got["recall"] >= got["recall_all"] and got["ndcg"] >= got["ndcg_all"]) and got["threshold"] == (want[-1] if got["passed"] else None)


def test_nothing_to_judge(spark):
    none = spark.createDataFrame([], CANDIDATES), spark.createDataFrame([("q", 0, 1, [2]), ("r", 1, 0, [])], QUERIES)
    chosen, outcome = thresholds.protocol(*none)
    assert chosen.collect() == []
    with pytest.raises(Exception, match="no list can be judged"):
        outcome.collect()

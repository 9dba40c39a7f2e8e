"""Filter interactions, against a plain reading of the rules row by row."""

from __future__ import annotations

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from plumbline.llm.interactions import filter_interactions

DOCS = "doc_id bigint, text string, lang string"
LABELS = "doc_id bigint, quality int, toxic int"


def by_hand(docs, labels) -> dict:
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    smallest: dict = {}
    for d, text, _ in docs:
        if d is not None:
            smallest[text or ""] = min(d, smallest.get(text or "", d))
    rows = []
    for d, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ["A"] if len(words) < 100 else []
        fails += ["B"] if 100 * len(set(words)) < 80 * len(words) else []
        fails += ["C"] if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else []
        fails += ["D"] if re.search(r"[#$%&*|]", text) else []
        fails += ["E"] if d is not None and d > smallest[text] else []
        rows.append((lang or "", set(fails), d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, kept = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(kept), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f
                ]
                left = kept
        for key, row in out.items():
            if key[0] == part:
                row[6] = shapley[row[6]] if isinstance(row[6], str) else row[6]
    return out


def got(spark, docs, labels) -> dict:
    d, x = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    for name in ("part", "n", "digest", "words", "good", "_id", "pattern", "rows"):
        d, x = d.withColumn(name, F.lit("clash")), x.withColumn(name, F.lit("clash"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = filter_interactions(d, x).collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_documents(spark, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(["alpha ", "Beta ", "GAMMA ", "é|", "x\t", "y\n", "#", " ", " "]) for _ in range(rng.choice([3, 40, 150]))) for _ in range(20)]
    pool += [" ".join(f"w{k}" for k in range(n)) for n in (99, 100, 101, 250)] + [" ".join(["w"] * 20 + [f"w{k}" for k in range(79 + k)]) for k in (0, 1, 2)]
    pool += ["A" * 10 + "b" * 90, "A" * 11 + "b" * 89, "", " \n", None]
    docs = [(rng.choice([None, *range(60)]), rng.choice(pool), rng.choice(["en", "de", "", None])) for _ in range(300)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)]
    assert got(spark, docs, labels) == by_hand(docs, labels)


def test_many_copies_and_a_very_long_text(spark):
    docs = [(k, "the same few words", "en") for k in range(2000)] + [(5000, "long " * 300_000, "en"), (5001, "long " * 300_000, "fr")]
    assert got(spark, docs, [(0, 1, 0), (1, 1, 1)]) == by_hand(docs, [(0, 1, 0), (1, 1, 1)])


def test_empty_tables(spark):
    assert got(spark, [], []) == {}
    assert got(spark, [(1, "a", None)], [])["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]

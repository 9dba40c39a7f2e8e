"""Near-duplicate texts and vectors against brute force."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest

from plumbline.llm import embeddings, neardup
from plumbline.llm.components import components
from plumbline.llm.words import scan, shingles


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))


def mutated(rng, words, share):
    return [word(rng) if rng.random() < share else w for w in words]


def brute(rows):
    """doc_id -> class by comparing all pairs of texts."""
    docs = sorted(rows, key=lambda r: r[0])
    texts = [t.encode() if t is not None else None for _, t in docs]
    words = scan(texts)
    h, d = shingles(words, neardup.SHINGLE)
    cells = neardup.CELLS
    pairs = sorted(set(zip(d.tolist(), h.tolist(), strict=True)))
    counts = np.bincount(neardup._cell(np.array([x for _, x in pairs], dtype=np.uint64), cells), minlength=cells)
    w = neardup.Weights(counts, len(docs))
    h, weight, begin = w.vectors(words)
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if texts[i] is None or texts[j] is None:
                continue
            same = neardup.text_key(words, i, texts[i]) == neardup.text_key(words, j, texts[j])
            a, b = slice(begin[i], begin[i + 1]), slice(begin[j], begin[j + 1])
            if same or (a.stop > a.start and b.stop > b.start and neardup.weighted_jaccard(h[a], weight[a], h[b], weight[b]) >= 0.8):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {docs[i][0]: docs[find(i)][0] for i in range(len(docs))}


@pytest.mark.parametrize("stretch", [256, 8])
def test_groups_equal_brute_force(spark, documents, monkeypatch, stretch):
    monkeypatch.setattr(neardup, "STRETCH", stretch)
    rng = random.Random(stretch)
    base = [word(rng) for _ in range(120)]
    rows = [(i, " ".join(mutated(rng, base, rng.random() * 0.06))) for i in range(60)]  # a group with links and strays
    rows += [(100 + i, " ".join(word(rng) for _ in range(rng.randint(1, 90)))) for i in range(30)]
    rows += [(200 + i, "the same few words again and again here") for i in range(5)]
    rows += [(300, None), (301, None), (302, ""), (303, ""), (304, "!!!"), (305, "one two"), (306, "One, TWO."), (307, "x " * 3000)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicate_report(spark, documents(rows, extra=True)).collect()}
    assert got == brute(rows)


def plain_vectors(texts):
    """Counts of five-word shingles, and how many texts each shingle is in, by nothing but Python."""
    counts = []
    for t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        size = min(5, len(w))
        counts.append(collections.Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if w else collections.Counter())
    return counts, collections.Counter(s for c in counts for s in c)


def test_no_pair_of_a_real_table_is_lost(spark):
    """Every pair at 0.8 under exact document frequencies, found through an inverted index, is in one class;
    and classes hold nothing that such pairs, with a little slack, don't connect."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    counts, df = plain_vectors([r["text"] for r in rows])
    rare = lambda s: max(0.0, min(1.0, math.log(1 / (df[s] / len(rows) + 1e-4)) / math.log(1e4)))
    weight = [{s: n * (3 + rare(s)) / 4 for s, n in c.items()} for c in counts]
    index = collections.defaultdict(list)
    for i, c in enumerate(counts):
        for s in c:
            if df[s] > 1:
                index[s].append(i)
    together = collections.Counter()
    for held in index.values():
        together.update((a, b) for a, b in itertools.combinations(held, 2))
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicate_report(spark, docs).collect()}
    parent, pairs, near = list(range(len(rows))), 0, 0

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in together.items():
        if n * 4 < min(len(counts[a]), len(counts[b])):
            continue
        both = sum(min(w, weight[b].get(s, 0)) for s, w in weight[a].items())
        value = both / (sum(weight[a].values()) + sum(weight[b].values()) - both)
        if value >= 0.8:
            pairs, near = pairs + 1, near + (value < 1 - 1e-9)
            assert found[rows[a]["doc_id"]] == found[rows[b]["doc_id"]]
        if value >= 0.79:
            parent[find(a)] = find(b)
    assert pairs > 50 and near > 5
    root = {}
    for i, r in enumerate(rows):
        if r["text"]:
            assert root.setdefault(found[r["doc_id"]], find(i)) == find(i)


def test_rows_without_an_id_are_linked(spark, documents):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(None, a), (7, a + " more"), (8, "something else"), (None, "x y z " * 30 + "end"), (None, "x y z " * 30 + "end")]
    out = neardup.near_duplicates(spark, documents(rows, extra=True)).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in out) == [(0, 0), (0, 0), (0, 7), (7, 7), (8, 8)]
    only = [(None, a), (None, a + " b"), (None, "c")]
    groups = [r["component"] for r in neardup.near_duplicates(spark, documents(only)).collect()]
    assert len(set(groups)) == 2


def test_one_of_each_group_stays(spark, documents):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text), (3, None), (3, None), (4, "something else entirely, not the same at all")]
    out = neardup.deduplicated(spark, documents(rows, extra=True))
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 3, 4] and out.columns == documents(rows, extra=True).columns
    assert neardup.deduplicated(spark, documents([])).count() == 0
    assert neardup.near_duplicate_report(spark, documents([])).count() == 0


def test_samples_agree_as_often_as_texts_do():
    rng = random.Random(9)
    base = [word(rng) for _ in range(400)]
    words = scan([" ".join(base).encode(), " ".join(mutated(rng, base, 0.04)).encode()])
    w = neardup.Weights(np.zeros(neardup.CELLS, dtype=np.int64), 10)
    h, weight, begin = w.vectors(words)
    s = w.samples(h, weight, begin)
    true = neardup.weighted_jaccard(h[: begin[1]], weight[: begin[1]], h[begin[1] :], weight[begin[1] :])
    assert abs((s[0] == s[1]).mean() - true) < 0.2


def test_hot_keys_join_alike(spark, monkeypatch):
    from plumbline.llm import common

    left = spark.createDataFrame([(i % 7 if i % 3 else None, i) for i in range(60)], "k int, v int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(5)], "k int, w string")
    want = {how: sorted(map(str, left.join(right, ["k"], how).collect())) for how in ("inner", "left")}
    for rows, keys in ((1000, 10), (2, 10), (0, 2)):
        monkeypatch.setattr(common, "HOT_ROWS", rows)
        monkeypatch.setattr(common, "HOT_KEYS", keys)
        for how, rows_wanted in want.items():
            assert sorted(map(str, common.joined_by_hot(spark, left, right, ["k"], how).collect())) == rows_wanted


def test_groups_with_hot_buckets(spark, documents, monkeypatch):
    from plumbline.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    test_groups_equal_brute_force(spark, documents, monkeypatch, 8)
    test_components(spark)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a int, b int")
    found = {r["node"]: r["component"] for r in components(spark, links).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[101] == 100
    assert components(spark, links.limit(0)).count() == 0


@pytest.mark.parametrize("window", [1024, 16])
def test_vectors_equal_brute_force(spark, window):
    rng = np.random.default_rng(window)
    centre = rng.standard_normal((6, 16))
    x = np.concatenate([rng.standard_normal((80, 16)), *(c + 0.12 * rng.standard_normal((25, 16)) for c in centre), np.repeat(centre[:1], 9, axis=0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [1.0]), (1004, [None] + [1.0] * 15), (1005, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.linked_vectors(spark, df, miss=1e-6, window=window).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    assert all(got[i] == (near[i].sum(), label[i], label[i] == i) for i in range(len(x)))
    assert all(got[i] == (0, i, True) for i, _ in bad)
    assert embeddings.linked_vectors(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("more", [[], [(5, 30)], [(101, 3), (41, 42), (42, 100), (60, 61)]])
def test_links_added_later_give_the_same_components(spark, more):
    from plumbline.llm.common import written
    from plumbline.llm.components import merged

    links = [(1, 2), (2, 3), (4, 5), (30, 31), (100, 101), (40, 41)]
    first, added = (spark.createDataFrame(x, "a int, b int") for x in (links, more))
    found = merged(spark, components(spark, first), written(spark, added, "added"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, components(spark, first.union(added)).collect()))


def test_small_work_tables_take_few_tasks_whatever_a_shuffle_deals(spark, documents):
    rng = random.Random(3)
    docs = documents([(i, " ".join(word(rng) for _ in range(30))) for i in range(300)])
    held = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = neardup.near_duplicates(spark, docs)
        groups = [f for f in found.inputFiles() if "-groups/" in f]
        assert 0 < len(groups) <= spark.sparkContext.defaultParallelism
        assert found.count() == 300
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

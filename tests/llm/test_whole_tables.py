"""Repeated ids and mixed vector lengths, which the given tables don't have."""

from __future__ import annotations

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import embeddings, neardup
from plumbline.llm.queries import OP2_SQL


def prose(seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))


def test_one_of_each_group_stays_where_ids_repeat(spark, documents):
    a, b, c, d = map(prose, range(4))
    rows = [(1, a), (2, a), (2, b), (2, c), (3, c), (4, d), (4, d), (5, None), (5, a), (6, d), (None, a), (None, None)]
    for extra in (True, False):
        df = documents(rows, extra=extra)
        out = neardup.deduplicated(spark, df)
        got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
        assert got == sorted([(1, a), (2, b), (2, c), (4, d), (5, None), (None, a), (None, None)], key=str)
        assert out.columns == df.columns


def linked(x, similarity=0.95):
    """Links and components of vectors by all pairs, after scaling each."""
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit = unit / np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= similarity
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(x))])
        if (new == label).all():
            return near, label
        label = new


def test_recall_at_the_threshold(spark):
    """With the default miss: thousands of pairs just above 0.95, half of them alone and half in one dense group."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((1500, 48))
    turn = rng.standard_normal(x.shape)
    turn -= x * (np.einsum("ij,ij->i", x, turn) / np.einsum("ij,ij->i", x, x))[:, None]
    cosine = rng.uniform(0.9501, 0.956, len(x))[:, None]
    mate = cosine * x / np.linalg.norm(x, axis=1)[:, None] + np.sqrt(1 - cosine**2) * turn / np.linalg.norm(turn, axis=1)[:, None]
    crowd = rng.standard_normal(48) + 0.22 * rng.standard_normal((1200, 48))
    every = np.concatenate([x, mate, crowd])
    near, label = linked(every)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.linked_vectors(spark, df).collect()}
    assert near.sum() > 20_000
    assert sum(n for n, _ in got.values()) >= 0.9995 * near.sum() and all(got[i][0] <= near[i].sum() for i in got)
    assert np.mean([got[i][1] == label[i] for i in got]) > 0.999


def test_magnitudes_and_repeated_ids(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((6, 8))
    x = np.concatenate([base * 1e200, (base + 0.05 * rng.standard_normal(base.shape)) * 1e-200, base * 1e-300, rng.standard_normal((20, 8))])
    near, label = linked(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    df = df.withColumn("key", F.lit("clash")).withColumn("pass", F.lit(0))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.linked_vectors(spark, df).collect()}
    assert all(got[i] == (near[i].sum(), label[i], label[i] == i) for i in range(len(x))) and near.sum() >= 24
    twice = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [2.0, -1.0]), (2, [1.0, 2.1])], "vec_id bigint, embedding array<double>")
    rows = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.linked_vectors(spark, twice).collect())
    assert rows == [(1, 0, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_vectors_of_each_length_are_linked(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = []
    for dim in (16, 5):
        centre = rng.standard_normal((4, dim))
        x = np.concatenate([rng.standard_normal((30, dim)), *(c + 0.1 * rng.standard_normal((8, dim)) for c in centre), np.repeat(centre[:1], 3, axis=0)])
        rows += [v.tolist() for v in x]
    rows += [None, [], [0.0] * 5, [1.0], [2.0], [float("nan")] * 5]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<double>")
    got = {tuple(r) for r in embeddings.linked_vectors(spark, df, miss=1e-6).select("vec_id", "n_links", "component_id", "kept").collect()}
    df.write.parquet(f"{tmp_path}/embeddings")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings/*.parquet')")
    assert got == set(con.execute(OP2_SQL).fetchall())
    assert embeddings.linked_vectors(spark, df.where("embedding IS NULL")).count() == 1

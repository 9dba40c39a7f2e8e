"""Whitening, against exact integers and numpy's eigen-solver."""

from __future__ import annotations

import math
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import whitening as w

SMALL = Path("/root/testdata/sf0.001")
VECTORS = "vec_id bigint, embedding array<float>"


def exact_fit(vectors) -> tuple[int, list[int], np.ndarray]:
    """n, S and the covariance of the distinct x, all in integers until the last division."""
    fit = sorted({tuple(math.floor(64 * float(c)) + 1000000 for c in v) for v in vectors})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    c = np.array([[n * v - s for v, s in zip(x, sums, strict=True)] for x in fit], dtype=object)
    return n, sums, np.array([[float(Fraction(int(v), n**3)) for v in row] for row in c.T @ c])


def test_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in df.collect()}
    n, sums, cov = exact_fit(vectors.values())
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:16], basis[:, ::-1][:, :16]
    rows = w.whitened_vectors(spark, df).collect()
    assert len(rows) == 16 * len(vectors) and {r["n"] for r in rows} == {n}
    by = {(r["vec_id"], r["component"]): r for r in rows}
    signs = None
    for vec_id, v in vectors.items():
        x = [math.floor(64 * float(c)) + 1000000 for c in v]
        c = [n * a - s for a, s in zip(x, sums, strict=True)]
        white = (np.array(c, dtype=float) / n) @ basis / np.sqrt(values)
        got = np.array([by[vec_id, k + 1]["whitened"] for k in range(16)])
        signs = np.sign(got * white) if signs is None else signs
        assert np.abs(got - signs * white).max() < 1e-9
        assert by[vec_id, 1]["deviation"] == sum(a * a for a in c) == by[vec_id, 16]["deviation_exact"]
    for k in range(16):
        assert by[0, k + 1]["explained"] == pytest.approx(values[k] / np.trace(cov), rel=1e-9)
    assert rows[0]["identity_error"] < 1e-9


def test_covariance_is_the_exact_one_rounded(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(700, 5)) * [1e-2, 1, 1e3, 1e6, 1] + [0, 1e5, 0, -1e6, 3]).astype(np.float32).tolist()
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], VECTORS).repartition(70)
    _, _, cov = exact_fit(vectors)
    fit = w.written(spark, w.fixed_point(df).select("x").distinct().repartition(130), "fit")  # more parts than one group merges
    got = w.fitted(fit, 5).covariance
    assert np.abs(got / cov - 1).max() < 4e-16


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [3.0, -1.0]), (7, [0.5, 4.0]), (8, [1.0, 2.0, 3.0]), (9, [3e38, 1.0, -3e38])]
    df = spark.createDataFrame(rows, VECTORS)
    for name in ("x", "n", "k", "white", "deviation"):
        df = df.withColumn(name, F.lit("clash"))
    out = w.whitened_vectors(spark, df).collect()
    two = [r for r in out if r["vec_id"] in (6, 7, None)]
    assert sorted((str(r["vec_id"]), r["component"], r["n"]) for r in two) == sorted([("6", 1, 3), ("6", 2, 3)] * 2 + [("None", 1, 3), ("None", 2, 3), ("7", 1, 3), ("7", 2, 3)])
    assert all(r["whitened"] is not None and r["identity_error"] < 1e-12 for r in two)
    three = {(r["vec_id"], r["component"]): r for r in out if r["vec_id"] in (8, 9)}
    assert set(three) == {(v, c) for v in (8, 9) for c in (1, 2, 3)}
    assert abs(three[8, 1]["whitened"]) == pytest.approx(1.0) and three[8, 2]["whitened"] is None  # two points vary in one direction
    assert three[8, 1]["deviation"] is None and three[8, 1]["deviation_exact"] == three[9, 1]["deviation_exact"] > 2**63
    assert w.whitened_vectors(spark, df.limit(0)).collect() == []
    (alone,) = w.whitened_vectors(spark, spark.createDataFrame([(1, [2.0])], VECTORS)).collect()
    assert alone["n"] == 1 and alone["deviation"] == 0 and alone["whitened"] is None and alone["explained"] is None


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 130])
def test_eigen(n):
    rng = np.random.default_rng(n)
    half = rng.normal(size=(n, max(1, n // 2)))
    for a in (rng.normal(size=(n, n)), half, np.eye(n), np.zeros((n, n)), np.diag(rng.integers(0, 3, n) * 1.0), np.ones((n, 1)) * 1e-9):
        a = a @ a.T
        values, vectors = w.eigen(a)
        scale = max(np.abs(a).max(), 1e-300) * n
        assert np.all(np.diff(values) <= 0)
        assert np.abs(a @ vectors - vectors * values).max() <= 4e-15 * scale
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() <= 4e-15 * n
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 4e-15 * scale


def test_error_free_transformations():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=200) * 10.0 ** rng.integers(-9, 9, 200), rng.normal(size=200) * 10.0 ** rng.integers(-9, 9, 200)
    for op, parts in ((lambda x, y: x + y, w.two_sum(a, b)), (lambda x, y: x * y, w.two_product(a, b))):
        assert all(op(Fraction(x), Fraction(y)) == Fraction(s) + Fraction(e) for x, y, s, e in zip(a, b, *parts, strict=True))

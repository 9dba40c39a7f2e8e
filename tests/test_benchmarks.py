"""Benchmarks where there is nothing, or nothing but repeats."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.operators import benchmarks


def test_boundaries(spark):
    gold = spark.createDataFrame([("T", t, p, e) for p, es in {"a": (False, True), "b": (True, True), "c": (False, None)}.items() for t, e in enumerate(es)] * 2, "predicate string, tolerance int, pair string, expected boolean")
    made = spark.createDataFrame([("T", 0, "b"), ("T", 0, "b"), ("T", 1, "c"), ("T", 1, "x")], "predicate string, tolerance int, pair string")
    got = {r["tolerance"]: r for r in benchmarks.tolerance_metrics(gold, made, ["pair"]).collect()}
    assert [(r["tp"], r["fp"], r["fn"], r["tn"], r["boundary"], r["boundary_accuracy"]) for r in (got[0], got[1])] == [(1, 0, 0, 2, 1, 1.0), (0, 1, 2, 0, 1, 0.0)]
    assert got[1]["precision"] == 0.0 and got[1]["f1"] == 0.0 and benchmarks.tolerance_metrics(gold.limit(0), made, ["pair"]).collect() == []


def test_sets_and_empty_populations(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id int, v string")
    b = spark.createDataFrame([(1, "y"), (2, None), (2, None), (4, "z")], "id int, v string")
    row = benchmarks.exact_sets(a, b, "id", ["v"]).first()
    assert (row["matched"], row["lost"], row["invented"], row["repeated"], row["v_accuracy"]) == (2, 1, 1, 1, 0.5)
    with pytest.raises(Exception, match="empty population"):
        benchmarks.exact_sets(a.limit(0), b, "id", ["v"]).collect()


def test_determinism(spark):
    a = spark.range(50).withColumn("v", F.col("id") % 3)
    runs = {"cold": a, "reversed": a.orderBy(F.desc("id")).select("v", "id"), "twice": a.unionByName(a.where("id = 1")), "none": a.limit(0)}
    assert {r["run"]: (r["n"], r["same"]) for r in benchmarks.determinism(runs).collect()} == {"cold": (50, True), "reversed": (50, True), "twice": (51, False), "none": (0, False)}

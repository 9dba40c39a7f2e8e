"""Shortest paths and containment against a plain breadth-first search."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import paths

EDGES = "predicate string, src string, dst string, edge_id string"


def by_hand(edges, anchor, target, depth):
    """All shortest walks of 1 to ``depth`` edges."""
    front = [([anchor], [])]
    for hops in range(1, depth + 1):
        front = [(ns + [b], es + [e]) for ns, es in front for _, a, b, e in edges if a == ns[-1] and b]
        if met := [p for p in front if p[0][-1] == target]:
            return hops, sorted(met, key=lambda p: (p[1], p[0]))
    return None, []


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("direction", ["forward", "reverse"])
def test_random_graphs(spark, seed, direction):
    rng = random.Random(seed)
    edges = [("CONTAINS", *(str(rng.randrange(8)) for _ in range(2)), f"e{k}") for k in range(15)] + [("CONTAINS", None, "1", "x"), ("CONTAINS", "1", None, "y")]
    pairs = [(str(a), str(b)) for a in range(4) for b in range(8)] * 2 + [(None, "1"), ("1", None), ("nobody", "1")]
    df, asked = spark.createDataFrame(edges, EDGES), spark.createDataFrame(pairs, "anchor string, target string")
    turned = edges if direction == "forward" else [(p, b, a, e) for p, a, b, e in edges]
    met = {(r["anchor"], r["target"]): (r["hops"], r["n_paths"]) for r in paths.searched(df, asked, 4, direction, hub=2)[0].collect()}
    assert set(met) == set(pairs)
    found: dict = {}
    for r in paths.numbered(paths.shortest_paths(df, asked, 4, direction, hub=2)).orderBy("rank").collect():
        found.setdefault((r["anchor"], r["node"]), []).append((r["node_ids"], r["edge_ids"]))
    for a, b in set(pairs):
        hops, ways = by_hand(turned, a, b, 4) if a and b else (None, [])
        assert met[a, b] == (hops, len(ways) or None) and found.get((a, b), []) == ways


def test_dense_graph_is_not_walked(spark):
    """Six hops in a complete graph of 40 nodes have four thousand million walks."""
    nodes = spark.range(40).select(F.col("id").cast("string").alias("n"))
    edges = nodes.select(F.col("n").alias("src"), F.explode(F.expr("transform(sequence(0, 39), x -> cast(x AS string))")).alias("dst")).where("src <> dst").selectExpr("'CONNECTS_TO' AS predicate", "src", "dst", "src || '-' || dst AS edge_id")
    out = spark.createDataFrame([("0", "far", "last")], "src string, dst string, edge_id string").selectExpr("'CONNECTS_TO' AS predicate", "*")
    chain = edges.unionByName(out).unionByName(spark.createDataFrame([("CONNECTS_TO", "far", "farther", "lastest")], EDGES))
    asked = spark.createDataFrame([("1", "farther"), ("1", "2")], "anchor string, target string")
    assert {(r["target"], r["hops"], int(r["n_paths"])) for r in paths.searched(chain, asked)[0].collect()} == {("farther", 3, 1), ("2", 1, 1)}


def test_containment(spark):
    edges = spark.createDataFrame([("HAS_SITE", "p", "s", "1"), ("CONTAINS", "s", "w", "2"), ("HAS_MATERIAL", "s", "m", "3")], EDGES)
    asked = spark.createDataFrame([("p", "w"), ("p", "m"), ("w", "p"), ("p", "p")], "anchor string, target string")
    got = {(r["anchor"], r["target"]): (r["contained"], r["hops"]) for r in paths.containment(edges, asked).collect()}
    assert got == {("p", "w"): (True, 2), ("p", "m"): (False, None), ("w", "p"): (False, None), ("p", "p"): (False, None)}
    assert paths.containment(edges.limit(0), asked).where("contained").count() == 0 and paths.containment(edges, asked.limit(0)).count() == 0
    for bad in (lambda: paths.containment(edges, asked, predicates=["HAS_MATERIAL"]), lambda: paths.searched(edges, asked, 7), lambda: paths.searched(edges, asked, 0)):
        with pytest.raises(ValueError):
            bad()


def test_edges_of_four_hops_are_not_kept(spark, monkeypatch):
    """A tree with twelve branches at a node: four hops down are 22620 edges, from both ends a few hundred."""
    from plumbline.sources.work import Work

    rows, written = [], Work.written

    def counted(self, df, name):
        out = written(self, df, name)
        rows.append(out.count() if not name.startswith(("steps", "sizes")) else 0)
        return out

    monkeypatch.setattr(Work, "written", counted)
    up = spark.range(1, 22621).selectExpr("'CONTAINS' AS predicate", "string((id - 1) div 12) AS src", "string(id) AS dst", "string(id) AS edge_id")
    asked = spark.createDataFrame([("0", "22620"), ("0", "9999999")], "anchor string, target string")
    assert {tuple(r) for r in paths.searched(up, asked, 4)[0].select("target", "hops", "n_paths").collect()} == {("22620", 4, 1), ("9999999", None, None)}
    assert sum(rows) < 500

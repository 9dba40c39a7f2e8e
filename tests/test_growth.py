"""Steps whose shuffles or memory grew faster than their input."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from oracle_support import SMALL
from plumbline.operators import benchmarks, documents, geometry, graph, inverted, linking, ranking, retrieval, thresholds
from plumbline.plans import registry, views
from plumbline.sources import generations


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_counted_where_they_lie(spark, monkeypatch):
    rows = [(1, "a b a"), (2, None), (3, "b"), (4, ""), (None, "c c")]
    df = spark.createDataFrame(rows, "id bigint, text string").coalesce(1)
    monkeypatch.setattr(retrieval, "TERMS", 2)  # a document may have more
    found = retrieval.postings(df, "id", "text", retrieval.analysed(F.col("text")))
    assert "Exchange" not in plan(found)
    assert {tuple(r) for r in found.collect()} == {(1, "a", 2, 3, "text"), (1, "b", 1, 3, "text"), (3, "b", 1, 1, "text"), (None, "c", 2, 2, "text")}


def test_dense_search_holds_little(spark):
    rng = np.random.default_rng(4)
    queries = [{"query_id": k, "vector": v.tolist()} for k, v in enumerate(rng.normal(size=(2000, 4)))]
    x = rng.normal(size=(10_000, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(x.tolist())], names=["id", "vector"])
    run = retrieval._nearest(queries, 20, spark.createDataFrame([], "query_id bigint, id bigint, score double"))
    tracemalloc.start()
    got = pa.Table.from_batches(list(run(iter([batch])))).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # a table of all cosines has 160 MB
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for k in (0, 1999):
        own = [i for q, i in zip(got["query_id"], got["id"], strict=True) if q == k]
        assert sorted(own) == sorted(np.argsort(-(unit @ np.array(queries[k]["vector"])))[:20].tolist())


def test_dense_search_over_several_stretches(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "STRETCH", 3)
    monkeypatch.setattr(retrieval, "CELLS", 4)
    monkeypatch.setattr(retrieval, "HELD", 8)
    rows = [(k and f"k{k:02}", [1.0, ((k or 5) * 7 % 5) / 10]) for k in [*range(1, 20), None]]
    df = spark.createDataFrame(rows, "id string, vector array<double>").coalesce(1)
    asked = spark.createDataFrame([(q, [1.0, q / 10]) for q in range(4)], "query_id int, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.dense(df, asked, depth=6).collect()}
    cos = lambda q, v: round((1 + q * v[1] / 10) / np.hypot(1, q / 10) / np.hypot(1, v[1]), 12)
    for q in range(4):
        want = sorted(rows, key=lambda r: (-cos(q, r[1]), r[0] or ""))[:6]
        assert [got[q, n] for n in range(1, 7)] == [i for i, _ in want]


def test_search_shuffles_no_hits_and_equal_queries_are_one(spark, monkeypatch):
    """Thousands of hits, of which a task hands on the best; shards and blocks of queries don't matter."""
    df = spark.range(600).selectExpr("id", "concat_ws(' ', 'all', if(id % 3 = 0, 'red', 'blue'), concat('n', id % 5)) AS text")
    terms = retrieval.analysed(F.col("text"))
    asked = spark.createDataFrame([(q, t) for q in range(40) for t in ("all", "red", f"n{q % 2}")], "query_id int, term string")
    want = {q: [k for k in range(600) if k % 3 == 0 and k % 5 == q][:5] for q in (0, 1)}
    for shard, held, cells in ((1 << 19, 1 << 22, 1 << 22), (100, 10, 3)):
        monkeypatch.setattr(inverted, "SHARD", shard)
        monkeypatch.setattr(inverted, "HELD", held)
        monkeypatch.setattr(inverted, "CELLS", cells)
        found = inverted.search(inverted.build(df, "id", {"text": terms}), asked, {"text": 1.0}, depth=5)
        assert "explode(postings" not in plan(found)
        got: dict = {}
        for r in found.orderBy("rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == {q: want[q % 2] for q in range(40)}


def _query(spark, name):
    return plan(registry.queries()[name](spark, str(SMALL)))


def test_edges_of_meshes_are_counted_where_they_lie(spark):
    found = _query(spark, "L4_closed")
    assert found.count("Exchange") == 2 and "Broadcast" not in found and "array_sort" not in found  # both of the boxes, for sums and edges


def test_documents_are_chunked_by_the_batch(spark, monkeypatch):
    monkeypatch.setattr(documents, "DOCUMENTS", 2)
    rows = [(d, k, k // 2 + 1, "Title" if k == 0 else f"text {k} of {d}, ") for d in (1, 2, 3, None) for k in (2, 0, 1)]
    got = documents.chunked(spark.createDataFrame(rows, "document_id int, block_index int, page int, text string"))
    assert "InPandas" not in plan(got)
    assert {(r["document_id"], r["section_title"], r["first_page"], r["last_page"], r["text"]) for r in got.collect()} == {(d, "Title", 1, 2, f"text 1 of {d},\ntext 2 of {d},") for d in (1, 2, 3, None)}


def test_questions_and_meshes_are_dealt_to_tasks(spark):
    """A small file is one task's, whatever is made of its rows."""
    for name in ("H11_names_made", "H8_conditions", "L4_closed", "L5_centroids"):
        assert f"{views.DEALT}), REPARTITION_BY_NUM" in _query(spark, name), name


def test_each_side_of_a_generation_is_read_once(spark):
    r = generations.Revisions("p", "n", "a", "b", "c")
    nodes = generations.node_records(spark.createDataFrame([("x", "site"), ("y", "site")], "node_id string, kind string"), r)
    edges = generations.edge_records(spark.createDataFrame([("TOUCHES", "e", "x", "y")], "predicate string, edge_id string, src string, dst string"), r, generations.DERIVED)
    found = generations.verification((nodes, edges.limit(0), edges), (nodes, edges.limit(0), edges.limit(0)), r)
    assert plan(found).count("Generate inline") == 6
    wrong = {c["name"]: c["violations"] for c in found.collect() if not c["passed"]}
    assert wrong == {"derived_count_exact": 1, "derived_id_set_exact": 1, "derived_occurrence_set_exact": 1, "derived_fingerprint_exact": 1, "derived_no_extra_occurrence": 1, "relationship_types_exact": 1}


def test_relations_without_an_end_are_dealt(spark):
    nodes = spark.createDataFrame([("a", "project"), ("b", "site"), ("b", "site")], "node_id string, kind string")
    rows = [("IfcRelAggregates", "g", "a", "b", 0)] * 2 + [("IfcRelAggregates", f"h{k}", "a", None, 0) for k in range(3)] + [("Other", "i", "a", "b", 0), ("IfcRelAggregates", "j", "b", "b", 0)]
    found = graph.native_edges(spark.createDataFrame(rows, "relation_class string, global_id string, src string, dst string, occurrence int"), nodes, "p")
    assert "min_by" not in plan(found) and "_none" in plan(found)
    assert sorted((r["global_id"], r["issue"] or r["predicate"]) for r in found.collect()) == [("g", "HAS_SITE"), *((f"h{k}", "MISSING_ENDPOINT") for k in range(3)), ("i", "UNSUPPORTED_RELATION_SUBTYPE"), ("j", "DUPLICATE_ENDPOINT_IN_RELATION")]


def test_relations_at_all_tolerances_are_shuffled_once(spark):
    gold = spark.createDataFrame([("A", t, k, t > 0) for t in (0, 1) for k in ("x", "y", None)], "predicate string, tolerance int, pair string, expected boolean")
    made = spark.createDataFrame([("A", 1, "x"), ("A", 1, "x"), ("A", 1, None), ("A", 1, "z")], "predicate string, tolerance int, pair string")
    found = benchmarks.tolerance_metrics(gold, made, ["pair"])
    assert plan(found).count("Exchange") == 2 and "Join" not in plan(found)  # the other one is of the sums
    assert {(r["tolerance"], r["support"], r["tp"], r["fp"], r["fn"], r["tn"], r["boundary"]) for r in found.collect()} == {(0, 3, 0, 0, 0, 3, 3), (1, 3, 1, 0, 2, 0, 3)}


def test_catalogues_are_not_broadcast(spark):
    elements = spark.createDataFrame([("el_" + "0" * 32, "g" * 22)], "element_id string, global_id string")
    chunks = spark.createDataFrame([(1, "see " + "g" * 22)], "chunk_id int, text string")
    found = linking.identifier_mentions(chunks, elements)
    assert "BroadcastHashJoin" not in plan(found)
    assert [tuple(r) for r in found.collect()] == [(1, "g" * 22, "global_id", "el_" + "0" * 32)]


def test_steps_of_lists_need_no_aggregate(spark):
    lists = spark.createDataFrame([(1, 1, 0.9, 3), (1, 2, 0.5, 0), (1, 3, 0.5, 2)], "query_id int, rank int, score double, grade int")
    queries = spark.createDataFrame([(1, 0, 2, [3, 2])], "query_id int, fold int, relevant_total int, ideal_grades array<int>")
    found = thresholds.steps(lists, queries)
    assert "Aggregate" not in plan(found)
    assert sorted((r["score"], int(r["accepted"]), float(r["recall"])) for r in found.collect()) == [(0.5, 3, 1.0), (0.9, 1, 0.5)]


def test_judgements_are_not_listed_for_each_query(spark):
    assert "NestedLoop" not in (found := _query(spark, "N9_ranking_quality")) and "CartesianProduct" not in found
    qrels = [(t, i, (i * 7 + t) % 4) for t in range(3) for i in range(60)] + [(2, i, 5) for i in range(15)]
    topics = [(q, q % 4) for q in range(9)] + [(8, 1)]  # topic 3 has no judgements, query 8 two topics
    lists = spark.createDataFrame([(q, (i * 11 + q) % 80, i + 1) for q in range(9) for i in range(30)], "query_id int, id int, rank int")
    topics, shared = spark.createDataFrame(topics, "query_id int, topic int"), spark.createDataFrame(qrels, "topic int, id int, grade int")
    each = topics.join(shared, "topic").select("query_id", "id", "grade")
    got = {r["query_id"]: tuple(r) for r in ranking.quality(lists, shared, topics=topics).collect()}
    assert got[3] == (3, 1.0, 0.0, 1.0, 0.0)
    single = {q: x for q, x in got.items() if q != 8}
    assert single == {r["query_id"]: tuple(r) for r in ranking.quality(lists, each).collect() if r["query_id"] != 8}
    ideal = sorted((g for t, _, g in qrels if t == 2), reverse=True)[:10]
    ranked = [([g for t, x, g in qrels if (t, x) == (2, (i * 11 + 2) % 80)] or [0]) for i in range(10)]
    gain = lambda grades: sum((2**g - 1) / np.log2(r + 2) for r, g in enumerate(grades))
    flat = sum((2**g - 1) / np.log2(r + 2) for r, own in enumerate(ranked) for g in own)
    assert abs(got[2][4] - flat / gain(ideal)) < 1e-6


def _placed(spark, n, places):
    """n boxes on so many places of the X axis, of which each meets the next."""
    x = (F.col("id") % places).cast("decimal(20,6)")
    end = (x + F.lit(1).cast("decimal(20,6)")).cast("decimal(20,6)")
    return spark.range(n).select("id", *(c for axis in "xyz" for c in (x.alias(f"{axis}0"), end.alias(f"{axis}1"))))


def test_members_of_a_place_go_to_few_tasks(spark):
    """Where they repeat they take little space. Members of both sides are not shuffled with their pair."""
    x = (F.col("id") % 60).cast("decimal(20,6)")
    pairs = geometry.swept_pairs(spark.range(600).select("id", x.alias("x0"), (x + 100).cast("decimal(20,6)").alias("x1")))
    assert "RoundRobin" not in plan(pairs)
    at = pairs.select("b.id", F.spark_partition_id().alias("at")).groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("at").alias("tasks")).collect()
    assert {r["id"]: r["n"] for r in at} == {k: k for k in range(1, 600)}
    assert max(r["tasks"] for r in at) <= geometry.DEALS


def test_members_meet_in_parts_and_runs(spark, monkeypatch):
    """Boxes with other columns, several parts of a place, runs of a few members, and ids that are missing."""
    for name, value in (("MEMBERS", 7), ("RUN", 3), ("TASKS", 5), ("DEALS", 2)):
        monkeypatch.setattr(geometry, name, value)
    b = _placed(spark, 60, 4)
    b = b.union(b.where("id < 3").withColumn("id", F.lit(None).cast("bigint"))).withColumn("name", F.create_map(F.lit("n"), F.concat(F.lit("n"), "id")))
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if abs(i % 4 - j % 4) <= 1}
    for found in (geometry.swept_pairs(b), geometry.column_pairs(b), geometry.swept_pairs(b.select("id", "x0", "x1"))):
        rows = found.collect()
        assert len(rows) == len(want) and {(r["a"]["id"], r["b"]["id"]) for r in rows} == want
        assert all("name" not in r["a"] or (r["a"]["name"], r["b"]["name"]) == ({"n": f"n{r['a']['id']}"}, {"n": f"n{r['b']['id']}"}) for r in rows)
        assert all(int(r["b"]["x0"]) == r["b"]["id"] % 4 for r in rows)
    met = geometry.relations(b.drop("name")).groupBy("predicate").count().collect()
    each = 4 * 15 * 14 // 2
    assert {r["predicate"]: r["count"] for r in met} == {"INTERSECTS": each, "TOUCHES": len(want) - each}

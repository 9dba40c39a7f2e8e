"""Operators on small tables: edge cases that the driver's tables don't have."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import ids, numbers, render, text
from plumbline.operators import aggregates, documents, evaluation, evidence, facts, filters, geometry, graph, ranking, retrieval
from plumbline.sources import records, store


def test_ids_use_byte_lengths(spark):
    want = "el_" + hashlib.sha256("4:casa22:".encode() + b"0" * 22).hexdigest()[:32]
    df = spark.createDataFrame([("casa", "0" * 22, "ação")], "p string, g string, u string")
    r = df.select(ids.element_id(F.col("p"), F.col("g")).alias("a"), ids.framed(F.col("u")).alias("b"), ids.framed_with_commas(F.col("u")).alias("c")).first()
    assert r["a"] == want and r["b"] == "6:ação" and r["c"] == "6:ação,"


def test_numbers(spark):
    df = spark.createDataFrame([(1 / 128, 0.3, -0.0000001, "a"), (None, None, None, None)], "x double, y double, z double, s string")
    r = df.select(numbers.metric(F.col("x")).alias("m"), numbers.fixed(F.col("y")).alias("q"), numbers.fixed(F.col("z")).alias("z"), numbers.fold_of(F.col("s")).alias("f")).collect()
    assert r[0]["m"] == 0.007812 and str(r[0]["q"]) == "0.300000" and str(r[0]["z"]) == "0.000000"
    assert r[0]["f"] == int(hashlib.sha256(b"a").hexdigest(), 16) % 5 and r[1]["q"] is None


def test_text_forms():
    assert text.query_form("Paredes de BETÃO!") == "paredes de betao"
    assert text.support_form("  ﬁm  DE ") == "fim de"
    assert text.display_form("\n a\t b\r\nc \n\n") == "a b\nc"
    assert text.tokens("Ação 12") == [("acao", 0, 4), ("12", 5, 7)]
    assert text.osa_distance("ab", "ba") == 1 and text.osa_distance("ca", "abc") == 3 and text.osa_distance("abc", "xyz", 1) == 2
    assert text.error_rates("a b", "a c") == (1 / 3, 1 / 2)


def test_filters_on_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (2, [], "x"), (3, ["a"], "b")], "k int, m array<string>, s string")
    keep = lambda c: [r["k"] for r in df.where(c).orderBy("k").collect()]
    assert keep(filters.gold_predicate("s", "not_in", ["b"])) == [1, 2]
    assert keep(filters.gold_predicate("m", "all_in", ["a"], True)) == [3]
    assert keep(filters.gold_predicate("m", "not_in", ["a"], True)) == [1, 2]
    assert keep(filters.gold_predicate("s", "is_null")) == [1]
    with pytest.raises(ValueError):
        filters.canonical_filter(project="")
    with pytest.raises(KeyError):
        filters.by_ids(df, "s", ["zz"])
    assert filters.storey_labels("-1")[-1] == "cave" and filters.storey_labels("L2")[0] == "l2" and filters.storey_labels(" ") == []


def test_fusion_is_exact(spark):
    a = spark.createDataFrame([("q", i, i) for i in range(1, 6)], "query_id string, id int, rank int")
    b = spark.createDataFrame([("q", 6 - i, i) for i in range(1, 6)], "query_id string, id int, rank int")
    rows = ranking.fused(a, b, ["query_id"]).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [1, 5, 2, 4, 3]
    empty = a.limit(0)
    assert [r["id"] for r in retrieval.hybrid(a, empty).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_quality_without_relevant_rows(spark):
    ranked = spark.createDataFrame([("q", 1, 1)], "query_id string, id int, rank int")
    none = spark.createDataFrame([], "query_id string, id int, grade int")
    r = ranking.quality(ranked, none).first()
    assert (r["recall"], r["mrr"], r["ndcg"]) == (1.0, 1.0, 0.0)


def test_dense_skips_zero_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id int, vector array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    assert [(r["id"], round(r["score"], 3)) for r in retrieval.dense(v, q).orderBy("rank").collect()] == [(1, 1.0), (3, 0.707)]
    with pytest.raises(ValueError):
        retrieval.checked_vector([float("nan")], 1)
    with pytest.raises(ValueError):
        retrieval.preflight({"dim": 3}, {"dim": 4})


def test_embedder_is_checked(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    assert retrieval.embedded(df, "t", lambda ts: [[1.0, 0.0] for _ in ts], 2).count() == 2


def test_chunk_fold():
    rows = documents.fold_blocks([(0, 1, "a" * 700), (0, 1, "b " * 300), (1, 2, "c" * 50)])
    assert [r["section_index"] for r in rows] == [0, 0, 1] and all(len(r["text"]) <= documents.LIMIT for r in rows)
    assert rows[1]["text"] != rows[1]["own"] or len(rows[0]["own"]) > 0
    assert documents.hard_split("x" * 4000) == ["x" * 1600, "x" * 1600, "x" * 800]
    assert documents.fold_blocks([]) == []
    short = documents.fold_blocks([(0, 1, "a" * 1190), (0, 1, "tail")])
    assert len(short) == 1 and short[0]["text"].endswith("tail")


def test_linking():
    names = {"Porta Norte": ["e1"], "Porta": ["e2"], "Sala Azul": ["e3", "e4"]}
    found = documents.link_mentions("A porta norte e a porta; sala azul", names)
    assert [(e, m) for e, m, _, _ in found] == [("e1", "exact"), ("e2", "exact")]
    fuzzy = documents.link_mentions("a portta norte", {"Porta Norte": ["e1"]})
    assert fuzzy and fuzzy[0][:2] == ("e1", "fuzzy")


def test_typed_values(spark):
    df = spark.createDataFrame([("1",), ("1.0",), ("true",), ("null",), ('"x"',)], "v string")
    rows = [r["t"] for r in df.select(facts.typed(F.col("v")).alias("t")).collect()]
    assert [r["value_type"] for r in rows] == ["int", "float", "bool", "null", "text"]
    assert rows[0]["value_integer"] == 1 and rows[0]["value_number"] is None and rows[4]["value_text"] == "x"


def test_not_finite_drops_the_property(spark):
    df = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [1.0, 2.0]), (3, None)], "k int, v array<double>")
    assert [(r["k"], r["occurrence_key"]) for r in facts.atomised(df, ["k"], "v").collect()] == [(2, "item:000000"), (2, "item:000001")]


def test_broad_phases_agree(spark):
    from plumbline.plans.views import boxes

    b = boxes(spark, "/root/testdata/sf0.001").where("id < 150")
    want = geometry.relations(b, broad_phase="exhaustive").collect()
    for phase in ("columns", "sweep"):
        assert sorted(geometry.relations(b, broad_phase=phase).collect()) == sorted(want)


def test_walk_rules(spark):
    e = spark.createDataFrame([("a", "b", "P", "1"), ("b", "a", "P", "2"), ("b", "c", "P", "3")], "src string, dst string, predicate string, edge_id string")
    w = graph.walks(e, spark.createDataFrame([("a",)], "node string"), 3)
    assert sorted(r["edge_ids"] for r in w.collect()) == [["1"], ["1", "2"], ["1", "3"]]
    with pytest.raises(ValueError):
        graph.validated("ancestors", None, "forward", 2)
    with pytest.raises(ValueError):
        graph.validated("relation_exists", ["HAS_SITE", "CONTAINS"], "forward", 1)
    assert graph.validated("ancestors", None, "reverse", 2) == graph.SPATIAL
    with pytest.raises(ValueError):
        graph.walks(e, e, 7)
    assert graph.stale(e, e.limit(0), "edge_id", is_complete=False).count() == 0


def test_snapshots():
    key, who = b"k", {"index": "v1"}
    token = evidence.sign_snapshot(["b", "a"], who, key, now=100)
    assert evidence.open_snapshot(token, who, key, now=200) == ["b", "a"]
    for bad, reason in ((dict(token=token + "x"), "signature"), (dict(key=b"z"), "signature"), (dict(identity={}), "identity"), (dict(now=10_000), "expired"), (dict(token="a.b"), "structure"), (dict(token="x" * 40_000), "size")):
        with pytest.raises(ValueError, match=reason):
            evidence.open_snapshot(**({"token": token, "identity": who, "key": key, "now": 200} | bad))
    with pytest.raises(ValueError):
        evidence.sign_snapshot(["a", "a"], who, key)


def test_items_of_two_stores_are_refused(spark):
    rows = [("d", "p", "s", store_, 1, "c", "m") for store_ in ("x", "y")]
    df = spark.createDataFrame(rows, "kind string, project_id string, source_id string, store string, position int, content string, method string")
    with pytest.raises(Exception, match="two stores"):
        evidence.merged(df).collect()
    assert evidence.quote_holds("Hello  WORLD", "say hello world!") and not evidence.quote_holds("hello", "hello")


def test_gates_and_selectors():
    assert evaluation.gates({"a": 1.0}, [("a", "ge", 0.5), ("b", "ge", 0.1)]) == [("b", "ge")]
    assert evaluation.gates({}, [("a", "ge", 0.5)], {"f": ("x", "y")}) == [("f", "pin")]
    assert evaluation.dimension_choice([{"ndcg": 0.80, "p95": 2, "bytes": 1, "dim": 1}, {"ndcg": 0.805, "p95": 3, "bytes": 1, "dim": 2}], 57)["dim"] == 1


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([("b", "x", None), ("a", "y", "z")], "element_id string, name string, description string")
    records.write_lines(df, str(tmp_path / "out"), ["element_id"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"description":"z","element_id":"a","name":"y"}', '{"element_id":"b","name":"x"}']
    back = records.read_lines(spark, str(tmp_path / "out"), "element", ["element_id"])
    assert back.where("error IS NOT NULL").count() == 0 and back.count() == 2
    assert records.digest_of(df, df.columns) == records.digest_of(df.repartition(3), df.columns)


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    df = spark.range(10).withColumn("id", F.col("id").cast("string"))
    a, b = s.create("t", 1, {"dim": 4}), s.create("t", 2, {"dim": 8})
    assert s.create("t", 1, {"dim": 4}) == a
    with pytest.raises(ValueError):
        s.create("t", 1, {"dim": 5})
    assert s.replace(a, df, "id")["rows"] == 10
    with pytest.raises(ValueError):
        s.replace(b, df, "id", invalid=F.col("id") == "3")
    s.promote("t", a)
    with pytest.raises(RuntimeError):
        s.promote("t", b, expected=b)
    s.promote("t", b, expected=a)
    assert s.resolve("t") == b and s.status() == [{"alias": "t", "previous": a, "target": b}]
    s.rollback("t")
    assert s.resolve("t", {"dim": 4}) == a
    with pytest.raises(ValueError):
        s.resolve("t", {"dim": 9})
    assert store.fixed_sample(df.limit(0), "id").count() == 0 and store.compatible(df, df.where("id > 3"))


def test_incremental(spark, tmp_path):
    from plumbline.streaming import incremental

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"element_id":"1","name":"x"}\n\n{bad\n{"element_id":"1","name":"x"}\n')
    q = incremental.upserts(incremental.record_stream(spark, str(folder), "element", ["element_id"]), str(tmp_path / "out"), "element_id", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_renderers(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], "d", "body"), ([], None, "x")], "p array<string>, t string, b string")
    rows = [r["x"] for r in df.select(render.chunk_text(F.col("p"), F.col("t"), F.col("b")).alias("x")).collect()]
    assert rows == ["a > b > c\nbody", "x"]
    assert render.redacted({"token": "s", "a": {"Password": 1, "b": 2}}) == {"token": "***", "a": {"Password": "***", "b": 2}}


def test_mesh_angle_and_counts(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0], [-1.0, 0.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(geometry.angle(F.col("a"), F.col("b")).alias("d")).first()["d"] == pytest.approx(0)
    t = spark.createDataFrame([("x", 1.0), ("x", None)], "k string, v double")
    assert t.groupBy("k").agg(aggregates.all_or_nothing_min("v").alias("v")).first()["v"] is None
    assert math.isclose(1.0, 1.0)


def test_sections_count_as_they_should(spark):
    """Empty blocks are no blocks; what stands before the first heading is section 0; the last block is no heading."""
    body = "This is body text that ends with a full stop."
    rows = [(1, 0, "  "), (1, 1, "Title"), (1, 2, body), (1, 3, "Next"), (1, 4, "Again"), (1, 5, body), (1, 6, "No heading"), (1, 7, " ")]
    rows += [(2, 0, body), (2, 1, "Late"), (2, 2, body)]
    df = spark.createDataFrame([(d, i, 1, t) for d, i, t in rows], "document_id int, block_index int, page int, text string")
    got = [(r["document_id"], r["chunk_index"], r["section_index"], r["section_title"], r["text"]) for r in documents.chunked(df).orderBy("document_id", "chunk_index").collect()]
    assert got == [(1, 0, 0, "Title", body), (1, 1, 2, "Again", f"{body}\nNo heading"), (2, 0, 0, None, body), (2, 1, 1, "Late", body)]


def test_chunks_by_hand():
    """Overlap counts towards the target, is cut at a space, and stays within its section; regions go with their text."""
    a, b, c = ("word " * 160).strip(), ("other " * 100).strip(), ("third " * 60).strip()  # 799, 599 and 359 characters
    one, two = documents.fold_blocks([(0, 1, a, 0), (0, 1, b, 1), (0, 2, c, 0)])
    tail = ("word " * 30).strip()
    assert one["text"] == a and one["regions"] == [(1, 0)] and (one["first_page"], one["last_page"]) == (1, 1)
    assert two["text"] == f"{tail}\n{b}\n{c}" and two["own"] == f"{b}\n{c}" and two["regions"] == [(1, 0), (1, 1), (2, 0)] and two["last_page"] == 2
    three = documents.fold_blocks([(0, 1, a), (0, 1, b), (0, 1, "x" * 470)])  # 149 + 599 + 470 and a line end: over 1200
    assert [len(r["text"]) for r in three] == [799, 149 + 1 + 599, 149 + 1 + 470]
    again = documents.fold_blocks([(0, 1, b), (1, 1, "y " * 900 + "end")])  # the block that opens a later section carries nothing over
    assert [r["section_index"] for r in again] == [0, 1, 1] and again[2]["own"] == again[2]["text"]
    runt = documents.fold_blocks([(0, 1, "z" * 1150), (0, 1, "w" * 60)])
    assert len(runt) == 2 and runt[1]["text"].endswith("w" * 60)  # with what it carries over it is no runt


def test_linking_outcomes():
    from plumbline.operators.linking import Linker, eligible_name

    assert eligible_name("a bc") and not eligible_name("abc") and not eligible_name("Porta") and not eligible_name("a b c d e f g h i") and not eligible_name(None)
    element = lambda i, name, **at: {"element_id": "el_" + f"{i:032x}", "global_id": f"{i:022d}", "name": name} | at
    linker = Linker([element(1, "Caldeira Norte"), element(2, "Caldeira Norte Velha"), element(3, "Valve", storey="Piso Um"), element(4, "Valve", storey="Piso Dois"), element(5, "Porta"), element(6, "Pump Alpha"), element(7, "Pump Alphb")])
    look = lambda text: [(text[m.start : m.stop], m.outcome, m.element_id and int(m.element_id[3:], 16), m.method) for m in linker.mentions(text)]
    assert look("a caldeira norte velha, CALDEIRA NORTE.") == [("caldeira norte velha", "linked", 2, "exact_name"), ("CALDEIRA NORTE", "linked", 1, "exact_name")]
    assert look("valve on") == [("valve", "ambiguous_duplicate_name", None, None)]
    assert look("valve at piso dois") == [("valve", "linked", 4, "exact_name_location")]
    assert look("valve of piso um, piso dois") == [("valve", "ambiguous_location_conflict", None, None)]
    assert look("porta") == [] and look("caldeiro norte") == [("caldeiro norte", "linked", 1, "fuzzy_name")]
    assert look("pump alphc") == [("pump alphc", "ambiguous_fuzzy_margin", None, None)]
    assert look("norte") == [("norte", "unresolved_below_threshold", None, None)]
    assert look(f"{1:022d} {99:022d} el_{2:032x}") == [(f"{1:022d}", "linked", 1, "global_id"), (f"{99:022d}", "unresolved_unknown_identifier", None, None), (f"el_{2:032x}", "linked", 2, "element_id")]
    crowded = Linker([element(i, f"unit number {i}") for i in range(201)])
    assert crowded.mentions("unit")[0].outcome == "unresolved_candidate_bound"
    assert [(e[-1], m) for e, m, _, _ in linker.links(f"caldeira norte e {1:022d}")] == [("1", "global_id")]


def test_records_without_nulls():
    assert render.pruned({"a": None, "b": {"c": None}, "d": [], "e": "", "f": 0, "g": [{"h": 1, "i": None}]}) == {"d": [], "e": "", "f": 0, "g": [{"h": 1}]}
    with pytest.raises(ValueError):
        render.pruned({"a": [{"b": None}]})


def test_what_is_missing_is_an_error(spark):
    ranked = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    with pytest.raises(Exception, match="nothing is known of 2"):
        ranking.enriched(ranked, spark.createDataFrame([(1, "x")], "id int, t string")).collect()
    with pytest.raises(ValueError):
        ranking.document_page(ranked, 2, 5)
    assert ranking.document_page(ranked, 1, 5).count() == 1
    chunk = spark.createDataFrame([("d", "r", "l"), ("e", "r", "l")], "document_id string, revision_id string, link_revision_id string")
    with pytest.raises(Exception, match="no current revisions of document e"):
        filters.active_chunks(chunk, chunk.where("document_id = 'd'")).collect()
    from plumbline.operators import evaluation

    with pytest.raises(Exception, match="no questions"):
        evaluation.routing_accuracy(spark.createDataFrame([], "found string, expected string")).collect()


def test_sample_of_a_large_table(spark):
    from plumbline.sources import store

    df = spark.range(100_000).selectExpr("lpad(cast(hash(id) as string), 12, '0') as k", "id")
    ordered = sorted(r["k"] for r in df.select("k").collect())
    got = sorted(r["k"] for r in store.fixed_sample(df, "k").collect())
    assert got == sorted({ordered[0], ordered[(len(ordered) - 1) // 2], ordered[-1]})
    assert store.fixed_sample(df.limit(0), "k").count() == 0 and store.fixed_sample(df.limit(1), "k").count() == 1


def test_packs_say_what_is_wrong_with_them(spark):
    from plumbline.operators import packs

    told = lambda rows, circumstances, **kw: packs.pack_caveats(spark.createDataFrame(rows, "source_id string, conflict boolean"), circumstances, **kw).first()["caveats"]
    assert told([], []) == ["no_evidence"]
    assert told([("a", False)], ["snapshot"]) == ["snapshot_page_without_scores"]
    assert told([("a", None), ("b", True)], ["accept_all"], limit=1) == ["items_truncated_by_limit", "metadata_conflict", "threshold_accept_all"]
    page = spark.createDataFrame([("", 0, "c")], "project_id string, position int, base_chunk_id string").selectExpr("*", "'t' AS content", "false AS truncated", "false AS ocr", "array('r') AS page_regions", "1 AS page_number", "null AS page_span")
    with pytest.raises(Exception, match="needs its project"):
        packs.document_items(page, replayed=True).collect()
    shown = packs.public_items(packs.document_items(page.withColumn("project_id", F.lit("p")), replayed=True).withColumn("reference", F.lit("E001")))
    assert shown.columns == ["reference", "kind", "project_id", "source_id", "content", "provenance", "caveats"]
    assert shown.first()["provenance"][0].asDict() == {"method": "snapshot_page", "rank": 1, "score_kind": None, "score": None}
    assert packs.document_items(page.limit(0), replayed=True).count() == 0


def test_records_of_a_generation(spark):
    from plumbline.operators import graph

    nodes = spark.createDataFrame([("p", "a", "space", "", 1), ("p", "b", "element", "n", None)], "project_id string, node_id string, kind string, name string, x int")
    got = graph.projected_nodes(nodes, "1", "r")
    assert [(r["label"], r["name"]) for r in got.orderBy("node_id").collect()] == [("Space", None), ("Element", "n")]
    for bad in [("p", "a", "shed", "", 1), ("", "a", "space", "", 1), ("p", None, "space", "", 1)]:
        with pytest.raises(Exception, match="no label|a node without"):
            graph.projected_nodes(spark.createDataFrame([bad], nodes.schema), "1", "r").collect()
    with pytest.raises(Exception, match="no such predicate"):
        graph.projected_edges(spark.createDataFrame([("LIKES", "e", "a", "b")], "predicate string, edge_id string, src string, dst string"), "p", "1", "r", "s", "native").collect()
    mark = lambda df: graph.occurrence_fingerprint(df, "node_id", "project_id").first()["fingerprint"]
    assert mark(nodes) == mark(nodes.repartition(5).orderBy(F.desc("node_id")).select(*reversed(nodes.columns)))
    assert len({mark(nodes), mark(nodes.withColumn("x", F.lit(1))), mark(nodes.limit(1)), mark(nodes.withColumn("name", F.when(F.col("name") != "", F.col("name"))))}) == 4
    many = spark.range(5000).selectExpr("'p' AS project_id", "cast(id AS string) AS node_id")
    assert graph.occurrence_fingerprint(many, "node_id", "project_id", buckets=16).first()["n"] == 5000


def test_no_link_was_made(spark):
    from plumbline.operators import evaluation

    links = spark.createDataFrame([(1, "e", "exact_name", "0-3")], "case_id int, element_id string, method string, spans string")
    assert tuple(evaluation.linking_score(links.limit(0), links, ["exact_name"]).first()) == (0.0, 0.0, 1.0)
    assert tuple(evaluation.linking_score(links, links.limit(0), ["exact_name"]).first()) == (1.0, 0.0, 0.0)


def test_pairs_of_equal_boxes_and_of_many_rows(spark):
    """2400 boxes on three places, and more rows than 5000 as a reference."""
    d = "decimal(20,6)"
    b = spark.range(2400).select("id", *(((F.col("id") % 3 * 10) if x == "x" else F.lit(0)).cast(d).alias(f"{x}0") for x in "xyz"), *(((F.col("id") % 3 * 10) if x == "x" else F.lit(0)).cast(d).alias("_" + x) for x in "xyz"))
    b = b.select("id", *(c for x in "xyz" for c in (f"{x}0", (F.col("_" + x) + F.lit(1).cast(d)).cast(d).alias(f"{x}1"))))
    each = 3 * 800 * 799 // 2
    assert geometry.column_pairs(b).count() == geometry.swept_pairs(b).count() == each
    assert [tuple(r) for r in geometry.relations(b).groupBy("predicate", "quality").count().collect()] == [("INTERSECTS", "exact", each)]
    near = geometry.column_pairs(b).where("b.id < 6")
    assert {(r["a"]["id"], r["b"]["id"], float(r["b"]["x1"])) for r in near.collect()} == {(0, 3, 1.0), (1, 4, 11.0), (2, 5, 21.0)}
    assert geometry.exhaustive_pairs(spark.range(5001)).count() == 5001 * 5000 // 2


def test_tied_links_are_told_as_in_sql(spark, tmp_path):
    """Lines of a part that agree in number and order but not in their flag."""
    import duckdb

    from plumbline.plans import registry

    rows = [(part, 1, 7, flag) for part in range(50) for flag in ("RAN", "NAR", "ANR")[part % 3]]
    spark.createDataFrame(rows, "l_partkey bigint, l_linenumber int, l_orderkey bigint, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    got = sorted(tuple(r) for r in registry.queries()["E8_strongest_link"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(registry.oracle_sql()["E8_strongest_link"]).fetchall()) == [(part, "RNA"[part % 3], 1) for part in range(50)]


def test_rerank_texts_of_odd_documents_are_those_of_sql(spark, tmp_path):
    import duckdb
    from oracle_support import comparable

    from plumbline.plans import registry

    texts = ["plain", "", " ", " " * 1300, " " * 1200 + "late", "\n", " ", "é" * 900, "👩‍👩‍👧" * 500, "\r\n" * 700, "a\0b", None]
    rows = [(k, t, "en", "web") for k, t in enumerate(texts)] + [(90, "x", "", ""), (91, "x", None, "web"), (92, "x", "en", None), (93, "", "en", " ")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["A26_rerank_text"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert comparable(got) == comparable(con.execute(registry.oracle_sql()["A26_rerank_text"]).fetchall())

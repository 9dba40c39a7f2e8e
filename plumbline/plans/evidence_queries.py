"""Queries of evidence by route, citations, linking scores, graph records and the replacement of geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import evaluation, geometry, graph, packs

from .views import EDGES_SQL, ELEMENTS_SQL, edges, elements, table

Q: dict = {}
SQL: dict = {}


def _add(name, run, sql=None):
    Q[name] = run
    if sql:
        SQL[name] = sql


def _shown(items):
    """Items as flat texts, for comparison."""
    line = lambda p: F.concat_ws(":", p["method"], p["rank"].cast("string"), p["score_kind"], F.when(p["accepted"], "yes"))
    return items.select("kind", "source_id", "position", F.array_join(F.transform("provenance", line), ",").alias("provenance"), F.array_join("caveats", ",").alias("caveats"))


def _page(s, d):
    """Elements as a ranked page; every third one wasn't found by words, every fifth not by its vector."""
    e, k = elements(s, d), F.col("key")
    return e.select(
        "project_id", k.alias("id"), k.alias("position"), F.col("name").alias("content"), (F.col("height") > 40).alias("truncated"), (k + 1).alias("reranked_rank"), (F.col("height") / 50).alias("reranker_score"),
        (F.col("height") > 25).alias("accepted"), (k + 2).alias("fused_rank"), F.lit(0.5).alias("fused_score"), F.when(k % 3 > 0, k).alias("bm25_rank"), F.lit(1.5).alias("bm25_score"), F.when(k % 5 > 0, k).alias("dense_rank"), F.lit(0.25).alias("dense_score"),
    )


_SOURCES = "CASE WHEN key % 3 > 0 THEN 'bm25:' || key || ':bm25_score' END, CASE WHEN key % 5 > 0 THEN 'dense_knn:' || key || ':dense_similarity' END"
_add(
    "N3_hybrid_items",
    lambda s, d: _shown(packs.hybrid_items(_page(s, d))),
    f"""WITH {ELEMENTS_SQL} SELECT 'canonical_element' AS kind, CAST(key AS VARCHAR) AS source_id, key AS position, CASE WHEN height > 40 THEN 'truncated_projection' ELSE '' END AS caveats,
      concat_ws(',', {_SOURCES}, 'reranker:' || (key + 1) || ':reranker_probability' || CASE WHEN height > 25 THEN ':yes' ELSE '' END, 'rrf_fusion:' || (key + 2) || ':rrf_fused') AS provenance FROM elements""",
)
_add(
    "N3_snapshot_items",
    lambda s, d: _shown(packs.snapshot_items(_page(s, d))),
    f"WITH {ELEMENTS_SQL} SELECT 'canonical_element' AS kind, CAST(key AS VARCHAR) AS source_id, key AS position, 'snapshot_page:' || (key + 1) AS provenance, CASE WHEN height > 40 THEN 'truncated_projection' ELSE '' END AS caveats FROM elements",
)


def _passages(s, d):
    """The page as passages: some read by OCR, some of these without regions, some without a page."""
    k = F.col("id")
    regions = F.when(k % 4 > 0, F.array(F.lit("r"))).otherwise(F.array().cast("array<string>"))
    return _page(s, d).select("*", F.concat(F.lit("ch_"), k.cast("string")).alias("base_chunk_id"), (k % 2 == 0).alias("ocr"), regions.alias("page_regions"), F.when(k % 7 > 0, k % 7).alias("page_number"), F.lit(None).cast("string").alias("page_span"))


_add(
    "N3_document_items",
    lambda s, d: _shown(packs.document_items(_passages(s, d))),
    f"""WITH {ELEMENTS_SQL} SELECT 'document_chunk' AS kind, 'ch_' || key AS source_id, key AS position, concat_ws(',', {_SOURCES}, 'rrf_fusion:' || (key + 2) || ':rrf_fused:yes') AS provenance,
      concat_ws(',', CASE WHEN key % 7 = 0 THEN 'document_metadata_unavailable' END, CASE WHEN key % 2 = 0 THEN 'ocr_derived_passage' END, CASE WHEN key % 4 = 0 THEN 'page_region_unavailable' END, CASE WHEN height > 40 THEN 'passage_truncated' END) AS c0,
      array_to_string(list_sort(string_split(c0, ',')), ',') AS caveats FROM elements""",
)
SQL["N3_document_items"] = f"SELECT * EXCLUDE (c0) FROM ({SQL['N3_document_items']})"


def _paths(s, d):
    """Edges as paths of one hop, some computed and some of these within a tolerance."""
    k = F.length("dst") % 3
    return edges(s, d).select(
        F.lit("tpch").alias("project_id"), F.col("edge_id").alias("path_id"), F.length("src").alias("position"), F.col("predicate").alias("content"), (F.length("src") == 4).alias("truncated"),
        F.array(F.when(k == 0, F.lit("native")).otherwise(F.lit("derived"))).alias("source_kinds"), F.array(F.when(k == 2, F.lit("tolerant")).otherwise(F.lit("exact"))).alias("qualities"),
    )


_add(
    "N3_graph_items",
    lambda s, d: _shown(packs.graph_items(_paths(s, d))),
    f"""WITH {EDGES_SQL} SELECT 'graph_path' AS kind, edge_id AS source_id, length(src) AS position, 'graph_traversal:' || (length(src) + 1) AS provenance,
      concat_ws(',', CASE WHEN length(dst) % 3 > 0 THEN 'graph_derived_relation' END, CASE WHEN length(dst) % 3 = 2 THEN 'graph_tolerant_relation' END, CASE WHEN length(src) = 4 THEN 'truncated_projection' END) AS caveats FROM edges""",
)


def _cited(s, d):
    """Suppliers as answers that cite parts by number, some of which aren't there, some twice."""
    claims = table(s, d, "lineitem").select(F.col("l_suppkey").alias("answer_id"), F.concat(F.lit("E"), F.lpad((F.col("l_partkey") % 60).cast("string"), 3, "0")).alias("reference"))
    k = F.col("p_partkey")
    known = table(s, d, "part").where("p_partkey < 50").select(F.concat(F.lit("E"), F.lpad(k.cast("string"), 3, "0")).alias("reference"), F.when(k % 2 == 0, F.concat(F.lit("doc_"), (k % 8).cast("string"))).alias("document_id"), F.when(k % 3 > 0, k % 3).alias("page_number"), F.when(k % 2 > 0, F.concat(F.lit("gp_"), k.cast("string"))).alias("path_id"), (k % 4).alias("hop_count"))
    return packs.citations(claims, known)


_CITED = """c AS (SELECT DISTINCT l_suppkey AS answer_id, l_partkey % 60 AS k FROM lineitem WHERE l_partkey % 60 IN (SELECT p_partkey FROM part WHERE p_partkey < 50))"""
_add("N20_citations", lambda s, d: _cited(s, d).select("answer_id", "reference", "place"), f"WITH {_CITED} SELECT answer_id, 'E' || lpad(CAST(k AS VARCHAR), 3, '0') AS reference, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY k) AS INTEGER) AS place FROM c")
_add(
    "N20_document_labels",
    lambda s, d: packs.document_labels(_cited(s, d)),
    f"""WITH {_CITED} SELECT answer_id, 'E' || lpad(CAST(min(k) AS VARCHAR), 3, '0') AS reference, '(E' || lpad(CAST(min(k) AS VARCHAR), 3, '0') || ': documento doc_' || (k % 8) || CASE WHEN k % 3 > 0 THEN ', página ' || (k % 3) ELSE '' END || ')' AS label
      FROM c WHERE k % 2 = 0 GROUP BY answer_id, k % 8, k % 3""",
)
_add(
    "N20_path_labels",
    lambda s, d: packs.path_labels(_cited(s, d)),
    f"WITH {_CITED} SELECT answer_id, 'E' || lpad(CAST(k AS VARCHAR), 3, '0') AS reference, '(E' || lpad(CAST(k AS VARCHAR), 3, '0') || ': caminho gp_' || k || ', ' || (k % 4) || CASE k % 4 WHEN 1 THEN ' salto' ELSE ' saltos' END || ')' AS label FROM c WHERE k % 2 > 0",
)


def _links(s, d, shift):
    """Line items as links; ``shift`` moves the spans of some of them."""
    method = F.when(F.col("l_linenumber") % 2 == 0, "exact_name").otherwise("fuzzy_name")
    span = F.concat(F.col("l_linenumber").cast("string"), F.lit("-"), (F.col("l_quantity") + F.when(F.col("l_partkey") % 9 == 0, shift).otherwise(0)).cast("int").cast("string"))
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("element_id"), method.alias("method"), span.alias("spans"))


_LINK = "SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q FROM lineitem"
_add(
    "N24_linking_score",
    lambda s, d: evaluation.linking_score(_links(s, d, 100), _links(s, d, 0).where("case_id % 10 < 8"), ["exact_name", "fuzzy_name", "global_id"]),
    f"""WITH l AS ({_LINK}), t AS (SELECT *, l_orderkey % 10 < 8 AS gold, l_orderkey % 10 < 8 AND l_partkey % 9 <> 0 AS ok, l_linenumber % 2 = 0 AS exact FROM l)
      SELECT round_even(count(*) FILTER (WHERE NOT ok) / count(*), 6) AS false_positive_rate, round_even(count(*) FILTER (WHERE ok) / count(*) FILTER (WHERE gold), 6) AS recall,
        round_even(count(*) FILTER (WHERE ok AND exact) / count(*) FILTER (WHERE exact), 6) AS precision_exact_name, round_even(count(*) FILTER (WHERE ok AND NOT exact) / count(*) FILTER (WHERE NOT exact), 6) AS precision_fuzzy_name, CAST(1.0 AS DOUBLE) AS precision_global_id FROM t""",
)


def _nodes(s, d):
    k = F.col("key")
    return elements(s, d).select("project_id", F.col("element_id").alias("node_id"), F.when(k % 3 == 0, "type").when(k % 3 == 1, "space").otherwise("element").alias("kind"), F.when(k % 2 == 0, F.col("name")).otherwise(F.lit("")).alias("name"), "global_id")


_add(
    "M20_projected_nodes",
    lambda s, d: graph.projected_nodes(_nodes(s, d), "1", "rev_a").select("label", "node_id", "name", "node_instance_id"),
    f"""WITH {ELEMENTS_SQL} SELECT CASE key % 3 WHEN 0 THEN 'ElementType' WHEN 1 THEN 'Space' ELSE 'Element' END AS label, element_id AS node_id, CASE WHEN key % 2 = 0 THEN name END AS name,
      'ni_' || substr(sha256('1:1' || strlen(project_id) || ':' || project_id || strlen(element_id) || ':' || element_id || '5:rev_a'), 1, 32) AS node_instance_id FROM elements""",
)
_add(
    "M20_projected_edges",
    lambda s, d: graph.projected_edges(edges(s, d), "tpch", "1", "rev_a", "rev_b", "native").select("predicate", "edge_id", "source_instance", "instance_id"),
    f"""WITH {EDGES_SQL}, p AS (SELECT predicate, edge_id, 'ni_' || substr(sha256('1:1' || '4:tpch' || strlen(src) || ':' || src || '5:rev_a'), 1, 32) AS a, 'ni_' || substr(sha256('1:1' || '4:tpch' || strlen(dst) || ':' || dst || '5:rev_a'), 1, 32) AS b FROM edges)
      SELECT predicate, edge_id, a AS source_instance, 'ri_' || substr(sha256('1:1' || '4:tpch' || '35:' || edge_id || '6:native' || '5:rev_b' || '35:' || a || '35:' || b || strlen(predicate) || ':' || predicate), 1, 32) AS instance_id FROM p""",
)


def _geometry(s, d):
    """Elements as geometry facts, with faults of each kind among them."""
    k = F.col("key")
    return elements(s, d).where("project_id = 'proj-1'").select(
        F.when(k % 17 == 3, F.lit("gf_same")).otherwise(F.concat(F.lit("gf_"), k.cast("string"))).alias("geometry_id"), F.when(k % 19 == 5, F.lit("el_same")).otherwise(F.col("element_id")).alias("element_id"),
        F.when(k % 13 == 0, F.lit("proj-2")).otherwise(F.col("project_id")).alias("project_id"), F.when(k % 11 == 0, F.lit("v1")).otherwise(F.lit("v2")).alias("geometry_version"), F.when(k % 2 == 1, "valid").alias("status"), F.when(k % 5 > 0, k).alias("x0"),
    )


_add(
    "B17_batch_issues",
    lambda s, d: geometry.batch_issues(_geometry(s, d), "proj-1", "v2").groupBy("issue").agg(F.count("*").alias("n")),
    f"""WITH {ELEMENTS_SQL}, e AS (SELECT key, count(*) FILTER (WHERE key % 17 = 3) OVER () AS g, count(*) FILTER (WHERE key % 19 = 5) OVER () AS l FROM elements WHERE project_id = 'proj-1'),
      i AS (SELECT CASE WHEN key % 13 = 0 THEN 'other_project' WHEN key % 11 = 0 THEN 'other_version' WHEN key % 17 = 3 AND g > 1 THEN 'duplicate_geometry_id' WHEN key % 19 = 5 AND l > 1 THEN 'two_facts_of_one_element' WHEN key % 5 = 0 THEN 'valid_without_bounds' END AS issue FROM e)
      SELECT issue, count(*) AS n FROM i WHERE issue IS NOT NULL GROUP BY issue""",
)


def _stored(s, d, condition, checksum):
    return table(s, d, "part").where(condition).select(F.col("p_partkey").alias("geometry_id"), F.when(F.col("p_partkey") % 6 == 0, "b").otherwise("a").alias("project_id"), checksum.alias("checksum"))


_add(
    "B17_replacement",
    lambda s, d: geometry.replacement(_stored(s, d, "p_partkey % 2 = 0", F.col("p_name")), _stored(s, d, "p_partkey % 3 > 0", F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.col("p_brand"))), "a"),
    """SELECT p_partkey AS geometry_id, CASE WHEN p_partkey % 3 = 0 THEN 'delete' WHEN p_partkey % 2 > 0 THEN 'write' WHEN p_size > 25 THEN 'keep' ELSE 'rewrite' END AS step
      FROM part WHERE p_partkey % 6 <> 0 AND (p_partkey % 2 = 0 OR p_partkey % 3 > 0)""",
)

"""Queries of shortest paths, containment and graph generations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import digests
from plumbline.operators import benchmarks, graph, paths
from plumbline.sources import generations as g

from .views import EDGES_SQL, edges, table

Q: dict = {}
SQL: dict = {}


def _add(name, run, sql=None):
    Q[name] = run
    if sql:
        SQL[name] = sql


# ------------------------------------------------------------------ paths


def _chains(s, d):
    """A dense graph of parts: each line of an order leads to the part of the next line."""
    by_line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")  # numbers repeat
    line = table(s, d, "lineitem").withColumn("after", F.lead("l_partkey").over(by_line)).withColumn("place", F.row_number().over(by_line))
    edge = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("place").cast("string"))
    return line.select(F.lit("CONNECTS_TO").alias("predicate"), F.col("l_partkey").cast("string").alias("src"), F.col("after").cast("string").alias("dst"), edge.alias("edge_id"))


def _asked(s, d):
    """From every twentieth part to the one with a twentieth of its number, and to itself."""
    k = table(s, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("k"))
    return k.select(F.col("k").cast("string").alias("anchor"), F.explode(F.expr("array(string(k div 20), string(k))")).alias("target"))


_CHAINS = """chain0 AS (
  SELECT l_partkey AS src, lead(l_partkey) OVER line AS dst, l_orderkey || '-' || row_number() OVER line AS edge_id
  FROM lineitem WINDOW line AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)
), chain AS (SELECT * FROM chain0 WHERE dst IS NOT NULL),
asked AS (SELECT DISTINCT p_partkey AS anchor, unnest([p_partkey // 20, p_partkey]) AS target FROM part WHERE p_partkey % 20 = 0)"""
#: All walks of each length counted, whether or not they come back to a node: the shortest are paths.
_COUNTED = f"""{_CHAINS}, step AS (SELECT src, dst, count(*) AS n FROM chain GROUP BY src, dst),
w1 AS (SELECT anchor, dst AS node, sum(n) AS n FROM (SELECT DISTINCT anchor FROM asked) JOIN step ON src = anchor GROUP BY ALL),
{', '.join(f"w{k} AS (SELECT anchor, dst AS node, sum(w{k - 1}.n * step.n) AS n FROM w{k - 1} JOIN step ON src = node GROUP BY ALL)" for k in (2, 3, 4))},
w AS ({' UNION ALL '.join(f"SELECT *, {k} AS hops FROM w{k}" for k in (1, 2, 3, 4))})"""
_add(
    "M12_shortest_counts",
    lambda s, d: paths.searched(_chains(s, d), _asked(s, d), 4)[0].select("anchor", "target", "hops", F.col("n_paths").cast("bigint").alias("n_paths")),
    f"""WITH {_COUNTED} SELECT CAST(anchor AS VARCHAR) AS anchor, CAST(target AS VARCHAR) AS target, min(hops) AS hops, CAST(arg_min(n, hops) AS BIGINT) AS n_paths
      FROM asked LEFT JOIN (SELECT anchor, node AS target, hops, n FROM w) USING (anchor, target) GROUP BY anchor, target""",
)
_add(
    "M12_shortest_paths",
    lambda s, d: paths.numbered(paths.shortest_paths(_chains(s, d), _asked(s, d), 3)).where("rank <= 25").select("anchor", "node", "hops", "rank", F.array_join("node_ids", ",").alias("nodes"), F.array_join("edge_ids", ",").alias("edges")),
    f"""WITH {_CHAINS}, w1 AS (SELECT anchor, dst AS node, 1 AS hops, [anchor, dst] AS ns, [edge_id] AS es FROM (SELECT DISTINCT anchor FROM asked) JOIN chain ON src = anchor),
      w2 AS (SELECT anchor, dst AS node, 2 AS hops, list_append(ns, dst) AS ns, list_append(es, edge_id) AS es FROM w1 JOIN chain ON src = node),
      w3 AS (SELECT anchor, dst AS node, 3 AS hops, list_append(ns, dst) AS ns, list_append(es, edge_id) AS es FROM w2 JOIN chain ON src = node JOIN asked USING (anchor) WHERE dst = target),
      w AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3),
      met AS (SELECT w.*, list_transform(ns, lambda x: CAST(x AS VARCHAR)) AS texts, min(hops) OVER (PARTITION BY w.anchor, node) AS least FROM w JOIN asked ON w.anchor = asked.anchor AND node = target),
      k AS (SELECT *, row_number() OVER (PARTITION BY anchor, node ORDER BY hops, es, texts) AS rank FROM met WHERE hops = least)
      SELECT CAST(anchor AS VARCHAR) AS anchor, CAST(node AS VARCHAR) AS node, hops, CAST(rank AS INTEGER) AS rank, array_to_string(texts, ',') AS nodes, array_to_string(es, ',') AS edges FROM k WHERE rank <= 25""",
)


def _places(s, d):
    """Whether each order lies in its customer's nation, and in the one after."""
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    nation = F.explode(F.expr("array('n' || c_nationkey, 'n' || (c_nationkey + 1) % 25)"))
    return o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("target"), nation.alias("anchor"))


_add(
    "M12_containment_check",
    lambda s, d: paths.containment(edges(s, d), _places(s, d)),
    """SELECT 'n' || n AS anchor, 'o' || o_orderkey AS target, n = c_nationkey AS contained, CASE WHEN n = c_nationkey THEN 2 END AS hops
      FROM (SELECT o_orderkey, c_nationkey, unnest([c_nationkey, (c_nationkey + 1) % 25]) AS n FROM orders JOIN customer ON o_custkey = c_custkey)""",
)

# ------------------------------------------------------------------ generations

_R = g.Revisions("tpch", "nodes-1", "native-1", "derived-1", "bundle-1")


def _graph(s, d):
    """Regions to orders as nodes, their containment as native edges, customers at nations as derived ones."""
    native = edges(s, d)
    node = native.select("dst").union(native.where("predicate = 'HAS_SITE'").select("src").distinct()).toDF("node_id")
    kind = F.expr("get(array('project', 'site', 'building', 'storey'), locate(left(node_id, 1), 'rnco') - 1)")
    c = table(s, d, "customer")
    derived = c.select(F.lit("TOUCHES").alias("predicate"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"), F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("edge_id"))
    return node.select("node_id", kind.alias("kind"), F.col("node_id").alias("name")), native, derived


def _damaged(nodes, native, derived):
    """Records with every kind of fault, by the number in their id modulo 97."""
    k = lambda c: F.regexp_extract(c, r"(\d+)", 1).cast("bigint") % 97
    put = lambda df, n, c, v: df.withColumn(c, F.when(F.col("k") == n, v).otherwise(F.col(c)))
    nodes = nodes.withColumn("k", k("node_id")).where("NOT (k = 3 AND node_id LIKE 'o%')")
    nodes = _twice(nodes, 5)
    for n, c, v in ((7, "kind", "space"), (11, "label", "Zone"), (13, "project_id", "other"), (17, "node_instance_id", "")):
        nodes = put(nodes, n, c, F.lit(v))
    return nodes.drop("k"), _edges_damaged(native, put), derived.withColumn("k", k("edge_id")).where("k <> 53").withColumn("target_revision", F.when(F.col("k") != 59, F.col("target_revision"))).drop("k")


def _twice(records, k: int):
    """Records in one reading, those of number ``k`` twice."""
    return records.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("k") == k, 2).otherwise(1)))).drop("copy")


def _edges_damaged(native, put):
    native = _twice(native.where("k <> 31"), 37)
    for n, c, v in ((23, "predicate", F.lit("CONTAINS")), (29, "source_revision", F.lit("old")), (41, "instance_id", F.concat(F.lit("x"), F.col("instance_id"))), (43, "source_kind", F.lit(g.DERIVED)), (47, "target_instance", F.lit("ni_nowhere"))):
        native = put(native, n, c, v)
    return native.drop("k")


def _checked(s, d, damage: bool):
    nodes, native, derived = _graph(s, d)
    want = (g.node_records(nodes, _R), g.edge_records(native, _R, g.NATIVE), g.edge_records(derived, _R, g.DERIVED))
    if not damage:
        return g.verification(want, want, _R)
    number = native.select("edge_id", (F.regexp_extract("dst", r"(\d+)", 1).cast("bigint") % 97).alias("k"))
    return g.verification(_damaged(want[0], want[1].join(number, "edge_id"), want[2]), want, _R)


_NUMBERS = """n AS (
  SELECT 'r' AS t, r_regionkey % 97 AS k FROM region UNION ALL SELECT 'n', n_nationkey % 97 FROM nation UNION ALL SELECT 'c', c_custkey % 97 FROM customer UNION ALL SELECT 'o', o_orderkey % 97 FROM orders
), e AS (SELECT k FROM n WHERE t <> 'r'), dd AS (SELECT k FROM n WHERE t = 'c'),
x AS (SELECT count(*) FILTER (WHERE k = 3 AND t = 'o') AS lost, count(*) FILTER (WHERE k = 5) AS twice, count(*) FILTER (WHERE k = 7) AS kinds, count(*) FILTER (WHERE k = 11) AS labels, count(*) FILTER (WHERE k = 13) AS foreign_, count(*) FILTER (WHERE k = 17) AS bare FROM n),
y AS (SELECT count(*) FILTER (WHERE k = 31) AS e_lost, count(*) FILTER (WHERE k = 37) AS e_twice, count(*) FILTER (WHERE k = 23) AS types, count(*) FILTER (WHERE k = 29) AS old, count(*) FILTER (WHERE k = 41) AS extra, count(*) FILTER (WHERE k = 43) AS owners, count(*) FILTER (WHERE k = 47) AS astray FROM e),
z AS (SELECT count(*) FILTER (WHERE k = 53) AS d_lost, count(*) FILTER (WHERE k = 59) AS d_old FROM dd),
c AS (SELECT unnest([
  {'name': 'node_count_exact', 'violations': abs(twice - lost)}, {'name': 'node_id_set_exact', 'violations': twice + lost}, {'name': 'node_occurrence_set_exact', 'violations': twice + lost + bare + (bare > 0)::INT},
  {'name': 'node_fingerprint_exact', 'violations': (twice + lost > 0)::INT}, {'name': 'node_labels_exact', 'violations': labels}, {'name': 'node_kind_exact', 'violations': kinds}, {'name': 'node_properties_exact', 'violations': bare},
  {'name': 'no_foreign_project', 'violations': foreign_}, {'name': 'no_duplicate_node_id', 'violations': twice}, {'name': 'endpoint_occurrences_exist', 'violations': lost + bare + (astray > 0)::INT},
  {'name': 'native_count_exact', 'violations': abs(e_twice - e_lost)}, {'name': 'native_id_set_exact', 'violations': e_twice + e_lost}, {'name': 'native_occurrence_set_exact', 'violations': e_twice + e_lost + 2 * extra},
  {'name': 'native_fingerprint_exact', 'violations': (e_twice + e_lost > 0)::INT}, {'name': 'native_provenance_exact', 'violations': owners}, {'name': 'native_no_extra_occurrence', 'violations': extra},
  {'name': 'relationship_types_exact', 'violations': types}, {'name': 'endpoint_generation_exact', 'violations': old + d_old}, {'name': 'no_duplicate_edge_id', 'violations': e_twice},
  {'name': 'derived_count_exact', 'violations': d_lost}, {'name': 'derived_id_set_exact', 'violations': d_lost}, {'name': 'derived_occurrence_set_exact', 'violations': d_lost}, {'name': 'derived_fingerprint_exact', 'violations': (d_lost > 0)::INT},
  {'name': 'derived_provenance_exact', 'violations': d_old}, {'name': 'derived_no_extra_occurrence', 'violations': 0}]) AS c FROM x, y, z)"""
_add("B18_generation_checks", lambda s, d: _checked(s, d, True), f"WITH {_NUMBERS} SELECT c.name AS name, CAST(c.violations AS BIGINT) AS violations, c.violations = 0 AS passed FROM c")
_add("B18_generation_sound", lambda s, d: _checked(s, d, False).agg(F.count("*").alias("checks"), F.sum(F.col("passed").cast("int")).alias("passed"), F.sum("violations").alias("violations")), f"WITH {EDGES_SQL} SELECT CAST(25 AS BIGINT) AS checks, CAST(25 AS BIGINT) AS passed, CAST((SELECT count(*) - count(DISTINCT edge_id) FROM edges) AS BIGINT) AS violations")


def _orders_by_priority(s, d, version: int):
    """Orders by priority, in the second version with some totals changed and one priority gone."""
    o = table(s, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return o if version == 1 else o.withColumn("o_totalprice", F.when((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderkey") % 1000 == 7), 0.0).otherwise(F.col("o_totalprice"))).where("o_orderpriority <> '5-LOW'")


_add(
    "M8_changed_partitions",
    lambda s, d: digests.changed(*(digests.digest(_orders_by_priority(s, d, v).repartition(3 + v), by=["o_orderpriority"]) for v in (1, 2)), ["o_orderpriority"]),
    "SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority = '5-LOW' OR (o_orderpriority = '2-HIGH' AND o_orderkey % 1000 = 7 AND o_totalprice <> 0)",
)


# ------------------------------------------------------------------ benchmarks


def _judged(s, d):
    """Lines at three tolerances: their discount says whether a relation is expected, and every seventh is found a little too late."""
    line = table(s, d, "lineitem").select(F.col("l_returnflag").alias("predicate"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("pair"), (F.col("l_discount") * 100).cast("int").alias("x"), F.col("l_linenumber").alias("n"))
    at = line.withColumn("tolerance", F.explode(F.array(F.lit(0), F.lit(2), F.lit(4))))
    gold = at.select("predicate", "tolerance", "pair", (F.col("x") <= F.col("tolerance")).alias("expected"))
    return gold, at.where(F.col("x") <= F.col("tolerance") - F.when(F.col("n") % 7 == 0, 1).otherwise(0)).select("predicate", "tolerance", "pair")


_add(
    "N23_tolerance_metrics",
    lambda s, d: benchmarks.tolerance_metrics(*_judged(s, d), ["pair"]),
    """WITH l AS (SELECT l_returnflag AS predicate, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pair, max(CAST(trunc(l_discount * 100) AS INTEGER)) AS hi, min(CAST(trunc(l_discount * 100) AS INTEGER)) AS x, l_linenumber % 7 = 0 AS late FROM lineitem GROUP BY ALL),
      g AS (SELECT predicate, t, x, x <= t AS e, x <= t - late::INT AS p, x > 0 AND x <= 4 AS b FROM l, unnest([0, 2, 4]) AS s(t)),
      n AS (SELECT predicate, t AS tolerance, count(*) AS support, count(*) FILTER (WHERE e AND p) AS tp, count(*) FILTER (WHERE NOT e AND p) AS fp, count(*) FILTER (WHERE e AND NOT p) AS fn, count(*) FILTER (WHERE NOT e AND NOT p) AS tn, count(*) FILTER (WHERE b) AS boundary, count(*) FILTER (WHERE b AND e = p) AS hits FROM g GROUP BY ALL),
      r AS (SELECT *, CASE WHEN tp + fp > 0 THEN round_even(tp / (tp + fp), 6) ELSE 1.0 END AS precision, CASE WHEN tp + fn > 0 THEN round_even(tp / (tp + fn), 6) ELSE 1.0 END AS recall FROM n)
      SELECT predicate, tolerance, support, tp, fp, fn, tn, precision, recall, CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN precision + recall = 0 THEN 0.0 ELSE round_even(2 * precision * recall / (precision + recall), 6) END AS f1,
        round_even((tp + tn) / support, 6) AS accuracy, boundary, CASE WHEN boundary > 0 THEN round_even(hits / boundary, 6) ELSE 1.0 END AS boundary_accuracy FROM r""",
)


def _extracted(s, d):
    """Customers as expected records; what was extracted lacks some, has others, and takes some for another segment."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").alias("place"))
    got = c.where("id % 13 <> 0").withColumn("kind", F.when(F.col("id") % 17 == 0, "?").otherwise(F.col("kind")))
    return c, got.unionByName(c.where("id % 19 = 0").withColumn("id", -F.col("id") - 1)).unionByName(got.where("id % 23 = 0"))


_add(
    "N22_exact_sets",
    lambda s, d: benchmarks.exact_sets(*_extracted(s, d), "id", ["kind", "place"]),
    """WITH n AS (SELECT count(*) AS expected, count(*) FILTER (WHERE c_custkey % 13 <> 0) AS matched, count(*) FILTER (WHERE c_custkey % 19 = 0) AS invented, count(*) FILTER (WHERE c_custkey % 13 = 0) AS lost, count(*) FILTER (WHERE c_custkey % 23 = 0 AND c_custkey % 13 <> 0) AS repeated,
        count(*) FILTER (WHERE c_custkey % 13 <> 0 AND c_custkey % 17 <> 0) AS kinds FROM customer)
      SELECT expected, matched + invented AS produced, matched, lost, invented, CAST(repeated AS BIGINT) AS repeated, round_even(matched / (matched + invented), 6) AS precision, round_even(matched / expected, 6) AS recall, round_even(kinds / matched, 6) AS kind_accuracy, 1.0 AS place_accuracy FROM n""",
)
_add(
    "N22_determinism",
    lambda s, d: benchmarks.determinism(
        {
            "cold": graph.walks(edges(s, d), _roots(s, d), 3), "warm": graph.walks(edges(s, d), _roots(s, d), 3), "reversed": graph.walks(edges(s, d).repartition(7, "dst").sortWithinPartitions(F.desc("edge_id")), _roots(s, d), 3),
            "other": graph.walks(edges(s, d).where("src <> 'r1'"), _roots(s, d), 3),
        }
    ).select("run", "n", "same"),
    f"""WITH {EDGES_SQL}, w AS (SELECT a.src AS r, count(DISTINCT a.edge_id) + count(DISTINCT b.edge_id) + count(DISTINCT c.edge_id) AS n FROM edges AS a LEFT JOIN edges AS b ON b.src = a.dst LEFT JOIN edges AS c ON c.src = b.dst WHERE a.src LIKE 'r%' GROUP BY a.src)
      SELECT unnest(['cold', 'warm', 'reversed', 'other']) AS run, unnest([sum(n), sum(n), sum(n), sum(n) FILTER (WHERE r <> 'r1')])::BIGINT AS n, unnest([true, true, true, false]) AS same FROM w""",
)


def _roots(s, d):
    return edges(s, d).where("predicate = 'HAS_SITE'").select(F.col("src").alias("node")).distinct()

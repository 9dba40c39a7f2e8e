"""Property graph: walks, paths, revisions, assembly and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import ids

MAX_DEPTH = 6
# Predicates by what they are about.
SPATIAL = ["HAS_SITE", "HAS_BUILDING", "HAS_STOREY", "HAS_SPACE", "CONTAINS", "AGGREGATES"]
ATTRIBUTE = ["HAS_TYPE", "HAS_MATERIAL", "MEMBER_OF_GROUP", "MEMBER_OF_SYSTEM"]
DERIVED = ["CONTAINS_GEOM", "INTERSECTS", "TOUCHES", "ABOVE"]
NATIVE = ["NESTS", "VOIDS", "FILLS", "BOUNDS_SPACE", "CONNECTS_TO", "HAS_PORT", "CONNECTS_PORT"]
KINDS = ["project", "site", "building", "storey", "space", "element", "type", "material", "group", "system", "port"]
_ANY, _PLACE, _BODY = ",".join(KINDS), "site,building,storey,space", "element,space"
# Source class, predicate, kinds of its ends, multiplicity.
NATIVE_RULES = [
    ("IfcRelAggregates", "HAS_SITE", "project", "site", "1:N"),
    ("IfcRelAggregates", "HAS_BUILDING", "site", "building", "1:N"),
    ("IfcRelAggregates", "HAS_STOREY", "building", "storey", "1:N"),
    ("IfcRelAggregates", "HAS_SPACE", "storey", "space", "1:N"),
    ("IfcRelAggregates", "AGGREGATES", _ANY, _ANY, "1:N"),
    ("IfcRelContainedInSpatialStructure", "CONTAINS", _PLACE, "element", "1:N"),
    ("IfcRelNests", "NESTS", "element", "element,port", "1:N"),
    ("IfcRelDefinesByType", "HAS_TYPE", _BODY, "type", "N:1"),
    ("IfcRelAssociatesMaterial", "HAS_MATERIAL", _BODY, "material", "N:M"),
    ("IfcRelVoidsElement", "VOIDS", "element", "element", "1:1"),
    ("IfcRelFillsElement", "FILLS", "element", "element", "1:1"),
    ("IfcRelSpaceBoundary", "BOUNDS_SPACE", "element", "space", "N:M"),
    ("IfcRelAssignsToGroup", "MEMBER_OF_GROUP", _ANY, "group", "N:M"),
    ("IfcRelAssignsToGroup", "MEMBER_OF_SYSTEM", _ANY, "system", "N:M"),
    ("IfcRelConnectsElements", "CONNECTS_TO", "element", "element", "N:M"),
    ("IfcRelConnectsPortToElement", "HAS_PORT", "element", "port", "1:N"),
    ("IfcRelConnectsPorts", "CONNECTS_PORT", "port", "port", "N:M"),
]
INTENTS = {
    "neighbors": SPATIAL + ATTRIBUTE + DERIVED + NATIVE, "attribute": ATTRIBUTE, "native_connections": NATIVE, "derived_neighborhood": DERIVED, "relation_exists": SPATIAL + ATTRIBUTE + DERIVED + NATIVE,
    "ancestors": SPATIAL, "descendants": SPATIAL, "shortest_path": SPATIAL + NATIVE, "containment_check": SPATIAL,
}
#: Ranged intents and the one direction each is registered for.
RANGED = {"ancestors": "reverse", "descendants": "forward", "shortest_path": "forward", "containment_check": "forward"}


def validated(intent: str, predicates: list[str] | None, direction: str, depth: int) -> list[str]:
    """The predicates of a request, or ValueError if it isn't allowed."""
    allowed = INTENTS[intent]
    chosen = predicates or allowed
    if any(p not in allowed for p in chosen):
        raise ValueError("predicate not allowed for this intent")
    if intent == "relation_exists" and len(chosen) != 1:
        raise ValueError("relation_exists takes one predicate")
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError("depth out of range")
    if intent in RANGED and RANGED[intent] != direction:
        raise ValueError(f"{intent} goes {RANGED[intent]} only")
    return chosen


def one_hop(edges: DataFrame, anchors: DataFrame, direction: str = "forward") -> DataFrame:
    """Edges at the anchors (node): (anchor, other, predicate, edge_id)."""
    near, far = ("src", "dst") if direction == "forward" else ("dst", "src")
    return edges.join(anchors, edges[near] == anchors["node"]).select(F.col("node").alias("anchor"), F.col(far).alias("other"), "predicate", "edge_id")


def walks(edges: DataFrame, anchors: DataFrame, depth: int, direction: str = "forward") -> DataFrame:
    """All walks of 1 to ``depth`` hops from the anchors that use no edge twice.

    (anchor, node, hops, node_ids, edge_ids). A join for each hop; the frontier is
    joined to the edges on the node, so both are dealt by node.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError("depth out of range")
    near, far = ("src", "dst") if direction == "forward" else ("dst", "src")
    step = edges.select(F.col(near).alias("node"), F.col(far).alias("next"), "edge_id")
    front = anchors.select(F.col("node").alias("anchor"), "node", F.lit(0).alias("hops"), F.array("node").alias("node_ids"), F.array().cast("array<string>").alias("edge_ids"))
    out = None
    for _ in range(depth):
        front = front.join(step, "node").where(~F.array_contains("edge_ids", F.col("edge_id")))
        front = front.select("anchor", F.col("next").alias("node"), (F.col("hops") + 1).alias("hops"), F.concat("node_ids", F.array("next")).alias("node_ids"), F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"))
        out = front if out is None else out.unionByName(front)
    return out


def ranked_paths(paths: DataFrame, limit: int = 50, max_paths: int = 25) -> DataFrame:
    """Paths in their total order: the row limit comes first, then equal paths are
    made one, then the number of paths is limited; truncation is told."""
    order = Window.partitionBy("anchor").orderBy("hops", "edge_ids", "node_ids")
    cut = paths.withColumn("row", F.row_number().over(order)).where(F.col("row") <= limit + 1)
    over = F.max("row").over(Window.partitionBy("anchor")) > limit
    cut = cut.withColumn("more", over).where(F.col("row") <= limit)
    one = cut.withColumn("path_id", ids.path_id(F.col("node_ids"), F.col("edge_ids"))).groupBy("anchor", "path_id").agg(*(F.first(c).alias(c) for c in ("node", "hops", "node_ids", "edge_ids", "more")))
    out = one.withColumn("rank", F.row_number().over(order))
    many = F.max("rank").over(Window.partitionBy("anchor")) > max_paths
    return out.withColumn("truncated", F.col("more") | many).drop("more").where(F.col("rank") <= max_paths)


def active(rows: DataFrame, pointers: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the published generation of each project."""
    return rows.join(pointers, keys, "left_semi")


def anchor(nodes: DataFrame, text: str) -> DataFrame:
    """The node that a reference names: by node id, then element key, then GlobalId;
    ``ambiguous`` if the first of these that matches has several."""
    tier = F.when(F.col("node_id") == text, 1).when(F.col("element_key") == text, 2).when(F.col("global_id") == text, 3)
    first = nodes.select("node_id", tier.alias("tier")).where("tier IS NOT NULL").orderBy("tier", "node_id").limit(11)  # of the best tier, if there are as many
    best = F.array_sort(F.collect_list(F.struct("tier", "node_id")))
    ids = F.transform(F.filter(best, lambda r: r["tier"] == best[0]["tier"]), lambda r: r["node_id"])
    return first.agg(ids.alias("ids")).select(F.slice("ids", 1, 10).alias("ids"), (F.size("ids") > 1).alias("ambiguous"))


def node_kind(ifc_class: Column) -> Column:
    """Kind of a node by its class; systems before groups. Fixed values."""
    table = {"IfcProject": "project", "IfcSite": "site", "IfcBuilding": "building", "IfcBuildingStorey": "storey", "IfcSpace": "space", "IfcDistributionPort": "port", "IfcSystem": "system", "IfcGroup": "group", "IfcMaterial": "material"}
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, kind in table.items():
        out = out.when(ifc_class == name, kind)
    return out.when(ifc_class.endswith("Type"), "type").otherwise("element")


def assembled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends are not both among the nodes: an empty result means sound."""
    missing = edges.join(nodes.select(F.col("node_id").alias("src")), "src", "left_anti").select("edge_id", F.lit("src").alias("side"))
    return missing.unionByName(edges.join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_anti").select("edge_id", F.lit("dst").alias("side")))


def stale(stored: DataFrame, complete: DataFrame, key: str, is_complete: bool = True) -> DataFrame:
    """Ids to delete; a partial generation never drives deletes."""
    return stored.join(complete, key, "left_anti").select(key) if is_complete else stored.select(key).limit(0)


def ancestors(parents: DataFrame, start: DataFrame, depth: int = 4) -> DataFrame:
    """Chain from each element up (child, parent), with a guard against cycles."""
    front = start.select(F.col("node").alias("element"), "node", F.array("node").alias("seen"), F.lit(0).alias("level"))
    out = None
    for _ in range(depth):
        front = front.join(parents, front["node"] == parents["child"]).where(~F.array_contains("seen", F.col("parent")))
        front = front.select("element", F.col("parent").alias("node"), F.concat("seen", F.array("parent")).alias("seen"), (F.col("level") + 1).alias("level"))
        out = front if out is None else out.unionByName(front)
    return out.select("element", "node", "level")


def verified_rows(rows: DataFrame, project: str, schema: str, generation: str, predicates: list[str]) -> DataFrame:
    """Rows that break a rule of the active view, with the first rule they break."""
    reason = F.when(F.col("project_id") != project, "project").when(F.col("schema") != schema, "schema").when(F.col("generation") != generation, "generation").when(~F.col("predicate").isin(predicates), "predicate")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL")


#: Tasks that relations are dealt to.
TASKS = 192


def native_edges(relations: DataFrame, nodes: DataFrame, project: str) -> DataFrame:
    """Edges of source relations (relation_class, global_id, src, dst, occurrence), each
    with its id or with the first thing that is wrong with it.

    nodes: node_id, kind. Of the rules of a class the first that fits both kinds
    counts, so aggregation between unlike places has its own predicates. Repeated rows
    count once; rows without an end are dealt over the tasks like others.
    """
    spark = relations.sparkSession
    rules: dict[str, list[tuple]] = {}
    for r in NATIVE_RULES:
        rules.setdefault(r[0], []).append((r[1], r[2].split(","), r[3].split(",")))
    table = spark.createDataFrame([*rules.items()], "relation_class string, rules array<struct<predicate:string,src_kinds:array<string>,dst_kinds:array<string>>>")
    ends = relations.repartition(TASKS, *relations.columns).distinct()
    known = nodes.select("node_id", "kind").distinct()
    for side in ("src", "dst"):
        ends = ends.withColumn("_none", F.when(F.col(side).isNull(), F.xxhash64(*relations.columns)).otherwise(0)).repartition(TASKS, side, "_none")
        ends = ends.join(known.select(F.col("node_id").alias(side), F.lit(0).cast("bigint").alias("_none"), F.col("kind").alias(f"{side}_kind"), F.lit(True).alias(f"{side}_known")), [side, "_none"], "left").drop("_none")
    matched = ends.join(F.broadcast(table), "relation_class", "left")
    fits = lambda r: F.array_contains(r["src_kinds"], F.col("src_kind")) & F.array_contains(r["dst_kinds"], F.col("dst_kind"))
    best = matched.withColumn("predicate", F.try_element_at(F.filter("rules", fits), F.lit(1))["predicate"])
    issue = (
        F.when(F.col("global_id").isNull(), "RELATION_WITHOUT_GLOBAL_ID")
        .when(F.col("src").isNull() | F.col("dst").isNull(), "MISSING_ENDPOINT")
        .when(F.col("src_known").isNull() | F.col("dst_known").isNull(), "UNKNOWN_ENDPOINT")
        .when(F.col("src") == F.col("dst"), "DUPLICATE_ENDPOINT_IN_RELATION")
        .when(F.col("rules").isNull(), "UNSUPPORTED_RELATION_SUBTYPE")
        .when(F.col("predicate").isNull(), "ENDPOINT_KIND_MISMATCH")
    )
    edge = ids.identity("native_edge", "1", project, F.col("predicate"), F.col("src"), F.col("dst"), F.col("global_id"), F.col("occurrence").cast("string"))
    return best.withColumn("issue", issue).withColumn("edge_id", F.when(F.col("issue").isNull(), edge)).select("relation_class", "global_id", "src", "dst", "predicate", "issue", "edge_id")


#: The label that nodes of a kind are stored under; relations are stored under their predicate. Fixed values.
LABELS = {"project": "Project", "site": "Site", "building": "Building", "storey": "Storey", "space": "Space", "element": "Element", "type": "ElementType", "material": "Material", "group": "Group", "system": "System", "port": "Port"}
OPTIONAL = ["ifc_class", "global_id", "natural_key", "name"]


def projected_nodes(nodes: DataFrame, schema: str, revision: str, optional: list[str] = OPTIONAL) -> DataFrame:
    """Records of nodes (project_id, node_id, kind) in one generation, to be written
    partitioned by label. An optional value is there or it isn't: never an empty
    text. A kind without a label, or a required value that is missing, is an error."""
    names = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    label = F.coalesce(F.try_element_at(names, F.col("kind")), F.raise_error(F.concat(F.lit("no label for kind "), F.coalesce("kind", F.lit("null")))).cast("string"))
    whole = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(F.raise_error(F.lit(f"a node without {c}")).cast("string")).alias(c)
    kept = [F.nullif(F.col(c), F.lit("")).alias(c) for c in optional if c in nodes.columns]
    instance = ids.node_instance(schema, F.col("project_id"), F.col("node_id"), F.lit(revision))
    return nodes.select(label.alias("label"), whole("project_id"), whole("node_id"), "kind", *kept, F.lit(revision).alias("node_revision_id"), instance.alias("node_instance_id"))


def projected_edges(edges: DataFrame, project: str, schema: str, node_revision: str, revision: str, source: str) -> DataFrame:
    """Records of edges in one generation, between records of nodes; to be written partitioned by predicate."""
    known = F.when(F.col("predicate").isin(SPATIAL + ATTRIBUTE + DERIVED + NATIVE), F.col("predicate")).otherwise(F.raise_error(F.concat(F.lit("no such predicate: "), F.coalesce("predicate", F.lit("null")))).cast("string"))
    end = lambda c: ids.node_instance(schema, F.lit(project), F.col(c), F.lit(node_revision))
    out = edges.select(known.alias("predicate"), "edge_id", end("src").alias("source_instance"), end("dst").alias("target_instance"), F.lit(revision).alias("revision_id"))
    own = ids.relationship_instance(schema, F.lit(project), F.col("edge_id"), F.lit(source), F.lit(revision), F.col("source_instance"), F.col("target_instance"), F.col("predicate"))
    return out.withColumn("instance_id", own)


def occurrence_fingerprint(records: DataFrame, instance: str, group: str, buckets: int = 4096) -> DataFrame:
    """(group, n, fingerprint): the same for equal sets of records, whatever their order.

    Records are hashed one by one and put in order within buckets of their hashes, of
    which there are so many that none is large; the digests of buckets are put in
    order in turn. The number of buckets is part of the fingerprint.
    """
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(records.columns) if c not in (group, instance)]
    one = records.select(group, F.sha2(ids.framed(F.col(instance), *rest).cast("binary"), 256).alias("h")).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    parts = one.groupBy(group, "bucket").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "").cast("binary"), 256).alias("d"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"]), "")
    return parts.groupBy(group).agg(F.sum("n").alias("n"), F.sha2(ordered.cast("binary"), 256).alias("fingerprint"))

"""Deterministic identities as Column builders (128 bits of SHA-256 over framed parts)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix of each kind of id. Fixed values.
PREFIXES = {
    "element": "el_", "property_fact": "pf_", "classification": "cf_", "document": "doc_", "revision": "rev_", "chunk": "ch_",
    "linked_chunk": "chl_", "link_revision": "lrev_", "node": "gn_", "native_edge": "ge_", "derived_edge": "gd_", "geometry": "gf_",
    "native_revision": "nr_", "derived_revision": "dr_", "bundle": "rb_", "path": "gp_", "node_instance": "ni_", "relationship_instance": "ri_",
}


def _text(part: Column | str) -> Column:
    return (part if isinstance(part, Column) else F.lit(part)).cast("string")


def framed(*parts: Column | str) -> Column:
    """Each part as its UTF-8 byte length, a colon and itself; null if any part is null."""
    return F.concat(*(F.concat(F.octet_length(_text(p)).cast("string"), F.lit(":"), _text(p)) for p in parts))


def framed_with_commas(*parts: Column | str) -> Column:
    """The framing of path ids: as ``framed``, with a comma after every part."""
    return F.concat(*(F.concat(F.octet_length(_text(p)).cast("string"), F.lit(":"), _text(p), F.lit(",")) for p in parts))


def digest(framing: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(framing.cast("binary"), 256), 1, 32))


def identity(kind: str, *parts: Column | str) -> Column:
    """The id of a record: its kind's prefix and 32 hex digits."""
    return digest(framed(*parts), PREFIXES[kind])


def element_id(project: Column, global_id: Column) -> Column:
    return identity("element", project, global_id)


def fact_id(project: Column, element: Column, source: Column, container: Column, name: Column, occurrence: Column) -> Column:
    """The value takes no part in the id of a fact."""
    return identity("property_fact", project, element, source, container, name, occurrence)


def classification_id(project: Column, element: Column, system: Column, code: Column) -> Column:
    return identity("classification", project, element, system, code, "0")


def path_id(node_ids: Column, edge_ids: Column) -> Column:
    """Id of a path, from the arrays of its node and edge ids."""
    part = lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x, F.lit(","))
    return digest(F.concat(F.array_join(F.transform(node_ids, part), ""), F.array_join(F.transform(edge_ids, part), "")), PREFIXES["path"])


def set_fingerprint(ids: Column) -> Column:
    """An aggregate: the same for equal sets of ids, whatever their order or repeats."""
    ordered = F.sort_array(F.collect_set(ids))
    return F.sha2(F.array_join(F.transform(ordered, lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)), "").cast("binary"), 256)


def material_key(name: Column, description: Column, category: Column) -> Column:
    """Content key of a material; null if all of it is empty."""
    blank = (F.coalesce(name, F.lit("")) == "") & (F.coalesce(description, F.lit("")) == "") & (F.coalesce(category, F.lit("")) == "")
    return F.when(~blank, digest(framed(*(F.coalesce(c, F.lit("")) for c in (name, description, category)))))


def symmetric_edge_id(project: Column, predicate: Column, a: Column, b: Column, tolerance: str, symmetric: Column) -> Column:
    """Id of a derived edge; the ends of a symmetric one are put in order first."""
    low, high = F.when(symmetric, F.least(a, b)).otherwise(a), F.when(symmetric, F.greatest(a, b)).otherwise(b)
    return identity("derived_edge", "1", project, predicate, low, high, F.when(symmetric, "0").otherwise("1"), "aabb", "1", "1", tolerance)


def native_revision(project: Column, source: Column, source_sha256: Column, schema: Column, versions: list[str]) -> Column:
    """One generation of native relations; versions: of the schema, the producer and the two policies."""
    return identity("native_revision", project, source, source_sha256, schema, *versions)


def derived_revision(project: Column, generation: Column, fingerprint: Column, geometry: list[str], algorithm: list[str], tolerance: str) -> Column:
    """One generation of derived relations; geometry: versions of its schema and
    producer; algorithm: relation schema, algorithm, its version, broad phase, its
    version and the policy."""
    return identity("derived_revision", project, generation, fingerprint, *geometry, *algorithm, tolerance)


def node_instance(schema: str, project: Column, node: Column, revision: Column) -> Column:
    """One record of a node in one generation, so that generations can stand side by side."""
    return identity("node_instance", schema, project, node, revision)


def relationship_instance(schema: str, project: Column, edge: Column, kind: Column, revision: Column, source: Column, target: Column, predicate: Column) -> Column:
    """One record of a relation between two node instances."""
    return identity("relationship_instance", schema, project, edge, kind, revision, source, target, predicate)

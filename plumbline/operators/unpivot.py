"""Property facts from nested values: a recursive unpivot of VARIANT.

Occurrences (project_id, element_id, origin, source, container, property_name, value)
hold a value of one of eight kinds: single, quantity, enumerated, list, bounded, table,
reference, complex. Each level of nesting is one more explode in a single pass over the
source. What isn't turned into facts has a
diagnostic of its own; nothing is dropped silently and nothing raises.

A scalar is a JSON value; one that isn't finite, which JSON can't say, is
{"float": "NaN" | "Infinity" | "-Infinity"}.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import ids, text
from plumbline.sources.work import Work

MAX_DEPTH, MAX_ITEMS, MAX_FACTS = 8, 4096, 10_000
KEYS = ["project_id", "element_id", "origin", "source", "container", "property_name"]
SLOT = ["project_id", "element_id", "source", "container", "property_name"]
#: Codes that drop the whole property; the others tell of something within it.
HARD = ["INCOMPATIBLE_UNIT", "NON_FINITE_VALUE", "LIST_LIMIT_EXCEEDED", "TABLE_LIMIT_EXCEEDED", "DEPTH_LIMIT_EXCEEDED", "INTEGER_OUT_OF_RANGE"]
_LEAVES = "array<struct<leaf:string,value:variant,unit:string>>"


def _at(v: str, path: str, kind: str) -> Column:
    return F.expr(f"try_variant_get({v}, '$.{path}', '{kind}')")


def _number(i: Column) -> Column:
    return F.lpad(i.cast("string"), 6, "0")


def key_of(path: Column, leaf: Column) -> Column:
    """The occurrence key of a leaf under the names of a path (array; empty at the top)."""
    names = F.array_join(F.transform(path, lambda s: F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)), "")
    return F.when(F.size(path) == 0, leaf).otherwise(F.concat(F.lit("child:"), _number(F.size(path)), F.lit(":"), names, F.lit(":"), leaf))


def _segments(rest: Column) -> Column:
    """struct(path, rest) after reading as many names as there are, byte by byte."""
    start = F.struct(F.array().cast("array<string>").alias("path"), rest.alias("rest"))

    def read(acc: Column, _: Column) -> Column:
        digits = F.substring_index(acc["rest"], ":", 1)
        size = F.when(F.regexp_like(digits, F.lit(r"^\d+$")), digits.try_cast("int"))
        tail = F.substring(F.encode(acc["rest"], "UTF-8"), F.octet_length(digits) + 2, F.lit(2**31 - 1))
        name = F.substring(tail, F.lit(1), size)
        good = F.octet_length(name) == size
        return F.struct(
            F.when(good, F.concat(acc["path"], F.array(F.decode(name, "UTF-8")))).alias("path"), F.when(good, F.decode(F.substring(tail, size + 1, F.lit(2**31 - 1)), "UTF-8")).alias("rest")
        )

    return start, read


def parsed_key(key: Column) -> Column:
    """struct(path, leaf) of an occurrence key, the inverse of key_of; null for what none is."""
    nested = key.startswith("child:")
    count = F.when(F.regexp_like(key, F.lit(r"(?s)^child:\d{6}:.*")), F.substring(key, 7, 6).cast("int"))
    start, read = _segments(F.substring(key, F.lit(14), F.lit(2**31 - 1)))
    steps = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    found = F.aggregate(steps, start, read)
    leaf = F.when(nested, F.when((count > 0) & found["rest"].startswith(":"), F.substring(found["rest"], F.lit(2), F.lit(2**31 - 1)))).otherwise(key)
    sound = F.regexp_like(leaf, F.lit(r"^(0|lower|upper|setpoint|item:\d{6}|row:\d{6}:(defining|defined))$"))
    path = F.when(nested, found["path"]).otherwise(F.array().cast("array<string>"))
    return F.when(sound & path.isNotNull(), F.struct(path.alias("path"), leaf.alias("leaf")))


def typed(value: Column) -> Column:
    """The tagged union of a scalar: an int is never a float, true is no number."""
    kind = F.schema_of_variant(value)
    is_ = lambda *names: F.coalesce(kind.isin(*names), F.lit(False))
    float_ = F.coalesce(kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.lit(False))
    tag = F.when(is_("STRING"), "text").when(is_("BOOLEAN"), "boolean").when(is_("BIGINT"), "integer").when(float_, "float").otherwise("null")
    get = lambda t: F.try_variant_get(value, "$", t)
    return F.struct(
        tag.alias("value_type"), F.when(tag == "text", get("string")).alias("value_text"), F.when(tag == "integer", get("bigint")).alias("value_integer"),
        F.when(tag == "float", get("double")).alias("value_number"), F.when(tag == "boolean", get("boolean")).alias("value_boolean"), F.when(tag == "null", F.lit(True)).alias("value_is_null"),
    )


def _wide(v: Column) -> Column:
    """Whether a scalar is an integer of over 64 bits."""
    digits = F.regexp_extract(F.schema_of_variant(v), r"^DECIMAL\((\d+),0\)$", 1)
    return F.coalesce(digits.try_cast("int") >= 19, F.lit(False))


def _unsound(values: Column) -> Column:
    """What is wrong with an array of scalars, if anything."""
    odd = F.exists(values, lambda v: F.try_variant_get(v, "$.float", "string").isNotNull() | F.coalesce(F.isnan(F.try_variant_get(v, "$", "double")), F.lit(False)))
    return F.when(odd, "NON_FINITE_VALUE").when(F.exists(values, _wide), "INTEGER_OUT_OF_RANGE")


def _examined(nodes: DataFrame) -> DataFrame:
    """Nodes with their leaves, the code that drops their property (hard) and others (soft)."""
    kind, items, rows = F.col("kind"), F.coalesce(_at("node", "items", "array<variant>"), F.array().cast("array<variant>")), F.coalesce(_at("node", "rows", "array<array<variant>>"), F.array().cast("array<array<variant>>"))
    unit, status = _at("node", "unit", "string"), _at("node", "unit_status", "string")
    one = lambda leaf, v, u: F.struct(F.lit(leaf).alias("leaf") if isinstance(leaf, str) else leaf.alias("leaf"), v.alias("value"), u.alias("unit"))
    whole = F.coalesce(F.try_variant_get("node", "$.value", "variant"), F.parse_json(F.lit("null")))
    bounds = F.filter(F.array(*(one(b, F.try_variant_get("node", f"$.{b}", "variant"), unit) for b in ("lower", "upper", "setpoint"))), lambda x: x["value"].isNotNull() & ~F.is_variant_null(x["value"]))
    cell = lambda r, i, k, name: one(F.concat(F.lit("row:"), _number(i), F.lit(f":{name}")), F.get(r, F.lit(k)), _at("node", f"{name}_unit", "string"))
    table = F.flatten(F.transform(rows, lambda r, i: F.array(cell(r, i, 0, "defining"), cell(r, i, 1, "defined"))))
    listed = F.transform(items, lambda v, i: one(F.concat(F.lit("item:"), _number(i)), v, unit))
    sequence = kind.isin("list", "enumerated")
    leaves = F.when(kind.isin("single", "quantity"), F.array(one("0", whole, unit))).when(sequence, listed).when(kind == "bounded", bounds).when(kind == "table", table)
    leaves = F.coalesce(leaves, F.array().cast(_LEAVES))
    incompatible = F.lit(False)
    for s in (status, _at("node", "defining_unit_status", "string"), _at("node", "defined_unit_status", "string")):
        incompatible = incompatible | F.coalesce(s == "incompatible", F.lit(False))
    nested = (kind == "complex") & (F.size(F.coalesce(_at("node", "children", "array<variant>"), F.array().cast("array<variant>"))) > 0)
    hard = (
        F.when(incompatible, "INCOMPATIBLE_UNIT")
        .when(sequence & (F.size(items) > MAX_ITEMS), "LIST_LIMIT_EXCEEDED")
        .when((kind == "table") & (F.size(rows) > MAX_ITEMS), "TABLE_LIMIT_EXCEEDED")
        .when(nested & (F.col("depth") >= MAX_DEPTH), "DEPTH_LIMIT_EXCEEDED")
    )
    hard = F.coalesce(hard, _unsound(F.transform(leaves, lambda x: x["value"])))
    gap = F.exists(leaves, lambda x: F.coalesce(F.is_variant_null(x["value"]), F.lit(True)))
    soft = F.array_compact(F.array(
        F.when((kind == "enumerated") & (F.size(items) == 0), "EMPTY_ENUM").when((kind == "list") & (F.size(items) == 0), "EMPTY_LIST").when((kind == "table") & (F.size(rows) == 0), "EMPTY_TABLE"),
        F.when(kind == "reference", "REFERENCE_UNSUPPORTED_V1"), F.when(~F.coalesce(kind.isin("single", "quantity", "enumerated", "list", "bounded", "table", "reference", "complex"), F.lit(False)), "UNKNOWN_KIND"),
        F.when(F.coalesce(status == "unknown", F.lit(False)), "UNKNOWN_UNIT"), F.when((sequence | (kind == "table")) & gap, "NULL_ITEM"),
    ))
    shown = F.transform(leaves, lambda x: F.struct(x["leaf"].alias("leaf"), typed(x["value"]).alias("value"), x["unit"].alias("unit")))
    return nodes.select(*(c for c in nodes.columns if c not in ("node", "kind", "depth", "open")), shown.alias("leaves"), hard.alias("hard"), soft.alias("soft"))


def _nodes(occurrences: DataFrame) -> DataFrame:
    """Every node of every occurrence: its names from the top, its place, its value.

    Each step puts, for a node not yet opened, the node itself and its children in its
    place. It is one chain in one stage, however deep it goes, and no VARIANT is written on
    the way: storage may make 1 and 1.0 one number.
    """
    struct = "array<struct<path:array<string>,place:array<int>,node:variant,depth:int,open:boolean>>"
    out = occurrences.select("*", F.array().cast("array<string>").alias("path"), F.array().cast("array<int>").alias("place"), F.col("value").alias("node"), F.lit(0).alias("depth"), F.lit(True).alias("open")).drop("value")
    fixed = [c for c in occurrences.columns if c != "value"]
    for depth in range(1, MAX_DEPTH + 1):
        children = F.when(F.col("open") & (_at("node", "kind", "string") == "complex"), _at("node", "children", "array<variant>"))
        name = lambda c: F.coalesce(F.try_variant_get(c, "$.name", "string"), F.lit(""))
        below = F.transform(children, _below(name, depth))
        own = F.array(F.struct("path", "place", "node", "depth", F.lit(False).alias("open")))
        out = out.select(*fixed, F.explode(F.concat(own, F.coalesce(below, F.array().cast(struct)))).alias("x")).select(*fixed, "x.*")
    return out.withColumn("kind", _at("node", "kind", "string"))


def _below(name, depth: int):
    def child(c: Column, k: Column) -> Column:
        path, place = F.concat(F.col("path"), F.array(name(c))), F.concat(F.col("place"), F.array(k))
        return F.struct(path.alias("path"), place.alias("place"), c.alias("node"), F.lit(depth).alias("depth"), F.lit(True).alias("open"))

    return child


def _shuffled(df: DataFrame) -> DataFrame:
    """``df`` to be joined by a shuffle: it has a row for each occurrence, but its file is so
    small, for keys that repeat, that it would be taken for one to be broadcast."""
    return df.hint("merge")


def property_facts(occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of occurrences (KEYS and value, a VARIANT), and diagnostics.

    Facts: SLOT, fact_id, property_name_norm, occurrence_key, unit, origin and value (a
    tagged union). Diagnostics: SLOT, origin, code, fatal, n. Of a slot the instance's
    occurrence counts, else the type's; equal occurrences of one origin are one, unequal ones
    are fatal (AMBIGUOUS_SLOT) and give no facts. A hard code anywhere in a property drops all
    of it, and of several the first in order is told. Equal facts of one id are one, unequal
    ones are fatal (FACT_ID_COLLISION); over MAX_FACTS of an element are fatal. A null value
    has an UNKNOWN_KIND; a name without text has EMPTY_PROPERTY_NAME; empty tables give none.
    """
    work = Work(occurrences.sparkSession)
    named = text.lexical_form_of(F.col("property_name"))
    source = occurrences.select(*KEYS, "value").withColumn("property_name_norm", named).withColumn("occurrence", F.monotonically_increasing_id())
    nodes = work.written(_examined(_nodes(source)), "nodes")
    source = nodes.where(F.size("place") == 0).select(*KEYS, "property_name_norm", "occurrence")
    nodes = nodes.drop(*KEYS, "property_name_norm")
    leaves = nodes.select("occurrence", "path", "place", F.posexplode("leaves").alias("at", "l"))
    values = leaves.select("occurrence", "place", "at", key_of(F.col("path"), F.col("l.leaf")).alias("occurrence_key"), F.col("l.value").alias("value"), F.col("l.unit").alias("unit"))
    values = work.written(values.withColumn("signature", F.sha2(F.to_json(F.struct("occurrence_key", "value", "unit")), 256)), "values")
    # What an occurrence comes to: the first hard code, or the set of its leaves.
    first = nodes.where("hard IS NOT NULL").groupBy("occurrence").agg(F.min_by("hard", "place").alias("hard"))
    signed = values.groupBy("occurrence").agg(F.sha2(F.array_join(F.sort_array(F.collect_set("signature")), ","), 256).alias("leaves"))
    outcome = source.join(_shuffled(first), "occurrence", "left").join(_shuffled(signed), "occurrence", "left").withColumn("comes_to", F.coalesce("hard", "leaves", F.lit("")))
    by_origin = outcome.groupBy(*SLOT, "origin").agg(
        F.count("*").alias("n"), F.count_distinct("comes_to").alias("different"), F.min("occurrence").alias("occurrence"), F.min_by("comes_to", "occurrence").alias("comes_to"), F.min_by("hard", "occurrence").alias("hard"), F.first("property_name_norm").alias("norm")
    )
    by_slot = Window.partitionBy(*SLOT)  # two origins at most
    slots = by_origin.withColumn("origins", F.count("*").over(by_slot)).withColumn("outcomes", F.size(F.collect_set("comes_to").over(by_slot)))
    slots = slots.withColumn("chosen", (F.col("origin") == "instance") | (F.col("origins") == 1)).withColumn("torn", F.max("different").over(by_slot) > 1).withColumn("blank", F.coalesce(F.trim("norm"), F.lit("")) == "")
    slots = work.written(slots, "slots")
    kept = slots.where("chosen AND NOT torn AND NOT blank AND hard IS NULL").select(*SLOT, "origin", "occurrence", F.col("norm").alias("property_name_norm"))
    rows = kept.join(_shuffled(values), "occurrence")
    rows = rows.withColumn("fact_id", ids.fact_id(F.col("project_id"), F.col("element_id"), F.col("source"), F.col("container"), F.col("property_name"), F.col("occurrence_key")))
    one = rows.groupBy(*SLOT, "origin", "property_name_norm", "fact_id", "occurrence_key").agg(F.count("*").alias("n"), F.count_distinct("signature").alias("different"), F.first("value").alias("value"), F.first("unit").alias("unit"))
    one = work.written(one, "facts")
    told = lambda df, code, fatal=False, n=F.lit(1).cast("bigint"): df.select(*SLOT, "origin", (F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(fatal).alias("fatal"), n.alias("n"))
    soft = kept.join(_shuffled(nodes.where(F.size("soft") > 0).select("occurrence", F.explode("soft").alias("code"))), "occurrence")
    said = [
        told(slots.where("blank").groupBy(*SLOT).agg(F.min("origin").alias("origin")), "EMPTY_PROPERTY_NAME"), told(slots.where("NOT blank AND different > 1"), "AMBIGUOUS_SLOT", True), told(slots.where("NOT blank AND NOT torn AND n > 1"), "REDUNDANT_DUPLICATE", n=F.col("n") - 1),
        told(slots.where("chosen AND NOT torn AND NOT blank AND hard IS NOT NULL"), F.col("hard")), told(slots.where("chosen AND NOT torn AND NOT blank AND hard IS NULL AND origins = 2 AND outcomes = 2"), "TYPE_OVERRIDE"),
        soft.groupBy(*SLOT, "origin", "code").agg(F.count("*").alias("n")).select(*SLOT, "origin", "code", F.lit(False).alias("fatal"), "n"),
        told(one.where("different > 1"), "FACT_ID_COLLISION", True), told(one.where("different = 1 AND n > 1"), "REDUNDANT_DUPLICATE", n=F.col("n") - 1),
    ]
    facts = one.where("different = 1").drop("n", "different")
    many = facts.groupBy("project_id", "element_id").agg(F.count("*").alias("n")).where(F.col("n") > MAX_FACTS)
    nothing = F.lit(None).cast("string")
    out = many.select("project_id", "element_id", *(nothing.alias(c) for c in (*SLOT[2:], "origin")), F.lit("FACTS_PER_ELEMENT_LIMIT").alias("code"), F.lit(True).alias("fatal"), "n")
    for df in said:
        out = out.unionByName(df)
    return facts, out


# ------------------------------------------------------------------ associations


def associations(df: DataFrame) -> DataFrame:
    """Associations (project_id, element_id, kind, system, code, name, edition, location,
    identification, description, scope, purpose), each read once, as a classification or a
    document link with what is missing: MISSING_SYSTEM, MISSING_CODE, MISSING_URI. Rows with
    a warning are no records; both sorts come from one pass."""
    there = lambda c: F.nullif(F.col(c), F.lit(""))
    human = lambda c: F.when(F.trim(c) != "", F.col(c))
    is_class, is_doc = F.col("kind") == "classification", F.col("kind") == "document"
    uri = F.coalesce(there("location"), there("identification"))
    warning = F.when(is_class & there("system").isNull(), "MISSING_SYSTEM").when(is_class & there("code").isNull(), "MISSING_CODE").when(is_doc & uri.isNull(), "MISSING_URI")
    title = F.coalesce(there("name"), there("description"))
    return df.where(F.coalesce(is_class | is_doc, F.lit(False))).select(
        "project_id", "element_id", "kind", warning.alias("warning"), F.when(is_class, there("system")).alias("system"), F.when(is_class, there("code")).alias("code"), F.when(is_class, human("name")).alias("name"),
        F.when(is_class, human("edition")).alias("edition"), F.when(is_class & warning.isNull(), ids.classification_id(F.col("project_id"), F.col("element_id"), F.col("system"), F.col("code"))).alias("classification_id"),
        F.when(is_doc, uri).alias("uri"), F.when(is_doc & (F.trim(title) != ""), title).alias("title"),
        F.when(is_doc, F.coalesce(F.when(F.trim(F.coalesce(there("scope"), there("purpose"))) != "", F.coalesce(there("scope"), there("purpose"))), F.lit("document"))).alias("document_type"),
    )


def documents(links: DataFrame) -> DataFrame:
    """One record for each project and uri: the least title and type that are told, the
    elements linked, and whether titles or types disagree."""
    good = links.where("kind = 'document' AND warning IS NULL")
    out = good.groupBy("project_id", "uri").agg(
        F.min("title").alias("title"), F.min("document_type").alias("document_type"), F.sort_array(F.collect_set("element_id")).alias("linked_element_ids"),
        (F.count_distinct("title") > 1).alias("title_conflict"), (F.count_distinct("document_type") > 1).alias("type_conflict"),
    )
    return out.withColumn("document_id", ids.identity("document", F.col("project_id"), F.col("uri")))


#: Where each shape of a material holder keeps its parts, the role they have, and whether the part refers to its material. Fixed values.
HOLDERS = {
    "IfcMaterialLayerSetUsage": ("ForLayerSet.MaterialLayers", "layer", True), "IfcMaterialLayerSet": ("MaterialLayers", "layer", True), "IfcMaterialConstituentSet": ("MaterialConstituents", "constituent", True),
    "IfcMaterialList": ("Materials", None, False), "IfcMaterialProfileSetUsage": ("ForProfileSet.MaterialProfiles", "profile", True), "IfcMaterialProfileSet": ("MaterialProfiles", "profile", True),
}


def holder_materials(df: DataFrame, key: str, holder: str) -> DataFrame:
    """(key, ordinal, name, role, issue) of material holders (VARIANT, with their class as
    ``type``): sets of layers, constituents and profiles, directly or by their usage, lists, a
    single layer, a single material or anything else with a name. Entries without a name
    have an issue and no name; null holders have none."""
    kind = _at(holder, "type", "string")
    name = lambda v, inner: F.try_variant_get(v, "$.Material.Name" if inner else "$.Name", "string")
    entry = lambda v, role, inner: F.struct(name(v, inner).alias("name"), F.lit(role).cast("string").alias("role"))
    parts = F.when(kind == "IfcMaterialLayer", F.array(entry(F.col(holder), "layer", True)))
    each_of = lambda role, inner: lambda v: entry(v, role, inner)
    for shape, (path, role, inner) in HOLDERS.items():
        parts = parts.when(kind == shape, F.transform(_at(holder, path, "array<variant>"), each_of(role, inner)))
    parts = parts.when(F.col(holder).isNotNull(), F.array(entry(F.col(holder), None, False)))
    each = df.select(key, F.posexplode(parts).alias("ordinal", "m")).select(key, "ordinal", F.when(F.trim("m.name") != "", F.col("m.name")).alias("name"), "m.role")
    return each.withColumn("issue", F.when(F.col("name").isNull(), "MATERIAL_WITHOUT_NAME"))

"""Predicates over elements, documents and gold records, as Column builders."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes searched together, fields a metric falls back to, storey labels.
CLASS_VARIANTS = {"IfcWall": ["IfcWall", "IfcWallStandardCase"], "IfcStair": ["IfcStair", "IfcStairFlight"]}
STOREY_PREFIXES = ["piso", "andar", "nivel", "nível", "storey", "level", "floor"]
GROUND_LABELS = ["r/c", "res-do-chao", "rés-do-chão", "terreo", "térreo"]
BASEMENT_LABELS = ["cave"]
APPROX = 0.5


def class_filter(column: str, ifc_class: str) -> Column:
    return F.col(column).isin(CLASS_VARIANTS.get(ifc_class, [ifc_class]))


def numeric_filter(fields: list[str], op: str, value: float) -> Column:
    """True if *any* present field satisfies the condition (not the first one)."""
    test = {
        "gt": lambda c: c > value,
        "gte": lambda c: c >= value,
        "lt": lambda c: c < value,
        "lte": lambda c: c <= value,
        "eq": lambda c: c == value,
        "approx": lambda c: c.between(value - APPROX, value + APPROX),
    }[op]
    return reduce(lambda a, b: a | b, (F.coalesce(test(F.col(f)), F.lit(False)) for f in fields))


def material_filter(column: str, groups: list[list[str]]) -> Column:
    """Any literal within a group, every group; blanks dropped, case ignored."""
    lowered = F.transform(column, lambda m: F.lower(m))
    out = F.lit(True)
    for group in groups:
        wanted = list(dict.fromkeys(g.strip().lower() for g in group if g.strip()))
        if wanted:
            out = out & F.arrays_overlap(lowered, F.array(*map(F.lit, wanted)))
    return out


def storey_labels(storey: str) -> list[str]:
    """The labels that a storey as understood from a question may be stored under."""
    value = storey.strip()
    if re.fullmatch(r"-?\d+", value):
        n = str(int(value))
        labels = [n, *(f"{p} {n}" for p in STOREY_PREFIXES)]
        if len(n) == 1:
            labels.append(f"0{n}")
        labels += GROUND_LABELS if n == "0" else BASEMENT_LABELS if n == "-1" else []
    elif re.fullmatch(r"[A-Za-z]\d+", value):
        labels = [value.lower(), *(f"{p} {value.lower()}" for p in STOREY_PREFIXES)]
    else:
        labels = [value.lower()] if value else []
    return list(dict.fromkeys(labels))


def storey_filter(column: str, storey: str) -> Column:
    return F.lower(F.col(column)).isin(storey_labels(storey))


def name_filter(column: str, name: str) -> Column:
    return F.lower(F.col(column)) == name.lower()


def legacy_filter(*, materials: list[list[str]] | None = None, storey: str | None = None, name: str | None = None) -> Column:
    """The conjunction in its fixed order: material, storey, name."""
    parts = []
    if materials:
        parts.append(material_filter("materials", materials))
    if storey:
        parts.append(storey_filter("storey", storey))
    if name:
        parts.append(name_filter("name", name))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def canonical_filter(classes: list[str] | None = None, project: str | None = None, materials: list[str] | None = None, storey: str | None = None) -> Column:
    """Exact terms; an empty value is an error, not a wildcard."""
    out = F.lit(True)
    for name, value in (("classes", classes), ("project", project), ("materials", materials), ("storey", storey)):
        if value is not None and not value:
            raise ValueError(f"{name} is empty")
    if classes is not None:
        out = out & F.col("ifc_class").isin(classes)
    if project is not None:
        out = out & (F.col("project_id") == project)
    if materials is not None:
        out = out & F.exists("materials", lambda m: m.isin(materials))
    if storey is not None:
        out = out & (F.col("storey") == storey)
    return out


def document_scope(chunks: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks whose revisions are the active ones."""
    return chunks.join(active, keys, "left_semi")


def gold_predicate(column: str, op: str, values: list | None = None, is_list: bool = False) -> Column:
    """The predicate language of gold facets; a null satisfies not_in, an empty list no all_in."""
    c, literals = F.col(column), F.array(*map(F.lit, values or []))
    if op == "is_null":
        return c.isNull()
    if op == "not_null":
        return c.isNotNull()
    if is_list:
        if op == "any_in":
            return F.coalesce(F.exists(c, lambda x: x.isin(values)), F.lit(False))
        if op == "all_in":
            return F.coalesce(F.forall(c, lambda x: x.isin(values)) & (F.size(c) > 0), F.lit(False))
        if op == "not_in":
            return F.coalesce(~F.exists(c, lambda x: x.isin(values)), F.lit(True))
    else:
        if op in ("in", "eq"):
            return F.coalesce(c.isin(values), F.lit(False))
        if op == "not_in":
            return F.coalesce(~c.isin(values), F.lit(True))
        if op == "contains_ci":
            return F.coalesce(F.exists(literals, lambda v: F.instr(F.lower(c), F.lower(v)) > 0), F.lit(False))
    raise ValueError(f"unknown operator {op}")


def name_has_all_terms(column: str, query: str) -> Column:
    own = F.split(F.lower(F.col(column)), r"[^\p{L}\p{N}]+")
    return reduce(lambda a, b: a & b, (F.array_contains(own, t) for t in re.findall(r"\w+", query.lower())), F.lit(True))


def eligibility(df: DataFrame, status: str = "status", issues: str = "issues", advisory: list[str] | None = None, key: str = "element_id") -> DataFrame:
    """Why a geometry fact may not take part, first failing rule first; null: it may."""
    from pyspark.sql import Window

    only_advice = F.forall(issues, lambda i: i.isin(advisory or []))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("geometry_id"))
    ranked = df.withColumn("_rank", rank)
    reason = F.when(~F.col(status).isin("valid", "partial"), "status").when((F.col(status) == "partial") & ~only_advice, "issues").when(F.col("_rank") > 1, "duplicate")
    return ranked.withColumn("reason", reason).drop("_rank")


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """A page of rows in a total order, with the exact number of all rows."""
    from pyspark.sql import Window

    if size == 0:
        return df.limit(0)
    total = df.agg(F.count("*").alias("total"))
    top = df.orderBy(*order).limit(offset + size)  # a bounded number of rows from here on
    numbered = top.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1).where(F.col("position") >= offset)
    return numbered.crossJoin(F.broadcast(total))


def by_ids(df: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """Records in the order asked for, fetched at once; an id that is not there is an error."""
    spark = df.sparkSession
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"position int, {key} string")
    out = df.join(F.broadcast(asked), key)
    rows = out.collect()  # a record for each id
    missing = set(ids) - {r[key] for r in rows}
    if missing:
        raise KeyError(sorted(missing)[:10])
    return spark.createDataFrame(rows, out.schema).orderBy("position")


def lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """The records with an id."""
    return df.where(F.col(key) == value)


def looked_up(df: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Rows with the record that their id stands for; those without one are left out."""
    return df.join(records, key)


def project_filter(column: str, project: str) -> Column:
    """Records of a project, whose id is matched as it stands; a blank one is an error."""
    if not project.strip():
        raise ValueError("a project is needed")
    return F.col(column) == project


def numeric_conditions(df: DataFrame, fields: dict[str, list[str]], conditions: list[tuple[str, str, float]]) -> Column:
    """All conditions (metric, op, value); a metric without a field in the table is ignored."""
    out = F.lit(True)
    for name, op, value in conditions:
        own = [f for f in fields.get(name, []) if f in df.columns]
        if own:
            out = out & numeric_filter(own, op, value)
    return out


def active_chunks(chunks: DataFrame, current: DataFrame, key: str = "document_id") -> DataFrame:
    """Chunks whose document and link revisions are both the current ones (key,
    revision_id, link_revision_id). A document that has no current revisions is an error."""
    now = current.select(key, F.col("revision_id").alias("_revision"), F.col("link_revision_id").alias("_links"))
    known = F.col("_revision").isNotNull() & F.col("_links").isNotNull()
    same = (F.col("revision_id") == F.col("_revision")) & (F.col("link_revision_id") == F.col("_links"))
    keep = F.when(known, same).otherwise(F.raise_error(F.concat(F.lit("no current revisions of document "), F.col(key).cast("string"))).cast("boolean"))
    return chunks.join(now, key, "left").where(keep).drop("_revision", "_links")

"""Texts made of records: labelled lines for embedding, ranking, evidence and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def labelled(lines: list[tuple[str, Column]]) -> Column:
    """``label: value`` lines in order; null and blank values are left out."""
    shown = [F.when(F.trim(v.cast("string")) != "", F.concat(F.lit(f"{label}: "), v.cast("string"))) for label, v in lines]
    return F.concat_ws("\n", *shown)


#: Lines of an element's embedding text: label and column. Fixed values.
ELEMENT_LINES = [
    ("IFC class", "ifc_class"),
    ("Name", "name"),
    ("Description", "description"),
    ("Object type", "object_type"),
    ("Predefined type", "predefined_type"),
    ("Semantic label", "semantic_label"),
    ("Materials", "materials"),
    ("Site", "site"),
    ("Building", "building"),
    ("Storey", "storey"),
    ("Space", "space"),
]


def element_text(df: DataFrame) -> Column:
    """Embedding text of an element: a line for each value that is there and not blank,
    as it stands. Columns that the table doesn't have are absent."""
    shown = lambda c: F.array_join(c, ", ") if df.schema[c].dataType.typeName() == "array" else F.col(c)
    return labelled([(label, shown(c)) for label, c in ELEMENT_LINES if c in df.columns])


def pruned(value: object, inside_list: bool = False) -> object:
    """A record without nulls and without objects that this empties; empty lists and
    texts stay. An item of a list that would be emptied is an error."""
    if isinstance(value, dict):
        kept = {k: pruned(v) for k, v in value.items() if v is not None}
        kept = {k: v for k, v in kept.items() if v != {} or not isinstance(v, dict)}
        if inside_list and not kept:
            raise ValueError("an item of a list has nothing left")
        return kept
    return [pruned(v, True) for v in value] if isinstance(value, list) else value


def pruned_json(df: DataFrame, columns: list[str]) -> Column:
    """pruned() of columns as JSON with sorted keys: nulls and, at any depth, objects of nothing but nulls are left out."""

    def shown(c: Column, kind: DataType) -> Column:
        if not isinstance(kind, StructType):
            return c
        fields = [shown(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        some = reduce(lambda a, b: a | b, (f.isNotNull() for f in fields))
        return F.when(some, F.struct(*fields))

    return F.to_json(F.struct(*(shown(F.col(c), df.schema[c].dataType).alias(c) for c in sorted(columns))))


def chunk_text(path: Column, title: Column, body: Column, limit: int = 2000) -> Column:
    """Up to three path levels, the title unless it ends the path, then the body; cut to ``limit``."""
    top = F.slice(path, 1, 3)
    head = F.when(F.size(top) > 0, F.array_join(top, " > "))
    own = F.when(~title.eqNullSafe(F.try_element_at(path, F.lit(-1))), title)
    return F.left(F.concat_ws("\n", head, own, body), F.lit(limit))


def rerank_text(title: Column, path: Column, body: Column, passage: int = 1200) -> Column:
    """Lines of title, path and the first ``passage`` characters. Null values are left out; blank ones are not."""
    lines = [("section", title), ("path", F.array_join(path, " > ")), ("passage", F.left(body, F.lit(passage)))]
    return F.concat_ws("\n", *(F.concat(F.lit(f"{label}: "), v) for label, v in lines))


def evidence_text(lines: list[tuple[str, Column]], limit: int = 2000) -> Column:
    return F.left(labelled(lines), F.lit(limit))


def canonical_json(columns: list[str]) -> Column:
    """Compact JSON with sorted keys; absent values are left out."""
    return F.to_json(F.struct(*sorted(columns)))


def safe_keys(values: Column) -> Column:
    """Map keys with dots made underscores."""
    return F.transform_keys(values, lambda k, _: F.replace(k, F.lit("."), F.lit("_")))


def bucket_lines(key: Column, n: Column) -> Column:
    """A line of an aggregation answer."""
    return F.concat(F.lit("- "), key, F.lit(": "), n.cast("string"))


def redacted(record: dict, secret: tuple[str, ...] = ("authorization", "api_key", "token", "password", "secret")) -> dict:
    """A log record with sensitive values masked, at any depth."""
    return {k: "***" if any(s in k.lower() for s in secret) else redacted(v, secret) if isinstance(v, dict) else v for k, v in record.items()}


def hit_text(position: Column, limit: int = 1200) -> Column:
    """A hit of a result list as a prompt shows it; absent lines are left out."""
    short = lambda c: F.call_function("format_number", c, F.lit("0.######"))
    metrics = F.concat_ws(", ", *(F.when(F.col(m).isNotNull(), F.concat(F.lit(f"{m}="), short(F.col(m)))) for m in ("height", "area", "volume")))
    head = F.concat(F.lit("["), position.cast("string"), F.lit("]"))
    lines = labelled([("ifc_class", F.col("ifc_class")), ("name", F.col("name")), ("storey", F.col("storey")), ("materials", F.array_join(F.slice("materials", 1, 5), ", ")), ("metrics", metrics)])
    return F.left(F.concat_ws("\n", head, lines), F.lit(limit))


def property_pairs(properties: Column, skip: list[str]) -> Column:
    """``name=value`` of a string map, keys in order, those to be skipped left out."""
    kept = F.map_filter(properties, lambda k, v: ~F.lower(F.replace(k, F.lit(" "), F.lit(""))).isin(skip) & (F.trim(v) != ""))
    pairs = F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), F.regexp_replace(F.trim(e["value"]), r"\s+", " ")))
    return F.array_join(F.sort_array(pairs), "\n")

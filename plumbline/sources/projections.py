"""From records to what an index stores: a registry of projections, checked by schema.

A projection names the columns it needs, says for each row why it can't be stored, if it
can't, and what is stored. Rows and refusals come from one pass: a refused row keeps its id
and its reason and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.store import Store
from plumbline.sources.work import Work

INT32 = 2**31 - 1
#: Mention outcomes that a report holds at most. Fixed value.
REPORT_ROWS = 10_000


@dataclass(frozen=True)
class Projection:
    key: str
    needs: dict[str, str]  # column and type
    refused: Callable[[], Column]  # a reason, or null
    stored: Callable[[], dict[str, Column]]


REGISTRY: dict[str, Projection] = {}


def register(kind: str, projection: Projection) -> None:
    """Add a projection; a kind has one."""
    if REGISTRY.setdefault(kind, projection) is not projection:
        raise ValueError(f"{kind} has a projection")


def projected(df: DataFrame, kind: str) -> DataFrame:
    """The stored columns of every row and refused, its reason or null. A kind that isn't
    registered, or a column that is missing or of another type, is an error before any row is read."""
    p = REGISTRY[kind]
    have = dict(df.dtypes)
    wrong = {c: (have.get(c), t) for c, t in p.needs.items() if have.get(c) != t}
    if wrong:
        raise ValueError(f"{kind} can't be projected: {wrong}")
    reason = F.coalesce(F.when(F.coalesce(F.col(p.key), F.lit("")) == "", "missing_id"), p.refused())
    told = df.withColumn("_refused", reason)
    kept = [(F.col(c) if c == p.key else F.when(F.col("_refused").isNull(), v)).alias(c) for c, v in p.stored().items()]
    return told.select(*kept, F.col("_refused").alias("refused"))


def index(store: Store, name: str, df: DataFrame, kind: str) -> tuple[dict, DataFrame]:
    """Make the rows of a kind those of a version, and return the refusals (id, reason) as a
    side output: the projection is run once, into a table that both are read from."""
    p = REGISTRY[kind]
    done = Work(store.spark).written(projected(df, kind), "projected")
    report = store.replace(name, done.where("refused IS NULL").drop("refused"), p.key)
    return report, done.where("refused IS NOT NULL").select(p.key, "refused")


def bounded_report(outcomes: DataFrame, key: str, by: str, limit: int = REPORT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Counts of all outcomes, and the first ``limit`` rows by key, each told whether there
    are more. The limit is that of the report; the counts are of everything."""
    counts = outcomes.groupBy(by).agg(F.count("*").alias("n"))
    first = outcomes.orderBy(key).limit(limit)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_total"))  # one row
    return counts, first.crossJoin(F.broadcast(total)).select(*outcomes.columns, (F.col("_total") > limit).alias("truncated"))


#: The payload column of each value type. Fixed values.
PAYLOADS = {"text": "value_text", "int": "value_integer", "float": "value_number", "bool": "value_boolean"}


def _payloads() -> dict[str, Column]:
    kind, raw = F.col("value_type"), F.col("value")
    return {
        "value_text": F.when(kind == "text", raw), "value_integer": F.when((kind == "int") & F.regexp_like(raw, F.lit(r"^-?\d+$")), raw.try_cast("bigint")),
        "value_number": F.when((kind == "float") & F.regexp_like(raw, F.lit(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")), raw.try_cast("double")), "value_boolean": F.when((kind == "bool") & raw.isin("true", "false"), raw == "true"),
    }


def _fact_refused() -> Column:
    kind, payloads = F.col("value_type"), _payloads()
    number = payloads["value_number"]
    given = F.coalesce(*(F.when(kind == k, payloads[c].isNotNull()) for k, c in PAYLOADS.items()), F.lit(False))
    return (
        F.when(kind.isNull(), "no_value_type").when((kind == "null") & F.col("value").isNotNull(), "null_with_payload").when(~kind.isin("null", *PAYLOADS), "unknown_value_type")
        .when((kind == "int") & F.regexp_like("value", F.lit(r"^-?\d+$")) & payloads["value_integer"].isNull(), "int_out_of_range").when((kind == "float") & (F.abs(number) == float("inf")), "not_finite")
        .when((kind != "null") & ~given, "wrong_payload")
    )


def _within(c: str) -> Column:
    return (F.col(c) >= 0) & (F.col(c) <= INT32)


_FACT = ["fact_id", "project_id", "element_id", "source", "container", "property_name", "property_name_norm", "occurrence_key", "unit"]
register("property_fact", Projection(
    "fact_id", {**dict.fromkeys([*_FACT, "value_type", "value"], "string")}, _fact_refused,
    lambda: {**{c: F.col(c) for c in [*_FACT, "value_type"]}, "value_is_null": F.col("value_type") == "null", **_payloads()},
))
_CHUNK = {"chunk_id": "string", "document_id": "string", "project_id": "string", "revision_id": "string", "chunk_index": "bigint", "page_number": "bigint", "section_path": "array<string>", "section_title": "string", "text": "string", "char_count": "bigint"}
_OCR = {"schema_version": "string", "ocr": "boolean", "confidence": "double", "base_chunk_id": "string", "link_revision_id": "string", "linked_element_ids": "array<string>"}
register("chunk", Projection(
    "chunk_id", _CHUNK | _OCR,
    lambda: F.when(~F.coalesce(F.col("schema_version").isin("1.0", "2.0", "3.0"), F.lit(False)), "unknown_version").when(F.col("text").isNull(), "no_text")
    .when(~F.coalesce(_within("chunk_index") & _within("char_count") & _within("page_number") & (F.col("page_number") > 0), F.lit(False)), "number_out_of_range").when((F.col("schema_version") == "3.0") & F.col("link_revision_id").isNull(), "no_link_revision"),
    lambda: {
        **{c: F.col(c).cast("int") if t == "bigint" else F.col(c) for c, t in _CHUNK.items()}, "schema_version": F.col("schema_version"), **{c: F.when(F.col("schema_version") >= "2.0", F.col(c)) for c in ("ocr", "confidence")},
        **{c: F.when(F.col("schema_version") == "3.0", F.col(c)) for c in ("base_chunk_id", "link_revision_id", "linked_element_ids")},
    },
))

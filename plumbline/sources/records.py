"""Reading and writing typed JSON lines: nothing is coerced, nothing raises per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ELEMENT = "schema_version string, element_id string, project_id string, global_id string, ifc_class string, name string, description string, object_type string, predefined_type string, semantic_label string, materials array<struct<name:string,name_norm:string,role:string,ordinal:int>>, metrics struct<area:double,volume:double,height:double,thickness:double>"
FACT = "schema_version string, fact_id string, project_id string, element_id string, source string, container string, property_name string, property_name_norm string, occurrence_key string, unit string, value struct<value_type:string,value:string>"
CHUNK = "chunk_id string, document_id string, project_id string, revision_id string, chunk_index int, page_number int, page_span array<int>, section_path array<string>, section_title string, section_index int, text string, char_count int"
WARNING = "code string, ifc_class string, reference string, field string, detail_code string, occurrences int"
SCHEMAS = {"element": ELEMENT, "property_fact": FACT, "chunk": CHUNK, "warning": WARNING}


def parsed_lines(lines: DataFrame, schema: str, required: list[str], text: str = "value") -> DataFrame:
    """Lines of JSON with record, digest and error: parse_error, unknown_field,
    missing_field or null; blank lines are skipped. One pass, no line is lost."""
    known = T._parse_datatype_string(schema).fieldNames()
    row = F.from_json(F.col(text), f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    out = lines.where(F.trim(text) != "").withColumn("_row", row)
    keys = F.json_object_keys(F.col(text))
    missing = [F.col(f"_row.{c}").isNull() for c in required]
    any_missing = missing[0]
    for m in missing[1:]:
        any_missing = any_missing | m
    error = F.when(F.col("_row").isNull() | F.col("_row._bad").isNotNull() | keys.isNull(), "parse_error").when(F.exists(keys, lambda k: ~k.isin(known)), "unknown_field").when(any_missing, "missing_field")
    digest = F.sha2(F.col(text).cast("binary"), 256)
    return out.withColumn("error", error).withColumn("digest", digest).withColumn("record", F.when(F.col("error").isNull(), F.struct(*(F.col(f"_row.{c}") for c in known)))).drop("_row")


def read_lines(spark: SparkSession, path: str, kind: str, required: list[str]) -> DataFrame:
    """Records of one family, each with the file and what is wrong with it."""
    return parsed_lines(spark.read.text(path).withColumn("file", F.col("_metadata.file_path")), SCHEMAS[kind], required)


def write_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """Canonical JSON lines in order: sorted keys, absent values left out."""
    text = F.to_json(F.struct(*sorted(df.columns)))
    df.orderBy(*order).select(text.alias("value")).write.mode("overwrite").text(path)


def legacy_cleaned(df: DataFrame) -> DataFrame:
    """Legacy elements made plain: ids trimmed and lower-cased, metrics numbers or null,
    a single material a list."""
    lowered = [F.lower(F.trim(F.col(c))).alias(c) if c.endswith("_id") else F.col(c) for c in df.columns]
    out = df.select(*lowered)
    for c in ("height", "area", "volume", "thickness"):
        if c in out.columns:
            out = out.withColumn(c, F.col(c).cast("string").try_cast("double"))
    if "material" in out.columns and dict(out.dtypes)["material"] == "string":
        out = out.withColumn("material", F.when(F.trim("material") != "", F.array(F.trim("material"))).otherwise(F.array().cast("array<string>")))
    return out


def digest_of(df: DataFrame, columns: list[str]) -> str:
    """One checksum for the rows of a table, whatever their order."""
    one = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)).cast("binary"), 256)
    low, high = (F.conv(F.substring(one, a, 12), 16, 10).cast("decimal(38,0)") for a in (1, 13))
    r = df.agg(F.sum(low).alias("a"), F.sum(high).alias("b"), F.count("*").alias("n")).first()
    return f"{r['n']}:{r['a']}:{r['b']}"


def absent_if_blank(c: Column) -> Column:
    """Blank human text is absent; other text stays as it is."""
    return F.when(F.trim(c) != "", c)

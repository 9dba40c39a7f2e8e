"""Property facts from nested values, and the rules between their origins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ITEMS, MOST_FACTS = 4096, 10_000


def occurrence(kind: str, index: Column | None = None, part: str | None = None) -> Column:
    """Key of one value of a property: item, row or bound."""
    if kind == "single":
        return F.lit("single")
    if kind == "list":
        return F.format_string("item:%06d", index)
    if kind == "table":
        return F.concat(F.format_string("row:%06d:", index), F.lit(part))
    return F.lit(part)


def parse_occurrence(key: Column) -> Column:
    """struct(kind, index, part) of an occurrence key."""
    item, row = F.regexp_extract(key, r"^item:(\d{6})$", 1), F.regexp_extract(key, r"^row:(\d{6}):", 1)
    kind = F.when(item != "", "list").when(row != "", "table").when(key.isin("lower", "upper", "setpoint"), "bounded").otherwise("single")
    index = F.when(item != "", item).when(row != "", row).cast("int")
    part = F.when(row != "", F.regexp_extract(key, r"^row:\d{6}:(.*)$", 1)).when(kind == "bounded", key)
    return F.struct(kind.alias("kind"), index.alias("index"), part.alias("part"))


def atomised(lists: DataFrame, keys: list[str], values: str) -> DataFrame:
    """A row for each item of a list value. Too many items, or any that isn't finite,
    and the whole property is dropped."""
    v = F.col(values)
    sound = (F.size(v) <= MOST_ITEMS) & ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return lists.where(F.coalesce(sound, F.lit(False))).select(*keys, F.posexplode(v).alias("index", "value")).withColumn("occurrence_key", occurrence("list", F.col("index")))


def bounded(df: DataFrame, keys: list[str], lower: str, upper: str, setpoint: str) -> DataFrame:
    """A row for each bound that is there."""
    return df.selectExpr(*keys, f"stack(3, 'lower', {lower}, 'upper', {upper}, 'setpoint', {setpoint}) AS (occurrence_key, value)").where("value IS NOT NULL")


def overridden(instance: DataFrame, of_type: DataFrame, keys: list[str]) -> DataFrame:
    """Properties of the instance, and of its type where the instance has none at all."""
    return instance.withColumn("origin", F.lit("instance")).unionByName(of_type.join(instance.select(*keys).distinct(), keys, "left_anti").withColumn("origin", F.lit("type")))


def collisions(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Slots with unequal values of one origin: these are fatal."""
    return df.groupBy(*keys).agg(F.countDistinct(value).alias("values")).where("values > 1")


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Equal repeats once."""
    return df.dropDuplicates(keys)


def resolved_unit(explicit: Column, project: Column, dimension: Column, unit_dimension: Column) -> Column:
    """The explicit unit, else the project's for the dimension; null if it doesn't fit."""
    unit = F.coalesce(explicit, project)
    return F.when(unit_dimension.isNull() | (unit_dimension == dimension), unit)


def first_finite(candidates: list[Column]) -> tuple[Column, Column]:
    """The first finite candidate in order of priority, and whether several are there."""
    sound = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) for c in candidates]
    several = sum((c.isNotNull().cast("int") for c in sound), F.lit(0)) >= 2
    return F.coalesce(*sound), several


def inherited(own: Column, of_type: Column, type_name: Column | None = None) -> Column:
    """A value of the instance, else of its type, else the type's name."""
    out = [F.nullif(F.trim(own), F.lit("")), F.nullif(F.trim(of_type), F.lit(""))]
    return F.coalesce(*out, *([F.nullif(F.trim(type_name), F.lit(""))] if type_name is not None else []))


def materials(df: DataFrame, key: str, column: str) -> DataFrame:
    """Materials of a holder's list with their ordinal."""
    return df.select(key, F.posexplode(column).alias("ordinal", "material"))


def typed(value: Column) -> Column:
    """The tagged union of a raw JSON token: int is never widened, true is no number."""
    raw = F.trim(value)
    kind = F.when(raw == "null", "null").when(raw.isin("true", "false"), "bool").when(F.regexp_like(raw, F.lit(r"^-?\d+$")), "int").when(F.regexp_like(raw, F.lit(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")), "float").otherwise("text")
    return F.struct(
        kind.alias("value_type"), F.when(kind == "text", F.regexp_replace(raw, r'^"|"$', "")).alias("value_text"), F.when(kind == "int", F.try_to_number(raw, F.lit("S9999999999999999999")).cast("bigint")).alias("value_integer"),
        F.when(kind == "float", raw.try_cast("double")).alias("value_number"), F.when(kind == "bool", raw == "true").alias("value_boolean"), (kind == "null").alias("value_is_null"),
    )


def within_limit(df: DataFrame, key: str) -> DataFrame:
    """Elements with more facts than allowed."""
    return df.groupBy(key).count().where(F.col("count") > MOST_FACTS)


def spatial_chain(parents: DataFrame, elements: DataFrame, depth: int = 4) -> DataFrame:
    """Ancestors of elements, nearest first."""
    from .graph import ancestors

    return ancestors(parents, elements, depth).withColumn("order", F.row_number().over(Window.partitionBy("element").orderBy("level")))


def legacy_metric(quantities: Column, properties: Column, keys: list[str]) -> Column:
    """The first of ``keys`` found in the sets of quantities, else in those of
    properties; both are arrays of maps, looked through set by set."""
    within = lambda one: F.coalesce(*(F.try_element_at(one, F.lit(k)) for k in keys))
    first = lambda sets: F.try_element_at(F.filter(F.transform(sets, within), lambda v: v.isNotNull()), F.lit(1))
    return F.coalesce(first(quantities), first(properties))

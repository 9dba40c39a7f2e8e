"""Counts, buckets and folded groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 200


def buckets(df: DataFrame, key: str, size: int = BUCKETS) -> DataFrame:
    """Values of a field with their documents, most first, ties by value."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(size)


def array_buckets(df: DataFrame, key: str, size: int = BUCKETS) -> DataFrame:
    """Values of a list field; a document counts once for each distinct value."""
    return buckets(df.select(F.explode(F.array_distinct(key)).alias("key")), "key", size)


def nested_buckets(df: DataFrame, code: str, parent: str, size: int = BUCKETS) -> DataFrame:
    """Codes chosen by nested rows, shown with their distinct parents, most first."""
    by_code = df.groupBy(F.col(code).alias("key")).agg(F.count("*").alias("nested"), F.countDistinct(parent).alias("n"))
    return by_code.orderBy(F.desc("nested"), "key").limit(size).orderBy(F.desc("n"), "key")


def mean(value: str) -> Column:
    return F.bround(F.avg(value), 6)


def coverage(df: DataFrame, by: list[str], counters: list[str]) -> DataFrame:
    """Field-wise sums of counters."""
    return df.groupBy(*by).agg(*(F.sum(c).alias(c) for c in counters))


def zero_filled(df: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """Counts by code with a zero for every code that did not occur."""
    return codes.join(df.groupBy(key).agg(F.count("*").alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def accumulated(df: DataFrame, key: str, element: str, title: str) -> DataFrame:
    """One document from many mentions: its elements, the smallest title, and whether titles conflict."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(element)).alias("elements"), F.min(title).alias("title"), (F.countDistinct(title) > 1).alias("conflict"))


def strongest_links(df: DataFrame, by: list[str], rank: str, method: str, span: str) -> DataFrame:
    """Per group the method of the lowest rank, and all spans, sorted and distinct. Of rows
    that agree in rank and span the first read counts, so that reruns agree."""
    df = df.withColumn("_read", F.monotonically_increasing_id())
    return df.groupBy(*by).agg(F.min_by(method, F.struct(rank, span, "_read")).alias("method"), F.sort_array(F.collect_set(span)).alias("spans"))


def all_or_nothing_min(value: str) -> Column:
    """The smallest value of a group, null if any is missing."""
    return F.when(F.count("*") == F.count(value), F.min(value))


def occurrences(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows once for each distinct key, numbered within ``by``."""
    from pyspark.sql import Window

    return df.dropDuplicates([*by, order]).withColumn("occurrence", F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def matching(df: DataFrame, condition: Column) -> DataFrame:
    """How many rows match."""
    return df.where(condition).agg(F.count("*").alias("n"))

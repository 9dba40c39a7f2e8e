"""Ranks, ties, fusion, reranking, pages of frozen lists and metrics of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
DEPTH = 200


def ranked(df: DataFrame, by: list[str], score: str = "score", key: str = "id", depth: int | None = None) -> DataFrame:
    """1-based contiguous rank: score descending, then id; per group of ``by``."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), key))
    out = df.withColumn("rank", rank)
    return out if depth is None else out.where(F.col("rank") <= depth)


def tie_groups(df: DataFrame, by: list[str], score: str = "score", key: str = "id") -> DataFrame:
    """Ids that share a score, of groups of two or more."""
    return df.groupBy(*by, score).agg(F.sort_array(F.collect_list(key)).alias("ids")).where(F.size("ids") > 1)


def fused(left: DataFrame, right: DataFrame, by: list[str], k: int = RRF_K, depth: int = DEPTH) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (id, rank).

    A row's score is one correctly rounded division, so rows that are equal as
    fractions are equal as doubles; ties go to more sources, then to the id.
    """
    a = left.where(F.col("rank") <= depth).select(*by, "id", F.col("rank").alias("left_rank"))
    b = right.where(F.col("rank") <= depth).select(*by, "id", F.col("rank").alias("right_rank"))
    both = a.join(b, [*by, "id"], "full_outer")
    x, y = F.col("left_rank").cast("double"), F.col("right_rank").cast("double")
    exact = F.when(x.isNotNull() & y.isNotNull(), (x + y + 2 * k) / ((x + k) * (y + k))).otherwise(F.lit(1.0) / (F.coalesce(x, y) + k))
    sources = x.isNotNull().cast("int") + y.isNotNull().cast("int")
    order = Window.partitionBy(*by).orderBy(F.desc("exact"), F.desc("sources"), "id")
    out = both.withColumn("exact", exact).withColumn("sources", sources).withColumn("rank", F.row_number().over(order))
    return out.withColumn("score", F.bround("exact", 6)).drop("exact")


def reranked(candidates: DataFrame, by: list[str], score: str, threshold: float | None, depth: int = DEPTH) -> DataFrame:
    """New order of the first ``depth`` fused candidates by ``score``, then fused rank,
    then id; accepted if the score reaches the threshold in six places."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), "rank", "id")
    out = candidates.where(F.col("rank") <= depth).withColumn("new_rank", F.row_number().over(order))
    accept = F.lit(True) if threshold is None else F.bround(score, 6) >= F.lit(round(threshold, 6))
    return out.withColumn("accepted", accept)


def frozen_page(df: DataFrame, by: list[str], offset: int, size: int) -> DataFrame:
    """An exact slice of a ranked list; beyond its end there is nothing."""
    return df.where((F.col("rank") > offset) & (F.col("rank") <= offset + size))


def with_truncation(df: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group, and whether there were more."""
    kept = df.where(F.col("rank") <= limit + 1)
    more = F.max("rank").over(Window.partitionBy(*by)) > limit
    return kept.withColumn("truncated", more).where(F.col("rank") <= limit)


def first_occurrences(df: DataFrame, by: list[str], key: str, order: str) -> DataFrame:
    """Distinct keys in the order of their first occurrence."""
    return df.groupBy(*by, key).agg(F.min(order).alias(order))


def selected(df: DataFrame, order: list[Column]) -> DataFrame:
    """The one row that a chain of criteria puts first."""
    return df.orderBy(*order).limit(1)


def judged(ranking: DataFrame, qrels: DataFrame, query: str = "query_id") -> DataFrame:
    """Ranked rows with their grade, 0 where not judged."""
    return ranking.join(qrels, [query, "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def quality(ranking: DataFrame, qrels: DataFrame, k: int = 10, relevant: int = 1, query: str = "query_id", topics: DataFrame | None = None) -> DataFrame:
    """recall@k, precision@k, MRR@k and nDCG@k of each query that has a ranking.

    Recall and MRR are 1 where nothing is relevant, nDCG 0 where nothing is judged. Queries
    that are judged alike may share their judgements: with ``topics`` (query, topic), qrels are
    (topic, id, grade), so they are not repeated for each query. Of the ideal rankings
    only how often a query has each grade is shuffled.
    """
    top = ranking.where(F.col("rank") <= k)
    if topics is None:
        top, grades = judged(top, qrels, query), qrels.groupBy(query, "grade").agg(F.count("*").alias("n"))
    else:
        top = judged(top.join(topics, query, "left"), qrels, "topic")
        grades = topics.join(qrels.groupBy("topic", "grade").agg(F.count("*").alias("n")), "topic").groupBy(query, "grade").agg(F.sum("n").alias("n"))
    gain = F.pow(F.lit(2.0), "grade") - 1
    discounted = gain / F.log2(F.col("rank") + 1)
    hit = (F.col("grade") >= relevant).cast("int")
    got = top.groupBy(query).agg(F.sum(hit).alias("hits"), F.min(F.when(hit == 1, F.col("rank"))).alias("first"), F.sum(discounted).alias("dcg"))
    last = F.sum("n").over(Window.partitionBy(query).orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = F.filter(F.sequence(F.lit(1), F.lit(k)), lambda r: (r > F.col("last") - F.col("n")) & (r <= F.col("last")))
    best = F.aggregate(ranks, F.lit(0.0), lambda s, r: s + gain / F.log2(r + 1))
    ideal = grades.withColumn("last", last).groupBy(query).agg(F.sum(F.when(F.size(ranks) > 0, best)).alias("idcg"), F.sum(hit * F.col("n")).alias("relevant"))
    out = got.join(ideal, query, "left")
    none = F.coalesce("relevant", F.lit(0)) == 0
    return out.select(
        query,
        F.bround(F.when(none, 1.0).otherwise(F.col("hits") / F.col("relevant")), 6).alias("recall"),
        F.bround(F.col("hits") / k, 6).alias("precision"),
        F.bround(F.when(none, 1.0).otherwise(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        F.bround(F.when(F.coalesce("idcg", F.lit(0.0)) > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0), 6).alias("ndcg"),
    )


def enriched(ranking: DataFrame, sources: DataFrame, key: str = "id") -> DataFrame:
    """Ranked rows with what they stand for. Every one must have a source."""
    there = sources.withColumn("_there", F.lit(True))
    out = ranking.join(there, key, "left")
    total = F.when(F.col("_there"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("nothing is known of "), F.col(key).cast("string"))))
    return out.withColumn(key, total.cast(ranking.schema[key].dataType)).drop("_there")


def document_page(df: DataFrame, offset: int, size: int) -> DataFrame:
    """A slice of one frozen list of documents; an offset beyond its end is an error."""
    n = df.agg(F.max("rank")).first()[0] or 0
    if offset < 0 or offset >= max(n, 1):
        raise ValueError(f"there are {n} documents")
    return df.where((F.col("rank") > offset) & (F.col("rank") <= offset + size))

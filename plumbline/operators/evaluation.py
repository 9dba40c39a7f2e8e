"""Evaluation: rates, confusion, folds, selectors and regression gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import fold_of


def rate(hit: Column) -> Column:
    return F.bround(F.avg(hit.cast("double")), 6)


def answer_rates(df: DataFrame) -> DataFrame:
    """Citation, support, abstention and false-answer rates of (cited, supported, answered, answerable)."""
    return df.agg(rate(F.col("cited")).alias("citation"), rate(F.col("supported")).alias("support"), rate(~F.col("answered")).alias("abstention"), rate(F.col("answered") & ~F.col("answerable")).alias("false_answer"))


def confusion(gold: DataFrame, found: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """True and false positives and false negatives per group, with precision, recall and F1."""
    a, b = gold.select(*keys).distinct().withColumn("g", F.lit(1)), found.select(*keys).distinct().withColumn("f", F.lit(1))
    both = a.join(b, keys, "full_outer")
    n = both.groupBy(*by).agg(F.sum(F.when(F.col("g").isNotNull() & F.col("f").isNotNull(), 1).otherwise(0)).alias("tp"), F.sum(F.when(F.col("g").isNull(), 1).otherwise(0)).alias("fp"), F.sum(F.when(F.col("f").isNull(), 1).otherwise(0)).alias("fn"))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    p, r = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(p), F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(r)
    return n.select(*by, "tp", "fp", "fn", F.bround(p, 6).alias("precision"), F.bround(r, 6).alias("recall"), F.bround(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def macro(df: DataFrame, category: str, values: list[str]) -> DataFrame:
    """Mean of each metric per category."""
    return df.groupBy(category).agg(*(F.bround(F.avg(v), 6).alias(v) for v in values), F.count("*").alias("n"))


def folded(df: DataFrame, key: str, folds: int = 5) -> DataFrame:
    return df.withColumn("fold", fold_of(F.col(key), folds))


def thresholds(df: DataFrame, candidates: list[float], score: str, relevant: str) -> DataFrame:
    """Per fold and threshold: kept rows, kept relevant ones, and the rejection rate of the rest."""
    grid = F.explode(F.array(*map(F.lit, candidates))).alias("threshold")
    t = df.select("fold", F.bround(score, 6).alias("s"), F.col(relevant).cast("int").alias("r"), grid)
    keep = F.col("s") >= F.col("threshold")
    return t.groupBy("fold", "threshold").agg(F.sum(keep.cast("int")).alias("kept"), F.sum((keep & (F.col("r") == 1)).cast("int")).alias("kept_relevant"), F.bround(F.avg(F.when(F.col("r") == 0, (~keep).cast("double"))), 6).alias("rejection"))


def chosen_threshold(table: DataFrame, held_out: int, least_recall: float = 0.0) -> DataFrame:
    """Choose on all folds but one: highest rejection first, then recall, then the lower threshold."""
    rest = table.where(F.col("fold") != held_out).groupBy("threshold").agg(F.sum("kept_relevant").alias("kept_relevant"), F.bround(F.avg("rejection"), 6).alias("rejection"))
    return rest.orderBy(F.desc("rejection"), F.desc("kept_relevant"), "threshold").limit(1)


def graded(facets: list[tuple[str, Column]], should: list[Column]) -> Column:
    """Relevance 3, 2, 1 or 0 from failures of must and should facets."""
    must = sum((F.when(c, 0).otherwise(1) for _, c in facets), F.lit(0))
    soft = sum((F.when(c, 0).otherwise(1) for c in should), F.lit(0))
    return F.when((must == 0) & (soft == 0), 3).when(must == 0, 2).when(must == 1, 1).otherwise(0)


_COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "ge": lambda a, b: a >= b, "gt": lambda a, b: a > b, "le": lambda a, b: a <= b, "lt": lambda a, b: a < b}


def gates(measured: dict, policy: list[tuple[str, str, float]], pins: dict[str, tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """Failures of a regression policy (metric, comparator, bound). Pinned checksums
    come first: if one is off, no metric is looked at."""
    broken = [(name, "pin") for name, (want, have) in (pins or {}).items() if want != have]
    if broken:
        return broken
    return [(m, op) for m, op, bound in policy if m not in measured or not _COMPARE[op](measured[m], bound)]


def dimension_choice(rows: list[dict], queries: int) -> dict:
    """The dimension whose quality is within 1/(2n) of the best, then the least latency, size and dimension."""
    best = max(r["ndcg"] for r in rows)
    near = [r for r in rows if r["ndcg"] >= best - 1 / (2 * queries)]
    return min(near, key=lambda r: (r["p95"], r["bytes"], r["dim"]))


def routing_accuracy(df: DataFrame, found: str = "found", expected: str = "expected") -> DataFrame:
    """Share of questions that took the expected route; without a question it is an error."""
    hit = F.avg(F.col(found).eqNullSafe(F.col(expected)).cast("double"))
    some = F.when(F.count("*") > 0, F.bround(hit, 6)).otherwise(F.raise_error(F.lit("there are no questions")).cast("double"))
    return df.agg(some.alias("accuracy"))


def no_false_positives(found: DataFrame, relevant: DataFrame, key: str) -> DataFrame:
    """Whether all that was found is relevant."""
    return found.join(relevant, key, "left_anti").agg((F.count("*") == 0).alias("correct"))


def pagination_integrity(pages: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Whether pages hold every expected id, each once, and no other."""
    held = pages.groupBy(key).agg(F.count("*").alias("times")).join(expected.select(key).distinct().withColumn("wanted", F.lit(True)), key, "full")
    wrong = F.coalesce(F.col("times"), F.lit(0)) != F.when(F.col("wanted"), 1).otherwise(0)
    return held.agg((F.count(F.when(wrong, 1)) == 0).alias("sound"))


def aggregation_exact(found: DataFrame, expected: DataFrame, key: str = "key", n: str = "n") -> DataFrame:
    """Whether two aggregations have the same buckets with the same counts."""
    both = found.select(key, n).join(expected.select(key, F.col(n).alias("_n")), key, "full")
    return both.agg((F.count(F.when(~F.col(n).eqNullSafe(F.col("_n")), 1)) == 0).alias("exact"))


def linking_score(produced: DataFrame, gold: DataFrame, methods: list[str]) -> DataFrame:
    """One row: false_positive_rate, recall and precision_<method> of links (case_id,
    element_id, method, spans) against gold. A link is right if all four agree; a
    method that made no link has precision 1."""
    keys = ["case_id", "element_id", "method", "spans"]
    wanted = gold.select(*keys).distinct().withColumn("wanted", F.lit(True))
    both = produced.select(*keys).distinct().withColumn("made", F.lit(True)).join(wanted, keys, "full")
    made, right = F.coalesce(F.col("made"), F.lit(False)), F.coalesce(F.col("made") & F.col("wanted"), F.lit(False))
    share = lambda a, b, none: F.bround(F.when(F.count_if(b) > 0, F.count_if(a) / F.count_if(b)).otherwise(none), 6)
    own = [share(right & (F.col("method") == m), made & (F.col("method") == m), 1.0).alias(f"precision_{m}") for m in methods]
    return both.agg(share(made & ~right, made, 0.0).alias("false_positive_rate"), share(right, F.coalesce(F.col("wanted"), F.lit(False)), 0.0).alias("recall"), *own)

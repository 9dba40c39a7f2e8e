"""Choosing an acceptance threshold out of fold, over every score that occurs.

What a query's list is worth at a threshold changes only at scores of its own, so each
list gives some steps; their sums, taken from the highest score down, give every fold's
means at every threshold in one window. Scores have six places, so there are a million
thresholds at most, whatever the number of lists. Sums are decimal: they don't depend on
the order in which lists come.

A threshold is feasible if in each training fold neither recall nor nDCG at 10 falls
below those without a threshold. Of these the safest wins: the margins of the worst fold,
then of all, then what rejects least, then the lowest; F1 comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.work import Work

#: Places that count, least grade that is relevant, number of folds. Fixed values.
K, RELEVANT, FOLDS = 10, 2, 5
_MEASURES = ["f1", "recall", "ndcg", "rejected", "accepted", "empty"]
_EXACT = "decimal(38,18)"


def _gain(grade: Column, rank: Column) -> Column:
    return F.when(rank <= K, (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)).otherwise(0.0)


def steps(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """What each list is worth once all with at least a score are accepted: query_id,
    fold, score, and f1, recall, ndcg, rejected (share), accepted (number), empty.

    candidates: query_id, rank, score, grade, in lists of bounded length. queries: query_id,
    fold, relevant_total, ideal_grades. Of equal scores all are accepted. Lists without
    candidates, and queries to which nothing is relevant, can't be judged and aren't here.
    """
    ideal = F.aggregate(F.transform("ideal_grades", lambda g, k: _gain(g, k + 1)), F.lit(0.0), lambda a, x: a + x).alias("ideal")  # once for a query
    scored = candidates.withColumn("score", F.bround("score", 6)).join(queries.where("relevant_total > 0").select("query_id", "fold", "relevant_total", ideal), "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    scored = scored.withColumn("place", F.row_number().over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    relevant = F.col("grade") >= RELEVANT
    of_score = F.lead("place").over(order).isNull() | ~F.lead("score").over(order).eqNullSafe(F.col("score"))
    sums = scored.select(
        "query_id", "fold", "score", "place", "relevant_total", "ideal", of_score.alias("last"), F.count("*").over(Window.partitionBy("query_id")).alias("m"), F.sum(relevant.cast("int")).over(upto).alias("true"),
        F.sum((relevant & (F.col("place") <= K)).cast("int")).over(upto).alias("near"), F.sum(_gain(F.col("grade"), F.col("place"))).over(upto).alias("dcg"),
    )
    ends = sums.where("last")
    precision, recall = F.col("true") / F.col("place"), F.col("true") / F.col("relevant_total")
    f1 = F.when(F.col("true") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    exact = lambda c, name: c.cast(_EXACT).alias(name)
    return ends.select(
        "query_id", "fold", "score", exact(f1, "f1"), exact(F.col("near") / F.col("relevant_total"), "recall"), exact(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0), "ndcg"),
        exact((F.col("m") - F.col("place")) / F.col("m"), "rejected"), exact(F.col("place"), "accepted"), exact(F.lit(0), "empty"),
    )


def fold_means(levels: DataFrame) -> DataFrame:
    """Means of every fold at every score that occurs in any, and without a threshold
    (score null): fold, score, f1, recall, ndcg, rejected in six places, n."""
    before = Window.partitionBy("query_id").orderBy(F.desc("score"))
    start = {m: F.lit(1 if m in ("rejected", "empty") else 0).cast(_EXACT) for m in _MEASURES}
    change = levels.select("fold", "score", *((F.col(m) - F.coalesce(F.lag(m).over(before), start[m])).cast(_EXACT).alias(m) for m in _MEASURES))
    summed = change.groupBy("fold", "score").agg(*(F.sum(m).cast(_EXACT).alias(m) for m in _MEASURES))
    n = levels.groupBy("fold").agg(F.count_distinct("query_id").alias("n"))
    # folds and scores are both bounded by what they are
    grid = levels.select("score").distinct().crossJoin(F.broadcast(n))
    down = Window.partitionBy("fold").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    at = grid.join(summed, ["fold", "score"], "left")
    mean = lambda m: F.bround(F.coalesce(F.sum(m).over(down).cast("double"), F.lit(0.0)) / F.col("n") + start[m].cast("double"), 6).alias(m)
    means = at.select("fold", "score", *map(mean, _MEASURES[:4]), "n")
    last = means.groupBy("fold").agg(F.min_by(F.struct(*_MEASURES[:4], "n"), "score").alias("x")).select("fold", F.lit(None).cast("double").alias("score"), "x.*")  # the lowest score accepts all
    return means.unionByName(last)


def _mean_of_rounded(c: str) -> Column:
    """The mean, in six places, of values that have six: in millionths, where ties are exact."""
    return F.bround(F.sum(F.round(F.col(c) * 1_000_000).cast("bigint")) / F.count(c)) / 1_000_000


def selections(levels: DataFrame, means: DataFrame, folds: int = FOLDS) -> DataFrame:
    """The threshold chosen without each fold, and with all (held_out -1): held_out, mode,
    threshold, candidates, eligible, and the margins, rejection and F1 that decided.

    Candidates are the scores of the training folds, and none at all. A fold without lists
    takes no part. If even no threshold weren't feasible the figures would contradict
    themselves; as it always is, there is always a choice.
    """
    anchor = means.where("score IS NULL").select("fold", F.col("recall").alias("a_recall"), F.col("ndcg").alias("a_ndcg"))
    margin = means.join(F.broadcast(anchor), "fold").select("fold", "score", "f1", "rejected", F.bround(F.col("recall") - F.col("a_recall"), 6).alias("recall"), F.bround(F.col("ndcg") - F.col("a_ndcg"), 6).alias("ndcg"))
    without = F.explode(F.filter(F.sequence(F.lit(-1), F.lit(folds - 1)), lambda h: h != F.col("fold"))).alias("held_out")
    own = levels.select("fold", "score").distinct().select("score", without).distinct()
    trained = margin.select("*", without).groupBy("held_out", "score").agg(
        F.min("recall").alias("least_recall"), F.min("ndcg").alias("least_ndcg"), *(_mean_of_rounded(c).alias(f"macro_{c}") for c in ("recall", "ndcg", "f1")), _mean_of_rounded("rejected").alias("rejection")
    )
    trained = trained.join(own.withColumn("seen", F.lit(True)), ["held_out", "score"], "left").where("score IS NULL OR seen")
    feasible = (F.col("least_recall") >= 0) & (F.col("least_ndcg") >= 0)
    key = F.struct(
        -F.col("least_recall"), -F.col("least_ndcg"), -F.col("macro_recall"), -F.col("macro_ndcg"), F.col("rejection"), F.col("score").isNotNull().cast("int"), F.coalesce("score", F.lit(0.0)), -F.col("macro_f1")
    )
    told = F.struct("score", "least_recall", "least_ndcg", "macro_recall", "macro_ndcg", "rejection", "macro_f1")
    best = trained.groupBy("held_out").agg(F.count("*").alias("candidates"), F.count_if(feasible).alias("eligible"), F.min_by(told, F.when(feasible, key)).alias("t"))
    return best.select("held_out", F.when(F.col("t.score").isNull(), "accept_all").otherwise("numeric").alias("mode"), F.col("t.score").alias("threshold"), "candidates", "eligible", "t.least_recall", "t.least_ndcg", "t.macro_recall", "t.macro_ndcg", "t.rejection", "t.macro_f1")


def held_out(levels: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every query judged at the threshold that was chosen without its fold: query_id, fold,
    threshold, the measures there, and recall and ndcg without a threshold."""
    last = Window.partitionBy("query_id").orderBy("score")
    all_ = levels.withColumn("place", F.row_number().over(last)).where("place = 1").select("query_id", "fold", F.col("recall").alias("all_recall"), F.col("ndcg").alias("all_ndcg"))
    cut = chosen.where("held_out >= 0").select(F.col("held_out").alias("fold"), "threshold")
    at = levels.join(F.broadcast(cut), "fold").where("threshold IS NULL OR score >= threshold").groupBy("query_id").agg(F.min_by(F.struct(*_MEASURES), "score").alias("x"))
    out = all_.join(F.broadcast(cut), "fold").join(at, "query_id", "left")
    nothing = {m: F.lit(1 if m in ("rejected", "empty") else 0).cast(_EXACT) for m in _MEASURES}
    return out.select("query_id", "fold", "threshold", *(F.coalesce(F.col(f"x.{m}"), nothing[m]).alias(m) for m in _MEASURES), "all_recall", "all_ndcg")


def protocol(candidates: DataFrame, queries: DataFrame, folds: int = FOLDS) -> tuple[DataFrame, DataFrame]:
    """The selections, and one row of the outcome: recall, ndcg, f1, empty (queries of which
    nothing is accepted) out of fold, recall_all and ndcg_all without thresholds, passed, mode
    and threshold.

    The gate passes if neither measure is worse than without; only then the threshold
    chosen with all folds is the outcome. Without a list that can be judged it is an error.
    """
    work = Work(candidates.sparkSession)
    levels = work.written(steps(candidates, queries), "steps")
    chosen = work.written(selections(levels, work.written(fold_means(levels), "means"), folds), "chosen")
    mean = lambda c: F.bround(F.sum(c).cast("double") / F.count(c), 6)
    one = held_out(levels, chosen).agg(*(mean(m).alias(m) for m in ("recall", "ndcg", "f1")), F.sum("empty").cast("bigint").alias("empty"), mean("all_recall").alias("recall_all"), mean("all_ndcg").alias("ndcg_all"), F.count("*").alias("n"))
    passed = F.when(F.col("n") > 0, (F.col("recall") >= F.col("recall_all")) & (F.col("ndcg") >= F.col("ndcg_all"))).otherwise(F.raise_error(F.lit("no list can be judged")).cast("boolean"))
    final = chosen.where("held_out = -1").agg(F.max("mode").alias("mode"), F.max("threshold").alias("threshold"))  # one row
    out = one.withColumn("passed", passed).crossJoin(F.broadcast(final))
    return chosen, out.select("recall", "ndcg", "f1", "empty", "recall_all", "ndcg_all", "passed", F.when(F.col("passed"), F.col("mode")).alias("mode"), F.when(F.col("passed"), F.col("threshold")).alias("threshold"))

"""Benchmarks of graph extraction: exact sets, boundaries of a tolerance, determinism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import digests

#: Tasks that relations are dealt to.
TASKS = 192


def ratio(hits: Column, total: Column) -> Column:
    """hits / total in six places; over nothing it is an error, never a perfect score."""
    return F.when(total > 0, F.bround(hits / total, 6)).otherwise(F.raise_error(F.lit("a ratio over an empty population")).cast("double"))


def _or(hits: Column, total: Column, none: float) -> Column:
    return F.when(total > 0, F.bround(hits / total, 6)).otherwise(none)


def tolerance_metrics(gold: DataFrame, produced: DataFrame, keys: list[str]) -> DataFrame:
    """Per predicate and tolerance how produced relations (predicate, tolerance, keys) agree
    with what is expected (the same and expected): support, tp, fp, fn, tn, precision,
    recall, f1, accuracy, boundary, boundary_accuracy.

    The boundary is made of relations whose expectation changes with the tolerance; where
    there is none its accuracy is 1. What is produced and not in gold isn't counted; repeated
    rows of either side count once. A null expectation is one of absence.
    """
    row = ["predicate", "tolerance", *keys]
    asked = gold.select(*row, F.coalesce("expected", F.lit(False)).alias("expected"), F.lit(True).alias("asked"), F.lit(False).alias("present"))
    made = produced.where(" AND ".join(f"`{c}` IS NOT NULL" for c in row)).select(*row, F.lit(False).alias("expected"), F.lit(False).alias("asked"), F.lit(True).alias("present"))
    # a null is equal to nothing; both sides are shuffled once, by what a relation is at every tolerance
    met = asked.unionByName(made).repartition(TASKS, "predicate", *keys).groupBy(*row).agg(*(F.max(c).alias(c) for c in ("expected", "asked", "present")))
    both = met.where("asked")
    same = Window.partitionBy("predicate", *keys)  # one row for each tolerance
    both = both.withColumn("boundary", F.min("expected").over(same) != F.max("expected").over(same))
    e, p = F.col("expected"), F.col("present")
    n = both.groupBy("predicate", "tolerance").agg(
        F.count("*").alias("support"), F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"), F.count_if(~e & ~p).alias("tn"), F.count_if("boundary").alias("boundary"), F.count_if(F.col("boundary") & (e == p)).alias("_hits")
    )
    n = n.withColumn("precision", _or(F.col("tp"), F.col("tp") + F.col("fp"), 1.0)).withColumn("recall", _or(F.col("tp"), F.col("tp") + F.col("fn"), 1.0))
    f1 = F.when(F.col("tp") + F.col("fp") + F.col("fn") == 0, 1.0).when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(F.bround(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")), 6))
    return n.select("predicate", "tolerance", "support", "tp", "fp", "fn", "tn", "precision", "recall", f1.alias("f1"), ratio(F.col("tp") + F.col("tn"), F.col("support")).alias("accuracy"), "boundary", _or(F.col("_hits"), F.col("boundary"), 1.0).alias("boundary_accuracy"))


def exact_sets(expected: DataFrame, produced: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row for records by id: expected, produced, matched, lost, invented, repeated,
    precision, recall, and the share of matched records that agree in each of ``values``.

    Repeated ids are told and count once, as the first in the order of their values; without
    anything expected or produced it is an error.
    """
    one = lambda df, side: df.groupBy(key).agg(F.count("*").alias(f"_n{side}"), F.min(F.struct(*values)).alias(f"_v{side}"))
    both = one(expected, "e").join(one(produced, "p"), key, "full")
    e, p = F.col("_ne").isNotNull(), F.col("_np").isNotNull()
    agree = [F.count_if(e & p & F.col(f"_ve.{v}").eqNullSafe(F.col(f"_vp.{v}"))).alias(f"_{v}") for v in values]
    n = both.agg(F.count_if(e).alias("expected"), F.count_if(p).alias("produced"), F.count_if(e & p).alias("matched"), F.count_if(e & ~p).alias("lost"), F.count_if(p & ~e).alias("invented"), F.coalesce(F.sum(F.col("_np") - 1), F.lit(0)).alias("repeated"), *agree)
    shares = [_or(F.col(f"_{v}"), F.col("matched"), 0.0).alias(f"{v}_accuracy") for v in values]
    return n.select("expected", "produced", "matched", "lost", "invented", "repeated", ratio(F.col("matched"), F.col("produced")).alias("precision"), ratio(F.col("matched"), F.col("expected")).alias("recall"), *shares)


def determinism(runs: dict[str, DataFrame]) -> DataFrame:
    """(run, n, digest, same): whether each run gives the rows of the first, in whatever
    order. Every run is executed once, as one aggregation."""
    first, out = next(iter(runs)), None
    for name, df in runs.items():
        one = digests.digest(df.select(*sorted(df.columns))).select(F.lit(name).alias("run"), "n", "digest")
        out = one if out is None else out.unionByName(one)
    wanted = F.max(F.when(F.col("run") == first, F.col("digest"))).over(Window.partitionBy(F.lit(1)))  # a row for each run
    return out.withColumn("same", F.col("digest") == wanted)

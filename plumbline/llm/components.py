"""Connected components of a link table, as DataFrame joins and aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, hot_keys, joined_apart, joined_by_hot, written

#: Beyond so many rounds something is wrong: each one at least halves the distances.
MAX_ROUNDS = 60


def components(spark: SparkSession, links: DataFrame, of: list[DataFrame] | None = None) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the smallest node reachable.

    Each round every node takes the smallest label among its neighbours and its
    own, and then the label of its label, so paths shorten fast. Labels are
    written to the shared folder each round, which keeps plans short. Links may be
    repeated, in either direction or from a node to itself; no links give no rows.
    ``of``: the work tables that hold the links, if they are such.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = written(spark, both, "edges", of)
    labels = written(spark, edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels", [edges])
    hubs = hot_keys(spark, edges, ["b"])  # edges stay the same, so these do
    for _ in range(MAX_ROUNDS):
        seen = joined_apart(edges, labels.select(F.col("node").alias("b"), "component"), ["b"], hubs)
        near = seen.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        taken = labels.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "seen").alias("mid"))
        taken = written(spark, taken, "taken", [labels])
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("further"))
        stepped = joined_by_hot(spark, taken, jump, ["mid"], "left").select("node", "before", F.least("mid", F.coalesce("further", "mid")).alias("component"))
        stepped = written(spark, stepped, "labels", [labels])
        dropped(taken, labels)
        if stepped.where(F.col("before") != F.col("component")).isEmpty():
            dropped(edges)
            out = stepped.select("node", "component")
            out.work_path, out.work_bytes = stepped.work_path, stepped.work_bytes
            return out
        labels = stepped
    raise RuntimeError("components did not settle")


def merged(spark: SparkSession, labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels``, the components of some links, with ``links`` (a, b) added, a work table: only
    these are followed, from component to component."""
    if links.isEmpty():
        return labels
    side = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    ends = joined_by_hot(spark, links.select("a", "b"), side("a"), ["a"], "left").join(side("b"), "b", "left")
    ends = written(spark, ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")), "ends", [links])
    found = components(spark, ends, [ends])
    further = joined_by_hot(spark, labels, found.select(F.col("node").alias("component"), F.col("component").alias("further")), ["component"], "left")
    further = further.select("node", F.coalesce("further", "component").alias("component"))
    return written(spark, further.unionByName(found.join(labels, "node", "left_anti")), "merged", [labels, found])


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A common row number for connected rows."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label

"""Shortest paths and containment: breadth-first search from both ends, for many pairs at once.

Anchors go forward and targets go back, a hop further at a time by one join, always on the
side whose next hop has fewer edges; a pair is met where the two sides share a node. So a
path of four hops costs the square of the edges at a node for each end, and not their
fourth power. A node is entered once for each end, at its least distance, with the number
of ways that lead there: edges are never kept. Edges of hubs are dealt over several keys,
and the frontier is copied to them. A pair that is met asks for nothing more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.graph import MAX_DEPTH, SPATIAL
from plumbline.sources.work import Work

#: Edges of a node under one key.
HUB = 10_000


class _Steps:
    """Edges in one direction as (node, part, next, edge_id), the number of edges of each
    node, and the nodes whose edges lie in several parts."""

    def __init__(self, work: Work, edges: DataFrame, forward: bool, hub: int) -> None:
        near, far = ("src", "dst") if forward else ("dst", "src")
        steps = edges.select(F.col(near).alias("node"), F.col(far).alias("next"), "edge_id").where("node IS NOT NULL AND next IS NOT NULL")
        self.sizes = work.written(steps.groupBy("node").agg(F.count("*").alias("edges")), "sizes")
        self.hubs = work.written(self.sizes.where(F.col("edges") > hub).select("node", F.ceil(F.col("edges") / hub).cast("int").alias("parts")), "hubs")
        part = F.pmod(F.xxhash64("edge_id"), F.coalesce("parts", F.lit(1))).cast("int")
        self.rows = work.written(steps.join(self.hubs, "node", "left").select("node", part.alias("part"), "next", "edge_id"), "steps")

    def hop(self, front: DataFrame) -> DataFrame:
        """(node, next, edge_id, and what else the frontier has)."""
        part = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        return front.join(self.hubs, "node", "left").withColumn("part", part).drop("parts").join(self.rows, ["node", "part"]).drop("part")

    def cost(self, front: DataFrame) -> int:
        """Edges that the next hop of a frontier meets."""
        return front.join(self.sizes, "node").agg(F.sum("edges")).first()[0] or 0


class _Side:
    """What has been entered from one end: for each hop (end, node, ways)."""

    def __init__(self, work: Work, steps: _Steps, ends: DataFrame, name: str) -> None:
        self._work, self._steps, self._name = work, steps, name
        start = ends.select(F.col("end"), F.col("end").alias("node"), F.lit(1).cast("decimal(38,0)").alias("ways")).distinct()
        self.levels, self._front = [start], start

    def cost(self) -> int:
        return self._steps.cost(self._front)

    def further(self) -> None:
        reached = self._steps.hop(self._front).groupBy("end", F.col("next").alias("node")).agg(F.sum("ways").cast("decimal(38,0)").alias("ways"))
        if len(self.levels) > 1:
            reached = reached.join(reduce(DataFrame.unionByName, (level.select("end", "node") for level in self.levels[1:])), ["end", "node"], "left_anti")
        self.levels.append(self._work.written(reached, f"{self._name}{len(self.levels)}"))
        self._front = self.levels[-1]

    def keep(self, ends: DataFrame) -> None:
        """Ends that no pair asks for any longer go no further."""
        self._front = self.levels[-1].join(ends.select("end").distinct(), "end", "left_semi")

    def copies(self, pairs: DataFrame, column: str) -> int:
        """Rows that the pairs have with what was entered last."""
        sizes = self.levels[-1].groupBy("end").agg(F.count("*").alias("n"))
        return pairs.join(sizes.withColumnRenamed("end", column), column).agg(F.sum("n")).first()[0] or 0


def _shared(open_: DataFrame, ahead: _Side, back: _Side) -> DataFrame:
    """Nodes where open pairs meet: (anchor, target, node, n_paths)."""
    here = {"anchor": ahead.levels[-1].toDF("anchor", "node", "from_anchor"), "target": back.levels[-1].toDF("target", "node", "to_target")}
    first, then = ("anchor", "target") if ahead.copies(open_, "anchor") < back.copies(open_, "target") else ("target", "anchor")
    met = open_.join(here[first], first).join(here[then], [then, "node"])
    return met.select("anchor", "target", "node", (F.col("from_anchor").cast("decimal(38,0)") * F.col("to_target")).cast("decimal(38,0)").alias("n_paths"))


def _search(work: Work, edges: DataFrame, pairs: DataFrame, depth: int, direction: str, hub: int) -> tuple[DataFrame, list, list[_Steps], list[_Side]]:
    """Pairs, the nodes where pairs of each length are met (hops, hops of the anchors' side,
    DataFrame), and both sides' edges and levels."""
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError("depth out of range")
    pairs = work.written(pairs.select("anchor", "target").distinct(), "pairs")
    steps = [_Steps(work, edges, (direction == "forward") == ahead, hub) for ahead in (True, False)]
    open_ = work.written(pairs.where("anchor IS NOT NULL AND target IS NOT NULL"), "open0")
    ends = [open_.select(F.col(c).alias("end")) for c in ("anchor", "target")]
    sides = [_Side(work, s, e, n) for s, e, n in zip(steps, ends, ("ahead", "back"), strict=True)]
    met = []
    for hops in range(1, depth + 1):
        costs = [side.cost() for side in sides]
        if not min(costs):  # one side is at its end, so no longer path has both
            break
        sides[costs[1] < costs[0]].further()
        shared = work.written(_shared(open_, *sides), f"met{hops}")
        met.append((hops, len(sides[0].levels) - 1, shared))
        if hops < depth:
            open_ = work.written(open_.join(shared, ["anchor", "target"], "left_anti"), f"open{hops}")
            for side, column in zip(sides, ("anchor", "target"), strict=True):
                side.keep(open_.select(F.col(column).alias("end")))
    return pairs, met, steps, sides


def searched(edges: DataFrame, pairs: DataFrame, depth: int = MAX_DEPTH, direction: str = "forward", hub: int = HUB) -> tuple[DataFrame, list[DataFrame]]:
    """Distances of pairs (anchor, target), and the nodes where they are met.

    Returns (anchor, target, hops, n_paths), hops null where the target is farther than
    ``depth`` or nowhere, and for each length (anchor, target, node, n_paths). A path has
    one hop at least: an anchor is its own target by a cycle. Parallel edges make paths of
    their own. Repeated pairs are one; null ends match nothing.
    """
    asked, met, _, _ = _search(Work(edges.sparkSession), edges, pairs, depth, direction, hub)
    found = [df.groupBy("anchor", "target").agg(F.sum("n_paths").cast("decimal(38,0)").alias("n_paths")).withColumn("hops", F.lit(hops)) for hops, _, df in met]
    if not found:
        return asked.select("*", F.lit(None).cast("int").alias("hops"), F.lit(None).cast("decimal(38,0)").alias("n_paths")), []
    return asked.join(reduce(DataFrame.unionByName, found), ["anchor", "target"], "left").select("anchor", "target", "hops", "n_paths"), [df for _, _, df in met]


def _nearer(ways: DataFrame, end: str, level: DataFrame, steps: _Steps, back: _Steps) -> DataFrame:
    """Ways one hop nearer to their end: ``level`` is what is entered from it just before.
    ``steps`` lead away from the end and ``back`` to it; the fewer edges are read."""
    level = level.select(F.col("end").alias(end), F.col("node").alias("next")).join(ways.select(end).distinct(), end, "left_semi")
    if back.cost(ways) <= steps.cost(level.withColumnRenamed("next", "node")):
        return back.hop(ways).drop("node").join(level, [end, "next"], "left_semi").withColumnRenamed("next", "node")
    out = steps.hop(level.withColumnRenamed("next", "node")).withColumnRenamed("node", "before").withColumnRenamed("next", "node")
    return ways.join(out, [end, "node"]).drop("node").withColumnRenamed("before", "node")


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = MAX_DEPTH, direction: str = "forward", hub: int = HUB) -> DataFrame:
    """All shortest paths of the pairs that are met: (anchor, node, hops, node_ids,
    edge_ids), node being the target, ready to be ranked. Read from the nodes where both
    sides meet to either end, so nothing that leads elsewhere is built."""
    work = Work(edges.sparkSession)
    asked, met, (ahead, back), sides = _search(work, edges, pairs, depth, direction, hub)
    nothing = F.array().cast("array<string>")
    out = asked.limit(0).select("anchor", F.col("target").alias("node"), F.lit(0).alias("hops"), nothing.alias("node_ids"), nothing.alias("edge_ids"))
    for hops, split, shared in met:
        if shared.isEmpty():
            continue
        ways = shared.select("anchor", "target", "node", F.col("node").alias("middle"), F.array("node").alias("node_ids"), nothing.alias("edge_ids"))
        for level in reversed(sides[0].levels[:split]):
            ways = _nearer(ways, "anchor", level, ahead, back)
            ways = ways.select("anchor", "target", "node", "middle", F.concat(F.array("node"), "node_ids").alias("node_ids"), F.concat(F.array("edge_id"), "edge_ids").alias("edge_ids"))
        ways = ways.withColumn("node", F.col("middle"))
        for level in reversed(sides[1].levels[: hops - split]):
            ways = _nearer(ways, "target", level, back, ahead)
            ways = ways.select("anchor", "target", "node", "middle", F.concat("node_ids", F.array("node")).alias("node_ids"), F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"))
        ways = work.written(ways.select("anchor", F.col("target").alias("node"), F.lit(hops).alias("hops"), "node_ids", "edge_ids"), f"paths{hops}")
        out = out.unionByName(ways)
    return out


def containment(edges: DataFrame, pairs: DataFrame, depth: int = MAX_DEPTH, predicates: list[str] | None = None) -> DataFrame:
    """Whether each pair's target lies in its anchor, by the spatial hierarchy: (anchor,
    target, contained, hops)."""
    chosen = predicates or SPATIAL
    if any(p not in SPATIAL for p in chosen):
        raise ValueError("predicate not allowed for this intent")
    met, _ = searched(edges.where(F.col("predicate").isin(chosen)), pairs, depth)
    return met.select("anchor", "target", F.col("hops").isNotNull().alias("contained"), "hops")


def numbered(paths: DataFrame) -> DataFrame:
    """Paths of each pair in their total order, with a rank from 1."""
    order = Window.partitionBy("anchor", "node").orderBy("hops", "edge_ids", "node_ids")
    return paths.withColumn("rank", F.row_number().over(order))

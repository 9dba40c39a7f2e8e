"""Mixing sources to target weights, by Sainte-Laguë apportionment of blocks.

Each source gets a target: its share by weight of all words, at most so many times
what it has, the rest shared again among the others. A source lies in shards of
bounded size (a source of any size has as many as it needs); a shard's words, laid
end to end, are cut into blocks of equal length, to a word. The blocks of the mix
go to the sources' shards by highest quotients votes / 1, votes / 3, votes / 5 ...,
where a shard's votes are the blocks that its part of the target comes to. Within a
shard the quota takes all blocks as often as it goes, and a seeded choice of them
once more.

Quotients are never listed: a threshold is searched whose count of quotients is the
number of blocks, each step an aggregation over the shards, and what ties there are
at the threshold is settled by rank. Sources, shards and rows are all counted,
ranked and joined as tables; the driver holds sums.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_by_hot, written

#: Weights of the sources in order, repeated.
WEIGHTS = (5.0, 2.0, 1.0)
#: How often a source may be repeated at most.
REPEATS = 3
#: Words in a block. A source is off its target by half a block for each of its
#: shards at most; blocks cost nothing, they are counted and not listed.
BLOCK_WORDS = 16
#: Words and rows of a source in one shard, about.
SHARD_WORDS, SHARD_ROWS = 1 << 18, 1 << 12
SEED = 11
#: Thresholds that one aggregation tries.
TRIED = 32
#: Equal rows that are told apart at once.
COPIES = 1 << 12


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words) of every row; a null text has none."""
    words = F.regexp_count("text", F.lit("[^ \\t-\\r]+"))
    return docs.select("doc_id", "source", F.coalesce(words, F.lit(0)).cast("bigint").alias("size"))


def ranked(spark: SparkSession, df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with a column rank, from 0, in an order without ties. Sorted over all
    tasks and numbered within each; what comes before is a count for each task."""
    task = F.shiftright("at", 33)
    placed = written(spark, df.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    before, starts = 0, []
    for row in placed.groupBy(task.alias("task")).count().orderBy("task").collect():  # a row for each task
        starts.append((row["task"], before - (row["task"] << 33)))
        before += row["count"]
    starts = spark.createDataFrame(starts, "task bigint, shift bigint")
    return placed.withColumn("task", task).join(F.broadcast(starts), "task").withColumn("rank", F.col("at") + F.col("shift")).drop("task", "at", "shift")


def with_targets(spark: SparkSession, sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Sources (key, source, source_size and more) with a target.

    Weights follow the order of code points, null last. A target is weight times a
    common level, at most ``repeats`` times the size; the level rises until the
    targets come to the size of all.
    """
    weight = F.get(F.array(*map(F.lit, weights)), F.col("rank") % len(weights))
    table = written(spark, ranked(spark, sources, F.col("source").isNull(), F.col("source")).withColumn("weight", weight), "weights")
    most = repeats * F.col("source_size").cast("double")
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, None
    while True:  # a source that has reached its most stays there: the level only rises
        below = most <= F.col("weight") * level
        held, n, free = table.agg(F.sum(F.when(below, most)), F.count(F.when(below, 1)), F.sum(F.when(~below, F.col("weight")))).first()
        if n == capped or not free:
            break
        level, capped = (total - (held or 0.0)) / free, n
    return table.withColumn("target", F.least(most, F.col("weight") * level))


def apportioned(spark: SparkSession, cells: DataFrame, tie: list[str]) -> DataFrame:
    """``cells`` (votes, most and more; a written table) with quota: the whole number
    of votes in seats, given to the highest quotients votes / (2 k + 1), k under
    ``most``. Equal quotients go in the order of ``tie``, which names a key."""
    votes = F.col("votes")
    seats = round(cells.agg(F.sum("votes")).first()[0] or 0.0)
    given = lambda q: F.least("most", F.floor((votes / q + 1) / 2)).cast("bigint")
    high, low = 1.0, 0.25  # half a seat is where quotas are plainly rounded votes
    count = lambda *qs: [r or 0 for r in cells.agg(*(F.sum(given(q)).alias(f"n{k}") for k, q in enumerate(qs))).first()]
    while count(high)[0] > seats:
        high *= 16
    while count(low)[0] < seats:
        low /= 16
    while (cells.agg(F.max(given(low) - given(high))).first()[0] or 0) > 1:
        tries = sorted({*np.geomspace(low, high, TRIED).tolist(), low, high})
        found = count(*tries)
        at = max(k for k, n in enumerate(found) if n >= seats)
        if (tries[at], tries[min(at + 1, len(tries) - 1)]) == (low, high):  # as near as doubles come
            break
        low, high = tries[at], tries[min(at + 1, len(tries) - 1)]
    some = cells.withColumn("quota", given(high)).withColumn("next", given(low) > given(high))
    left = seats - count(high)[0]
    quotient = votes / (2 * F.col("quota") + 1)
    order = ranked(spark, some, F.desc("next"), F.desc(quotient), *tie)
    return order.withColumn("quota", F.col("quota") + (F.col("next") & (F.col("rank") < left)).cast("bigint")).drop("next", "rank")


def _taken(seed: int):
    """For the rows of one shard what the mix takes of each."""

    def of_shard(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("size", "ascending"), ("copy", "ascending")])
        size = rows["size"].to_numpy()
        ends = np.cumsum(size)
        total, blocks, quota = int(ends[-1]), rows["blocks"][0].as_py(), rows["quota"][0].as_py()
        if not blocks:
            taken, spans = np.zeros(len(size), np.int64), pa.array([[]] * len(size), _SPANS)
        else:
            every, more = divmod(quota, blocks)
            random = np.random.default_rng([seed, zlib.crc32(rows["key"][0].as_py().encode()), rows["shard"][0].as_py()])
            times = np.full(blocks, every, np.int64)
            times[random.permutation(blocks)[:more]] += 1
            edges = np.arange(blocks + 1, dtype=np.int64) * total // blocks
            upto = np.concatenate(([0], np.cumsum(np.diff(edges) * times)))
            at = lambda x: (k := np.minimum(np.searchsorted(edges, x, side="right") - 1, blocks - 1), upto[k] + (x - edges[k]) * times[k])[1]
            taken = at(ends) - at(ends - size)
            spans = _spans(ends, size, edges, times)
        keep = ["doc_id", "source", "size", "source_size", "target"]
        return pa.table([*(rows[c] for c in keep), pa.array(taken, pa.int64()), spans], names=[*keep, "taken", "spans"])

    return of_shard


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("times", pa.int32())]))


def _spans(ends: np.ndarray, size: np.ndarray, edges: np.ndarray, times: np.ndarray) -> pa.Array:
    """Runs of words of each row that are taken equally often, but for those never taken."""
    cuts = np.unique(np.concatenate((edges, ends)))
    start, stop = cuts[:-1], cuts[1:]
    often = times[np.searchsorted(edges, start, side="right") - 1]
    row = np.searchsorted(ends, start, side="right")
    start, stop, often, row = (v[often > 0] for v in (start, stop, often, row))
    fresh = np.ones(len(start), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (often[1:] != often[:-1]) | (start[1:] != stop[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first, len(start))[1:] - 1
    begins = (ends - size)[row[first]]
    parts = [pa.array(start[first] - begins), pa.array((stop[last] - start[first])), pa.array(often[first].astype(np.int32))]
    offsets = np.searchsorted(row[first], np.arange(len(ends) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, names=["start", "length", "times"]))


def mixture(
    spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS, seed: int = SEED,
) -> DataFrame:
    """Per row of documents doc_id, source, size, source_size, target, taken, and spans:
    the runs of its words that are taken (start, length, times).

    Null and empty texts have no words and nothing is taken of them; a null source is a
    source, the last; ids may be null or repeat, and rows that agree in id, source and
    size are told apart by number, so they may be taken unequally. Equal quotients go by
    source and shard. The result depends on the rows and the seed alone, not on how they
    are dealt to tasks. An empty table, or one without words, takes nothing; other
    columns aren't looked at.
    """
    # Equal rows are a count from the start, so no task gets all rows of one.
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")).alias("key")
    rows = written(spark, sizes(docs).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")).select("*", key), "sizes")
    sources = rows.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("source_rows"))
    sources = with_targets(spark, sources, weights, repeats)
    shards = F.ceil(F.greatest(F.col("source_size") / shard_words, F.col("source_rows") / shard_rows, F.lit(1.0)))
    sources = written(spark, sources.select("key", "source_size", "target", shards.alias("shards")), "sources")
    dealt = joined_by_hot(spark, rows, sources, ["key"])
    dealt = dealt.withColumn("many", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(rows - 1) div {COPIES}"))))
    dealt = dealt.withColumn("copy", F.explode(F.sequence(F.col("many") * COPIES, F.least(F.col("rows"), (F.col("many") + 1) * COPIES) - 1)))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "copy"), F.col("shards")))
    blocks = F.when(F.col("words") > 0, F.greatest(F.lit(1), F.round(F.col("words") / block_words))).otherwise(0).cast("bigint")
    cells = dealt.groupBy("key", "shard").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    cells = cells.withColumn("blocks", blocks).withColumn("most", repeats * F.col("blocks"))
    cells = cells.withColumn("votes", F.when(F.col("blocks") > 0, F.col("blocks") * F.col("target") / F.col("source_size")).otherwise(0.0))
    cells = written(spark, cells.select("key", "shard", "blocks", "most", "votes"), "cells")
    quotas = apportioned(spark, cells, ["key", "shard"]).select("key", "shard", "blocks", "quota")
    schema = "doc_id bigint, source string, size bigint, source_size bigint, target double, taken bigint, spans array<struct<start:bigint,length:bigint,times:int>>"
    return dealt.join(quotas, ["key", "shard"]).groupBy("key", "shard").applyInArrow(_taken(seed), schema)  # shards are of bounded size


def span_texts(text: Column, spans: Column) -> Column:
    """The words of each span of a text, joined by spaces and as often as they are taken."""
    words = F.regexp_extract_all(text, F.lit("[^ \\t-\\r]+"), F.lit(0))
    pieces = F.transform(spans, lambda s: F.array_repeat(F.array_join(F.slice(words, s["start"].cast("int") + 1, s["length"].cast("int")), " "), s["times"]))
    return F.flatten(pieces)


def mixed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document; see mixture."""
    return mixture(spark, docs).select("doc_id", "size", "source_size", "target", "taken")

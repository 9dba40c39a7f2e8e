"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets random hashes (signs of random projections),
concatenated into a key, and all vectors are ordered lexicographically by it. The
order is cut into windows of ``WINDOW`` vectors, and a vector is compared with all
of its own window and of the next one, so with ``WINDOW`` neighbours at least on
either side. What the windows may leave out is done exactly: vectors that share
their ``bits`` leading hashes, which near vectors do with a known probability, are
compared however many windows they fill, two windows to a task. Passes have
hashes of their own, and there are so many of them that a pair at the threshold
is missed with a probability of at most ``MISS``.

Ordering moves keys alone (a pass, a key and an id). Places in the order are
then handed back to the vectors, which are sent where they are compared: to the
segment of the order that they stand in, and the first window of a segment to the
one before as well.

Equal vectors are collapsed beforehand and counted. A pair that several passes
see counts in the first of them alone, which the places and hashes of its vectors
decide on the spot, so links are counted without listing pairs; what leaves a
window is, for each vector, its count and a vector it is connected to there.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Owned, joined_by_hot, windows, written
from .components import components, local_roots

SIMILARITY = 0.95
MISS = 1e-4
#: Vectors that share their leading hashes by chance, about.
RUN = 64
#: Vectors in a window, windows in a segment of the order, and in a stretch of a wide run.
WINDOW = 128
SEGMENT = 16
STRETCH = 8
#: Hashes in a key beyond the leading ones: they order a run.
_MORE = 8
_SEED = 20_24


def plan(n: int, similarity: float = SIMILARITY, miss: float = MISS) -> tuple[int, int]:
    """Leading hashes that make a run, and passes, for ``n`` vectors."""
    bits = max(4, min(60, math.ceil(math.log2(max(2, n) / RUN))))
    same = (1 - math.acos(similarity) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-same)))


def _projections(dim: int, bits: int, passes: int) -> np.ndarray:
    return np.random.default_rng(_SEED).standard_normal((dim, bits * passes))


def _keys(x: np.ndarray, projections: np.ndarray, bits: int) -> np.ndarray:
    """The key of each row of ``x`` in each pass."""
    signs = (x @ projections > 0).reshape(len(x), -1, bits)
    return (signs.astype(np.int64) << np.arange(bits - 1, -1, -1, dtype=np.int64)).sum(axis=2)


def usable(vector: str):
    """Whether a vector column can be linked: finite, not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _keyed(dim: int, kind: str):
    """(vec_id, v) -> (vec_id, key, raw): equal vectors, and they alone, share a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column("v").flatten()).astype(kind).reshape(batch.num_rows, dim) + 0.0  # -0 is 0
            raw = [r.tobytes() for r in flat]
            key = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(key, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "key", "raw"])

    return run


def _matrix(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors as rows, each scaled to a largest component of 1, so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.abs(x).max(axis=1, keepdims=True)


def _passes(projections, bits: int, passes: int, kind: str):
    """(key, raw) -> a row for each vector and pass: (pass, hashes, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                hashes = _keys(_matrix(part.column("raw").to_pylist(), kind), projections.value, bits + _MORE)
                for t in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, t, dtype=np.int32)), pa.array(hashes[:, t]), part.column("key")], names=["pass", "hashes", "key"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their number within the partition."""
    at = 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows))], names=[*batch.schema.names, "at"])
        at += batch.num_rows


def _ordered(spark: SparkSession, keys: DataFrame, window: int) -> DataFrame:
    """(pass, hashes, key) in lexicographic order, with the window that each stands in."""
    order = ["pass", "hashes", "key"]
    placed = keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, "pass int, hashes bigint, key binary, at bigint")
    placed = written(spark, placed.withColumn("part", F.spark_partition_id()), "order")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    return placed.select("pass", "hashes", "key", F.expr(f"CAST((before + at) div {window} AS INT)").alias("window"))


_FOUND = "key binary, n bigint, root binary"


class _Rows:
    """Vectors to compare, with their windows and runs in all passes."""

    def __init__(self, rows: pa.RecordBatch, kind: str) -> None:
        self.key, self.turn, self.window, self.copies = (rows.column(c) for c in ("key", "pass", "window", "copies"))
        self.turn, self.window, self.copies = self.turn.to_numpy(), self.window.to_numpy(), self.copies.to_numpy()
        self.places, self.runs = (np.asarray(rows.column(c).flatten()).reshape(rows.num_rows, -1) for c in ("places", "runs"))
        x = _matrix(rows.column("raw").to_pylist(), kind)
        self.unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]

    def links(self, main: np.ndarray, other: np.ndarray, similarity: float, apart: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row of ``main`` and a later one of ``other`` that no earlier pass
        compares; ``apart``: of windows that aren't neighbours."""
        i, j = np.nonzero(self.unit[main] @ self.unit[other].T >= similarity)
        i, j = main[i], other[j]
        good = (i < j) & (self.turn[i] == self.turn[j])
        if apart:
            good &= np.abs(self.window[i] - self.window[j]) > 1
        i, j = i[good], j[good]
        fresh = np.ones(len(i), dtype=bool)
        for t in np.unique(self.turn[i]).tolist():
            own = np.flatnonzero(self.turn[i] == t)
            for k in range(0, len(own) if t else 0, 65536):
                some = own[k : k + 65536]
                a, b = i[some], j[some]
                met = np.abs(self.places[a, :t] - self.places[b, :t]) <= 1
                met |= self.runs[a, :t] == self.runs[b, :t]
                fresh[some] = ~met.any(axis=1)
        return i[fresh], j[fresh]

    def found(self, i: np.ndarray, j: np.ndarray) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """Of rows that have links: key, how many, and the key of a row connected to it."""
        count = np.bincount(i, weights=self.copies[j], minlength=len(self.copies)) + np.bincount(j, weights=self.copies[i], minlength=len(self.copies))
        linked = np.flatnonzero(count > 0)
        root = local_roots(len(count), i, j)
        return self.key.take(pa.array(linked)), count[linked], self.key.take(pa.array(root[linked]))


def _compared(kind: str, group: tuple[str, ...], pairs) -> object:
    """A function of sorted rows: each group is compared as ``pairs`` says -> _FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, stops in windows(batches, group):
            for a, b in zip(starts, stops, strict=True):
                if b - a > 1:
                    own = _Rows(rows.slice(a, b - a), kind)
                    found = [*pairs(own, rows.slice(a, b - a))]
                    key, n, root = own.found(*(np.concatenate([f[c] for f in found]).astype(np.int64) for c in (0, 1)))
                    yield pa.RecordBatch.from_arrays([key, pa.array(n.astype(np.int64)), root], names=["key", "n", "root"])

    return run


def _neighbours(similarity: float):
    """Pairs of a segment: of each window, and of each window and the next."""

    def pairs(own: _Rows, rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        here = int((rows.column("side").to_numpy() == 0).sum())  # the rest is the next segment's first window
        cuts = [0, *(np.flatnonzero(own.window[1:] != own.window[:-1]) + 1).tolist(), len(own.window)]
        for at in range(len(cuts) - 1):
            if cuts[at] < here:
                stop = cuts[min(at + 2, len(cuts) - 1)]
                yield own.links(np.arange(cuts[at], cuts[at + 1]), np.arange(cuts[at], stop), similarity, False)
        yield np.empty(0, np.int64), np.empty(0, np.int64)

    return pairs


def _far(similarity: float):
    """Pairs of two stretches of a run, or of one, whose windows aren't neighbours."""

    def pairs(own: _Rows, rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        stretch = own.window // STRETCH
        first, second = (rows.column(c)[0].as_py() for c in ("first", "second"))
        yield own.links(np.flatnonzero(stretch == first), np.flatnonzero(stretch == second), similarity, True)

    return pairs


def linked_vectors(spark: SparkSession, vectors: DataFrame, similarity: float = SIMILARITY, miss: float = MISS, window: int = WINDOW) -> DataFrame:
    """Per vector vec_id, n_links, component_id and kept.

    Vectors of equal length are linked if their cosine, in double precision, is
    ``similarity`` or more; each length that occurs has passes of its own. Those
    that are null, zero, or hold null or non-finite components have no links and
    are components of their own. Equal vectors are linked; rows that repeat a
    vec_id are vectors of their own. An empty table gives no rows; columns other
    than vec_id and embedding are not looked at.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("v"))
    good = rows.where(usable("v"))
    out = rows.where(~F.coalesce(usable("v"), F.lit(False))).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    for size in good.select(F.size("v").alias("dim")).distinct().orderBy("dim").collect():
        out = out.unionByName(_linked(spark, good.where(F.size("v") == size["dim"]), size["dim"], similarity, miss, window))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _linked(spark: SparkSession, rows: DataFrame, dim: int, similarity: float, miss: float, window: int) -> DataFrame:
    """vec_id, n_links and component_id of vectors (vec_id, v), all of the length ``dim``."""
    with Owned(spark) as work:
        kind = "<f4" if rows.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"
        id_type = rows.schema["vec_id"].dataType.simpleString()
        keyed = rows.mapInArrow(_keyed(dim, kind), f"vec_id {id_type}, key binary, raw binary")
        keyed = written(spark, keyed, "keyed")
        classes = written(spark, keyed.groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("raw").alias("raw")), "vectors")
        bits, passes = plan(classes.count(), similarity, miss)
        projections = spark.sparkContext.broadcast(_projections(dim, bits + _MORE, passes))  # dim x hashes numbers
        hashed = classes.select("key", "raw").mapInArrow(_passes(projections, bits, passes, kind), "pass int, hashes bigint, key binary")
        order = written(spark, _ordered(spark, hashed, window), "windows").withColumn("run", F.shiftright("hashes", _MORE))
        # a run that fills three windows or more is wider than neighbours reach
        wide = order.groupBy("pass", "run").agg(F.min("window").alias("low"), F.max("window").alias("high")).where("high - low > 1")
        wide = written(spark, wide.select("pass", "run", F.expr(f"low div {STRETCH}").cast("int").alias("low"), F.expr(f"high div {STRETCH}").cast("int").alias("high")), "wide")
        each = F.sort_array(F.collect_list(F.struct("pass", "window", "run")))  # one entry for each pass
        runs = F.col("each.run").cast("array<smallint>" if bits <= 15 else "array<int>" if bits <= 31 else "array<bigint>")
        places = order.groupBy("key").agg(each.alias("each")).select("key", F.col("each.window").alias("places"), runs.alias("runs"))
        held = written(spark, classes.select("key", "copies", "raw").join(places, "key"), "placed")
        spread = held.select("*", F.posexplode("places").alias("pass", "window"))
        columns = ["pass", "window", "key", "copies", "raw", "places", "runs"]
        # neighbours: the first window of a segment goes to the one before as well
        side = F.when((F.col("window") > 0) & (F.col("window") % SEGMENT == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        near = spread.select(*columns, F.explode(side).alias("side")).withColumn("segment", F.expr(f"window div {SEGMENT}").cast("int") - F.col("side"))
        near = near.repartition("segment").sortWithinPartitions("segment", "window")
        found = near.mapInArrow(_compared(kind, ("segment",), _neighbours(similarity)), _FOUND)
        # and the stretches of a wide run with each other
        dealt = spread.withColumn("run", F.get("runs", F.col("pass")).cast("bigint")).join(wide, ["pass", "run"])
        own = F.expr(f"window div {STRETCH}").cast("int")
        dealt = dealt.withColumn("with", F.explode(F.sequence("low", "high"))).withColumn("first", F.least(own, "with")).withColumn("second", F.greatest(own, "with"))
        group = ["pass", "run", "first", "second"]
        far = dealt.select(*columns, "run", "first", "second").repartition(*group).sortWithinPartitions(*group, "window")
        found = found.unionByName(far.mapInArrow(_compared(kind, tuple(group), _far(similarity)), _FOUND))
        found = written(spark, found, "found")
        labels = components(spark, found.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")))
        counts = found.groupBy("key").agg(F.sum("n").alias("n"))
        placed = classes.select("key", "first_id", "copies").join(counts, "key", "left").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        placed = written(spark, placed, "components")
        lowest = written(spark, placed.groupBy("component").agg(F.min("first_id").alias("component_id")), "lowest")
        placed = joined_by_hot(spark, placed, lowest, ["component"]).select("key", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        placed = written(spark, placed, "answers")
        work.keep(keyed, placed)
    return joined_by_hot(spark, keyed.select("vec_id", "key"), placed, ["key"]).select("vec_id", "n_links", "component_id")

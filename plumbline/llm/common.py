"""What the training-data operators share: tables, work folders, Arrow batches.

Work tables are written under the folder that ``spark.checkpoint.dir`` names, so
that any executor can read what another one wrote and a lost executor costs only
the tasks it was running. Where the setting is absent a temporary folder of this
machine takes its place, if Spark runs on this machine alone.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in slices of about so many UTF-8 bytes, which bounds what a
#: worker holds besides the Arrow batch itself. A longer text is a slice alone.
SLICE_BYTES = 1 << 20

_local_root: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, else one of our own."""
    global _local_root
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="plumbline-")
    return f"file://{_local_root}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone by then; the folder is only scratch space
        pass


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a work table, removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/plumbline-{uuid.uuid4().hex[:12]}-{name}"
    atexit.register(_remove, spark, path)
    return path


class Owned:
    """The work tables of one call: those that ``written`` makes within the ``with``
    block, in this thread. At its end all but those named to keep are removed; other
    calls, in other threads or around this one, have tables of their own."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self._kept = spark, [], set()

    def __enter__(self) -> Owned:
        self._outer = _owner.set(self)
        return self

    def keep(self, *tables: DataFrame) -> None:
        self._kept.update(df.work_path for df in tables)

    def drop(self, path: str) -> None:
        if path in self.paths:
            self.paths.remove(path)
            _remove(self.spark, path)

    def __exit__(self, *error) -> None:
        _owner.reset(self._outer)
        for path in [p for p in self.paths if p not in self._kept]:
            self.drop(path)


_owner: ContextVar[Owned | None] = ContextVar("owner", default=None)


def dropped(*tables: DataFrame) -> None:
    """Remove work tables of the present owner that no later plan reads."""
    if owner := _owner.get():
        for df in tables:
            owner.drop(df.work_path)


#: A task of a small work table takes about so many bytes of what the table is made of.
PART_BYTES = 2 << 20


def tasks(spark: SparkSession, size: int, each: int = PART_BYTES) -> int:
    """How many tasks ``size`` bytes are worth: one for ``each`` bytes, and one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-size // each))


def written(spark: SparkSession, df: DataFrame, name: str, of: list[DataFrame] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back. ``of`` are work
    tables that ``df`` is made of and not much larger than: the last step then has as many tasks as their size
    is worth, however many partitions a shuffle makes; a nearly empty task costs as much as some 10,000 rows."""
    path = work_path(spark, name)
    if of:
        df = df.coalesce(tasks(spark, sum(t.work_bytes for t in of)))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out.work_bytes = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    if owner := _owner.get():
        owner.paths.append(path)
    return out


#: A join key with more rows than this is hot; so many of the hottest are set apart.
HOT_ROWS = 1000
HOT_KEYS = 10_000


def hot_keys(spark: SparkSession, df: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys with the most rows, at most ``HOT_KEYS``; None if no key has many. Counted with partial sums."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS)
    if (size := getattr(df, "work_bytes", None)) is not None:
        counts = counts.coalesce(tasks(spark, size))
    found = counts.orderBy(F.desc("_n")).limit(HOT_KEYS).select(*keys)
    rows = found.toArrow()
    return spark.createDataFrame(rows, found.schema) if rows.num_rows else None


def joined_by_hot(spark: SparkSession, left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for a key, so that no task gets all
    rows of a hot key: rows of hot keys stay where they are and the few rows of
    ``right`` for them are broadcast; the others meet by a shuffle.

    Both are read several times, so they should be written tables.
    """
    return joined_apart(left, right, keys, hot_keys(spark, left, keys), how)


def joined_apart(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """The same with the hot keys of ``left`` known."""
    if hot is None:
        return left.join(right, keys, how)
    hot = F.broadcast(hot)  # HOT_KEYS rows at most
    few = F.broadcast(right.join(hot, keys, "left_semi"))
    return left.join(hot, keys, "left_semi").join(few, keys, how).unionByName(left.join(hot, keys, "left_anti").join(right, keys, how))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``limit`` bytes."""
    if not batch.num_rows:
        return
    at = batch.schema.get_field_index(column)
    size = pc.fill_null(pc.binary_length(batch.column(at)), 0)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    first, base = 0, 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(first, last - first)
        base, first = int(ends[last - 1]), last


def windows(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, list[int], list[int]]]:
    """Runs of rows that agree in ``columns``, from sorted rows: a batch of whole
    runs, where each begins and where it ends. Held at once are a batch and a run."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        same = np.ones(rows.num_rows - 1, dtype=bool)
        for c in columns:
            v = rows.column(c).to_numpy(zero_copy_only=False)
            same &= v[1:] == v[:-1]
        cuts = [0, *(np.flatnonzero(~same) + 1).tolist()]
        yield rows, cuts[:-1], cuts[1:]
        held = [rows.slice(cuts[-1])]  # the last run may go on
    if held:
        yield held[0], [0], [held[0].num_rows]


def give_back() -> None:
    """Return memory that this worker has freed but still holds to the system: the
    workers of all stages of a job share an executor's memory and live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words (xor-shift and multiply rounds); a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x

"""Writing a table's token ids to files of idfile's format, and reading them.

Documents are dealt into ranges of ascending doc_id, one partition each, sorted
within. A partition becomes one shard or more of bounded size; a shard is the
bytes of one file. Shards are kept as rows (partition, shard, content) of a
Parquet table, so that Spark's commit protocol makes the write atomic and a lost
executor's shards are written again; ``exported`` puts them into plain files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, work_path, written
from .idfile import BLOCK, Shard, read_shard, write_shard
from .tokens import encoder

END_ID = 1
#: Ids in a shard, about.
SHARD_IDS = 4 * BLOCK
_READ = "part int, shard int, place bigint, doc_id string, n_tokens bigint, ids_crc32 bigint"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of every text, with ``end_id`` after each, to shards at ``path``.

    Rows go in ascending doc_id order, nulls first; rows of one id as the
    table has them. Every row is written, whatever its doc_id is called or typed; a null
    or empty text has the end id alone; an empty table gives no shards.
    """
    end = np.array([end_id], dtype=np.uint32)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer)
        ids, names, lengths, held, number = [], [], [], 0, 0

        def closed() -> pa.RecordBatch:
            content = write_shard(Shard(names, np.array(lengths), np.concatenate(ids)))
            return pa.RecordBatch.from_arrays([pa.array([part_id], pa.int32()), pa.array([number], pa.int32()), pa.array([content], pa.binary())], names=["part", "shard", "content"])

        part_id = 0
        for batch in batches:
            for piece in slices(batch, "text"):
                part_id = piece.column("part")[0].as_py()
                coded, counts = model.code(piece.column("text").to_pylist())
                at = 0
                for name, n in zip(piece.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                    ids += [coded[at : at + n], end]
                    at += n
                    names.append(name)
                    lengths.append(n + 1)
                    held += n + 1
                    if held >= shard_ids:
                        yield closed()
                        ids, names, lengths, held, number = [], [], [], 0, number + 1
        if names:
            yield closed()

    # by the row's number too, so that a repeated id can be split among partitions
    ordered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    ordered = ordered.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    ordered = ordered.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    ordered.mapInArrow(shards, "part int, shard int, content binary").write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: part, shard, place (in the shard), doc_id (text), n_tokens, ids_crc32."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, content in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "content")), strict=True):
                own = read_shard(content)
                raw, stop = own.ids.astype("<u4").tobytes(), 4 * np.cumsum(own.lengths)
                start = stop - 4 * own.lengths
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(np.full(n, shard, np.int32)),
                        pa.array((start // 4).astype(np.int64)),
                        pa.array(own.names, pa.string()),
                        pa.array(own.lengths),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["part", "shard", "place", "doc_id", "n_tokens", "ids_crc32"],
                )

    return spark.read.schema("part int, shard int, content binary").parquet(path).mapInArrow(documents, _READ)


def shard_ids(spark: SparkSession, path: str, part: int, shard: int) -> Shard:
    """One shard's documents and ids."""
    row = spark.read.parquet(path).where((F.col("part") == part) & (F.col("shard") == shard)).first()
    return read_shard(bytes(row["content"]))


def exported(spark: SparkSession, path: str) -> Iterator[tuple[str, bytes]]:
    """Name and bytes of each file, one at a time."""
    for row in spark.read.parquet(path).orderBy("part", "shard").toLocalIterator():
        yield f"part-{row['part']:06d}-{row['shard']:04d}.plid", bytes(row["content"])


def token_file_report(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Per document doc_id, start, n_tokens and ids_crc32, as read back from files
    written for it; ``start`` counts the ids of all documents before it.

    Every row counts: a null doc_id comes first, rows of one id go as the table
    has them; a null or empty text has the end id alone. An
    empty table gives no rows; columns other than doc_id and text are not looked at.
    """
    path = work_path(spark, "ids")
    write_token_files(docs, path, tokenizer, end_id)
    rows = written(spark, read_token_files(spark, path), "read")
    shards = rows.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))  # a row for each shard
    parts = shards.groupBy("part").agg(F.sum("n").alias("n"))  # one for each partition
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = shards.withColumn("within", within).join(parts.select("part", ahead.alias("ahead")), "part")
    starts = starts.select("part", "shard", (F.col("ahead") + F.col("within")).alias("before"))
    doc_id = F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return rows.join(starts, ["part", "shard"]).select(doc_id, (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")

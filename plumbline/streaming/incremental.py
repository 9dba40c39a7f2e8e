"""Incremental ingestion (an extension; batches are idempotent by deterministic ids)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.records import SCHEMAS, parsed_lines


def record_stream(spark: SparkSession, folder: str, kind: str, required: list[str]) -> DataFrame:
    """New JSON lines of a folder as parsed records."""
    return parsed_lines(spark.readStream.text(folder), SCHEMAS[kind], required)


def upserts(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Start writing good records, one partition a batch; a batch that is run again
    overwrites what it wrote, so restarts add nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        good = batch.where("error IS NULL").select("record.*").dropDuplicates([key])
        good.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, watermark: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums of events per window and type, late rows up to the watermark."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

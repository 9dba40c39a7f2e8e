"""Digests of sets that don't depend on order and can be merged.

Each member is hashed with SHA-256; four times 60 bits of it are added up. Sums of
parts add up to the sum of the whole, so a digest is one aggregation with partial
sums, and a digest kept for each partition tells which partitions have changed.
Members that repeat count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 4


def member(*parts: Column | str) -> Column:
    """The hash of one member: of its parts as JSON, so nulls and empty texts differ."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.to_json(F.struct(*(c.alias(f"p{k}") for k, c in enumerate(columns))), {"ignoreNullFields": "false"}), 256)


def lanes(hashed: Column, weight: Column | None = None) -> list[Column]:
    """Aggregates of a digest; ``weight`` is how often a member counts."""
    one = lambda k: F.conv(F.substring(hashed, 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")
    times = lambda c: c if weight is None else c * weight.cast("decimal(18,0)")
    return [F.coalesce(F.sum(times(one(k))), F.lit(0)).cast("decimal(38,0)") for k in range(LANES)]


def text(n: Column, sums: list[Column]) -> Column:
    """A digest as text: how many members, and a hash of the sums."""
    return F.concat_ws("-", n.cast("string"), F.substring(F.sha2(F.concat_ws(",", *(s.cast("string") for s in sums)), 256), 1, 32))


def digest(df: DataFrame, *columns: str, by: list[str] | None = None) -> DataFrame:
    """(by..., n, digest) of the rows' values in ``columns`` (all, if none is named)."""
    by, columns = by or [], columns or tuple(c for c in df.columns if c not in (by or []))
    hashed = df.select(*by, member(*columns).alias("_h"))
    sums = hashed.groupBy(*by).agg(F.count("*").alias("n"), *(s.alias(f"_s{k}") for k, s in enumerate(lanes(F.col("_h")))))
    return sums.select(*by, "n", text(F.col("n"), [F.col(f"_s{k}") for k in range(LANES)]).alias("digest"))


def changed(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """The partitions (by...) whose digests differ, or that only one side has."""
    old, new = before.select(*by, F.col("digest").alias("_old")), after.select(*by, F.col("digest").alias("_new"))
    return old.join(new, by, "full").where(~F.col("_old").eqNullSafe(F.col("_new"))).select(*by)

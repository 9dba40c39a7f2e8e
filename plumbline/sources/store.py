"""Versioned tables with aliases: create, validate, write, verify, promote, roll back.

A version ``<alias>_v<N>`` has a file of properties that is created once. Its rows lie
in a folder that no reader sees until all of it is verified: which folder a version
reads, and which version an alias means, are pointers that move by compare and swap.

    versions/<name>.json   data/<name>/<run>/   at/<name>/000000000001.json
    aliases/<alias>/000000000001.json           .staged/<run>/
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions import digests
from plumbline.operators.retrieval import embedded
from plumbline.sources.work import Files, Pointer, Work

_BATCH = "_batch"


class Refused(ValueError):
    """Rows or input that an index doesn't take; nothing was written or served.
    ``report`` says why."""

    def __init__(self, message: str, report: dict) -> None:
        super().__init__(f"{message}: {report}")
        self.report = report


class Store:
    """Tables under one root folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def create(self, alias: str, version: int, properties: dict) -> str:
        """Declare a version; again with the same properties is fine, others are an error."""
        name = f"{alias}_v{version}"
        if not self.files.create(f"versions/{name}.json", properties) and self.properties(name) != properties:
            raise ValueError(f"{name} exists with other properties")
        return name

    def properties(self, name: str) -> dict | None:
        return self.files.read(f"versions/{name}.json")

    def replace(self, name: str, df: DataFrame, key: str, invalid: Column | dict[str, Column] | None = None, batches: int = 1, run: str | None = None) -> dict:
        """Make ``df`` the rows of a version: all of them, or nothing changes.

        Everything is validated first, in one pass that also takes the digest of the input:
        each rule of ``invalid`` (name, condition), a missing key, a repeated key. Then
        batches, dealt by key, are written beside what is served, and each is credited when
        its rows are read back as many as were meant and with the digest they should have.
        ``run`` names the attempt: one that broke off goes on after its credited batches.
        At last the digest of the input is taken again, for rows that changed meanwhile are
        refused, a fixed sample is looked up, the folder gets its name and the pointer moves.

        An empty table is a table; repeated rows have a repeated key.
        """
        if self.properties(name) is None:
            raise ValueError(f"{name} was not created")
        rules = invalid if isinstance(invalid, dict) else {} if invalid is None else {"invalid": invalid}
        rules = {"missing_key": F.col(key).isNull(), **rules}
        batch = F.pmod(F.xxhash64(key), F.lit(batches)).cast("int").alias(_BATCH)
        by_batch = lambda rows: {r[_BATCH]: (r["n"], r["digest"]) for r in digests.digest(rows, *df.columns, by=[_BATCH]).collect()}  # noqa: E731  a row for each batch
        bad = df.agg(*(F.count_if(c).alias(k) for k, c in rules.items())).first().asDict()
        bad["repeated_key"] = df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").count()
        if any(bad.values()):
            raise Refused("invalid rows", {k: n for k, n in bad.items() if n})
        before = by_batch(df.select("*", batch))
        run = run or uuid.uuid4().hex
        staged, target = f".staged/{run}", f"data/{name}/{run}"
        seen, _ = self._data(name).now()
        credits = {int(n[:-5]): self.files.read(f"{staged}/credits/{n}") for n in self.files.names(f"{staged}/credits")}
        if any((c["rows"], c["digest"]) != before.get(k) for k, c in credits.items()):
            raise Refused("the input is not the one that this run began with", {"run": run})
        for k in sorted(set(before) - set(credits)):
            self._credited(df.where(batch == k) if batches > 1 else df, f"{staged}", k, before[k])
        if by_batch(df.select("*", batch)) != before:
            raise Refused("the input changed while it was written", {"credited": sorted(before)})
        n = sum(rows for rows, _ in before.values())
        if not before:
            df.write.mode("overwrite").parquet(f"{self.root}/{staged}/rows")
        self.files.create(f"{staged}/rows/_schema", {"schema": df.schema.json()})
        sample = [r[key] for r in fixed_sample(df, key).collect()]
        found = self._rows(f"{staged}/rows").where(F.col(key).isin(sample)).count() if sample else 0
        if found != len(sample):
            raise RuntimeError(f"{name} does not hold what was written")
        self.files.move(f"{staged}/rows", target)
        if not self._data(name).advance(seen, {"folder": target, "rows": n}):
            raise RuntimeError(f"{name} was replaced by someone else meanwhile")
        self.files.delete(staged)
        return {"rows": n, "sample": sample, "batches": len(before), "resumed": len(credits), "run": run}

    def _credited(self, df: DataFrame, staged: str, k: int, wanted: tuple[int, str]) -> None:
        """Write one batch and credit it; a batch that doesn't read back as it was meant has no credit."""
        folder = f"{staged}/rows/{_BATCH}={k}"
        df.write.mode("overwrite").parquet(f"{self.root}/{folder}")
        back = digests.digest(self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}")).collect()
        got = (back[0]["n"], back[0]["digest"]) if back else (0, "")
        if got != wanted:
            raise Refused("a batch does not hold what was written", {"batch": k, "wanted": wanted[0], "stored": got[0]})
        self.files.create(f"{staged}/credits/{k}.json", {"rows": got[0], "digest": got[1]})

    def _data(self, name: str) -> Pointer:
        return Pointer(self.files, f"at/{name}")

    def _rows(self, folder: str) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.files.read(f"{folder}/_schema")["schema"]))
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}").select(*schema.names)

    def read(self, name: str) -> DataFrame:
        now = self._data(name).now()[1]
        if not now:
            raise ValueError(f"{name} holds no rows yet")
        return self._rows(now["folder"])

    def promote(self, alias: str, name: str, expected: str | None = None) -> dict:
        """Point the alias at a version, if it points where ``expected`` says and nobody
        moves it meanwhile."""
        pointer = Pointer(self.files, f"aliases/{alias}")
        seen, now = pointer.now()
        if expected is not None and now.get("target") != expected:
            raise RuntimeError("the alias has moved")
        if self.properties(name) is None:
            raise ValueError(f"{name} does not exist")
        value = {"target": name, "previous": now.get("target")}
        if not pointer.advance(seen, value):
            raise RuntimeError("the alias has moved")
        return value

    def rollback(self, alias: str) -> dict:
        """Point the alias back at what it pointed at before."""
        now = Pointer(self.files, f"aliases/{alias}").now()[1]
        if not now.get("previous"):
            raise RuntimeError("nothing to roll back to")
        return self.promote(alias, now["previous"], now["target"])

    def resolve(self, alias: str, expected: dict | None = None) -> str:
        """The version an alias points at, if its properties are the expected ones."""
        now = Pointer(self.files, f"aliases/{alias}").now()[1]
        if not now:
            raise ValueError(f"no alias {alias}")
        have = self.properties(now["target"]) or {}
        wrong = {k for k, v in (expected or {}).items() if have.get(k) != v}
        if wrong:
            raise ValueError(f"{now['target']} does not fit: {sorted(wrong)}")
        return now["target"]

    def status(self) -> list[dict]:
        """Every alias with its target and what came before."""
        return [{"alias": a, **Pointer(self.files, f"aliases/{a}").now()[1]} for a in self.files.names("aliases")]


def index_vectors(store: Store, name: str, rows: DataFrame, key: str, text: str, embed, dim: int, batches: int = 1, run: str | None = None) -> dict:
    """Embed a text column by an injected function and make the rows, with their vectors,
    those of a version. Rows are embedded once, into a work table; that every vector comes
    back as it was made is part of each batch's digest."""
    vectors = Work(store.spark).written(embedded(rows, text, embed, dim), "vectors")
    return store.replace(name, vectors, key, invalid={"not_unit": F.abs(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) - 1) > 2e-3}, batches=batches, run=run)


def compatible(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same columns and types, nullability aside."""
    plain = lambda df: sorted((f.name, f.dataType.simpleString()) for f in df.schema)
    return plain(a) == plain(b)


def fixed_sample(df: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """First, median and last id in order.

    The median's bucket, between two ids of a small sample, is found by counting;
    only that bucket is put in order.
    """
    n = df.count()
    if n == 0:
        return df.limit(0)
    some = df.select(key).where(F.rand(7) < min(1.0, 4 * buckets / n)).limit(8 * buckets).collect()
    cuts = sorted({r[key] for r in some})[:: max(1, len(some) // buckets)]
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    before, middle = 0, (n - 1) // 2
    for row in df.groupBy(bucket.alias("bucket")).count().orderBy("bucket").collect():  # one row for each cut at most
        if middle < before + row["count"]:
            median = df.where(bucket == row["bucket"]).orderBy(key).offset(middle - before).limit(1)
            break
        before += row["count"]
    return df.orderBy(key).limit(1).unionByName(median).unionByName(df.orderBy(F.desc(key)).limit(1)).dropDuplicates([key])


def scoped_replacement(stored: DataFrame, new: DataFrame, scope: str, key: str) -> tuple[DataFrame, DataFrame]:
    """The table after one scope's rows were replaced, and the stale ids that went."""
    scopes = new.select(scope).distinct()
    stale = stored.join(scopes, scope, "left_semi").join(new.select(key), key, "left_anti").select(scope, key)
    return stored.join(scopes, scope, "left_anti").unionByName(new), stale


def keyset_page(df: DataFrame, key: str, after: str | None, size: int) -> DataFrame:
    """The next rows after an id."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(size)


def verification(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Named checks of a staged graph: name, passed."""
    one = lambda name, df: df.agg((F.count("*") == 0).alias("passed")).select(F.lit(name).alias("name"), "passed")
    twice = lambda df, k: df.groupBy(k).count().where("count > 1")
    checks = [one("node_ids_unique", twice(nodes, "node_id")), one("edge_ids_unique", twice(edges, "edge_id")), one("node_ids_present", nodes.where("node_id IS NULL"))]
    for side in ("src", "dst"):
        checks.append(one(f"{side}_known", edges.join(nodes.select(F.col("node_id").alias(side)), side, "left_anti")))
    checks.append(one("no_self_loops", edges.where("src = dst")))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("_n = 1").drop("_n")

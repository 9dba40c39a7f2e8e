"""Tables that cut the lineage of one call, and small files that are created once.

A ``Work`` belongs to the call that made it: what it writes nobody else removes, so
calls may run side by side in one session. Its tables lie in the folder that
``spark.checkpoint.dir`` names, which all executors see. Where that is unset, a
folder of this machine will do only if Spark runs on this machine alone.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    """One folder of this machine for all calls of this process, where that will do."""
    return tempfile.mkdtemp(prefix="plumbline-")


class Work:
    """Work tables of one call."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._paths = spark, []
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        self._root = (named or f"file://{_own_folder()}").rstrip("/")

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, written and read back. Removed when the driver ends, or by drop."""
        path = f"{self._root}/plumbline-{uuid.uuid4().hex[:12]}-{name}"
        atexit.register(_remove, self.spark, path)
        df.write.option("compression", "zstd").parquet(path)
        self._paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.work_path = path
        return out

    def drop(self, keep: list[DataFrame] | None = None) -> None:
        """Remove the tables of this call but those in ``keep``."""
        kept = {df.work_path for df in keep or []}
        for path in [p for p in self._paths if p not in kept]:
            _remove(self.spark, path)
            self._paths.remove(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone by then; this is only scratch space
        pass


class Files:
    """Small JSON files and folders under one root of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self._jvm = spark, root.rstrip("/"), spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.path("").getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def names(self, folder: str = "") -> list[str]:
        """Names in a folder, but for those that start with a dot."""
        if not self.exists(folder):
            return []
        return sorted(n for f in self._fs.listStatus(self.path(folder)) if not (n := f.getPath().getName()).startswith("."))

    def read(self, name: str) -> dict | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self.path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, name: str, value: dict) -> bool:
        """Write a file if there is none of that name: True if this call did it. Of
        several callers one succeeds; nobody sees half a file."""
        target = self.path(name)
        self._fs.mkdirs(target.getParent())
        staged = self._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
        out = self._fs.create(staged, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":  # its rename replaces; a link doesn't
                at = lambda p: self._jvm.java.nio.file.Paths.get(self._fs.makeQualified(p).toUri())
                self._jvm.java.nio.file.Files.createLink(at(target), at(staged))
            else:
                self._rename(staged, target)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self._fs.delete(staged, False)
        return True

    def _rename(self, source, target) -> None:
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(self._fs.makeQualified(source), self._fs.makeQualified(target), options)

    def move(self, source: str, target: str) -> None:
        """Rename a folder to a name that nothing has."""
        self._fs.mkdirs(self.path(target).getParent())
        self._rename(self.path(source), self.path(target))

    def delete(self, name: str) -> bool:
        return self._fs.delete(self.path(name), True)


class Pointer:
    """A value that moves from one state to the next by compare and swap.

    States are numbered files; the next one is created if it isn't there, so of two
    writers that have seen the same state one loses and is told so. Earlier states stay.
    """

    def __init__(self, files: Files, folder: str) -> None:
        self._files, self._folder = files, folder

    def now(self) -> tuple[int, dict]:
        """Number and value of the present state; (0, {}) before the first."""
        names = [n for n in self._files.names(self._folder) if n.endswith(".json")]
        return (int(names[-1][:-5]), self._files.read(f"{self._folder}/{names[-1]}")) if names else (0, {})

    def advance(self, seen: int, value: dict) -> bool:
        """Make ``value`` the state after number ``seen``; False if there is one already."""
        return self._files.create(f"{self._folder}/{seen + 1:012}.json", value)

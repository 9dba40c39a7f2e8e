"""Generations of a graph: stage, verify, publish, roll back, clean up.

Records of a generation lie beside those of others, under revisions of their own;
what is served is told by a pointer of three revisions that moves by compare and
swap. Staging never moves it, and publishing refuses a generation that was not
verified, or that was staged while another one was served.

    nodes/project_id=P/node_revision_id=N/
    edges/project_id=P/source_kind=K/revision_id=R/node_revision_id=N/
    pointers/P/000000000001.json ...
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions import digests, ids
from plumbline.operators import graph
from plumbline.sources.work import Files, Pointer

SCHEMA = "kg2"
#: Owners of edges: what may be cleaned up apart. Fixed values.
NATIVE, DERIVED = "ifc_native", "derived_geometry"
NODE_COLUMNS = ["label", "kind", "node_id", "project_id", "node_revision_id", "node_instance_id"]
EDGE_COLUMNS = ["predicate", "edge_id", "project_id", "source_kind", "revision_id", "instance_id", "source_instance", "target_instance", "source_revision", "target_revision"]
#: The sets of a generation, and the checks that each has.
SETS = ["node", "native", "derived"]


@dataclass(frozen=True)
class Revisions:
    """What names a generation."""

    project: str
    node: str
    native: str
    derived: str
    bundle: str


def node_records(nodes: DataFrame, r: Revisions) -> DataFrame:
    """Nodes (node_id, kind, optional properties) as records of a generation."""
    return graph.projected_nodes(nodes.withColumn("project_id", F.lit(r.project)), SCHEMA, r.node)


def edge_records(edges: DataFrame, r: Revisions, owner: str) -> DataFrame:
    """Edges (predicate, edge_id, src, dst) as records of a generation of one owner."""
    out = graph.projected_edges(edges, r.project, SCHEMA, r.node, r.native if owner == NATIVE else r.derived, owner)
    return out.select("*", F.lit(r.project).alias("project_id"), F.lit(owner).alias("source_kind"), F.lit(r.node).alias("source_revision"), F.lit(r.node).alias("target_revision"))


def _present(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return out


#: Tasks that such rows are dealt to.
TASKS = 192
#: What a row by id or occurrence tells, and of which type.
_TOLD = {"of": "string", "level": "string", "key": "string", "stored": "int", "expected": "int", "referred": "int", "value": "string", "label": "string", "own_project": "boolean", "whole": "boolean", "generation": "boolean", "owner": "boolean"}


def _told(of: str, level: str, key: str, **more: Column | int) -> Column:
    """A row in the common form: the set, id or occurrence, key, side, and what is right about it."""
    own = {"of": of, "level": level, "key": F.col(key)} | {side: 0 for side in ("stored", "expected", "referred")} | more
    return F.struct(*((own[n] if isinstance(own.get(n), Column) else F.lit(own.get(n))).cast(kind).alias(n) for n, kind in _TOLD.items()))


def verification(stored: tuple[DataFrame, DataFrame, DataFrame], expected: tuple[DataFrame, DataFrame, DataFrame], r: Revisions) -> DataFrame:
    """The 25 named checks of a staged generation: name, violations, passed.

    stored and expected: records of nodes, native and derived edges. Each side is read
    once: a record becomes rows by id, by occurrence and by the occurrences that edges
    refer to, which meet by key in one shuffle. What is wrong is summed up for each set
    and level, and of these six rows the checks are made. A check of a set as a whole
    counts 1 if its digest differs, for which only keys that differ need to be hashed.
    """
    rows = None
    for of, have, want in zip(SETS, stored, expected, strict=True):
        node = of == "node"
        name, occurrence, value = ("node_id", "node_instance_id", "kind") if node else ("edge_id", "instance_id", "predicate")
        revision = r.node if node else r.native if of == "native" else r.derived
        generation = (F.col("node_revision_id") == r.node) if node else (F.col("source_revision").eqNullSafe(r.node) & F.col("target_revision").eqNullSafe(r.node) & F.col("revision_id").eqNullSafe(revision))
        said = {"value": F.col(value), "label": F.col("label") if node else F.lit(None)}
        right = {
            "own_project": F.col("project_id").eqNullSafe(r.project), "whole": _present(NODE_COLUMNS if node else EDGE_COLUMNS), "generation": generation,
            "owner": F.lit(True) if node else F.col("source_kind").eqNullSafe(NATIVE if of == "native" else DERIVED),
        }
        here = F.lit(True) if node else generation  # an extra occurrence is one of this generation that nobody expects
        has = [_told(of, "id", name, stored=1, **said, **right), _told(of, "occurrence", occurrence, stored=1, generation=here)]
        has += [] if node else [_told("node", "occurrence", end, referred=1) for end in ("source_instance", "target_instance")]
        asks = [_told(of, "id", name, expected=1, **said), _told(of, "occurrence", occurrence, expected=1)]
        for df, told in ((have, has), (want, asks)):
            part = df.select(F.inline(F.array(*told)))
            rows = part if rows is None else rows.unionByName(part)
    is_stored = F.col("stored") == 1
    wrong = lambda c: F.sum(F.when(is_stored & ~F.coalesce(F.col(c), F.lit(False)), 1).otherwise(0)).alias(f"{c}_wrong")
    only = lambda c, side: F.max(F.when(F.col(side) == 1, F.col(c)))
    said = [f for c in ("value", "label") for f in (only(c, "stored").alias(c), F.min(F.when(is_stored, F.col(c))).alias(f"{c}_low"), only(c, "expected").alias(f"{c}_wanted"), F.count_if(is_stored & F.col(c).isNull()).alias(f"no_{c}"))]
    # keys hardly repeat on a side, so rows are shuffled as they are and sorted once, by key first, which tells most of them apart
    met = rows.repartition(TASKS, "key", "of", "level").groupBy("key", "of", "level").agg(*(F.sum(c).alias(c) for c in ("stored", "expected", "referred")), *(wrong(c) for c in ("own_project", "whole", "generation", "owner")), *said)
    differs = F.col("stored") != F.col("expected")
    # A value that differs among the stored rows of a key is wrong in one of them at least.
    unlike = lambda c: (F.col("stored") > 0) & ((F.col(f"no_{c}") > 0) | ~F.col(c).eqNullSafe(F.col(f"{c}_wanted")) | ~F.col(f"{c}_low").eqNullSafe(F.col(c)))
    hashed = F.when(differs, digests.member("of", "key"))
    counts = {
        "surplus": F.sum(F.col("stored") - F.col("expected")), "differing": F.count_if(differs), "twice": F.count_if(F.col("stored") > 1), "missing": F.count_if((F.col("referred") > 0) & (F.col("stored") == 0)),
        "extra": F.count_if((F.col("stored") > F.col("generation_wrong")) & (F.col("expected") == 0)), **{f"{c}_unlike": F.count_if(unlike(c)) for c in ("value", "label")}, **{f"{c}_wrong": F.sum(f"{c}_wrong") for c in ("own_project", "whole", "generation", "owner")},
    }
    lanes = digests.lanes(hashed, F.col("stored") - F.col("expected"))
    same = F.lit(True)
    for k in range(len(lanes)):
        same = same & (F.col(f"lane{k}") == 0)
    sums = met.groupBy("of", "level").agg(*(c.alias(n) for n, c in counts.items()), *(c.alias(f"lane{k}") for k, c in enumerate(lanes))).withColumn("unequal", F.when(same, 0).otherwise(1))
    total = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    checks: list[tuple[str, Column]] = []
    for of in SETS:
        by_id, by_occurrence = ((F.col("of") == of) & (F.col("level") == level) for level in ("id", "occurrence"))
        checks += [(f"{of}_count_exact", F.abs(total(by_id, "surplus"))), (f"{of}_id_set_exact", total(by_id, "differing")), (f"{of}_occurrence_set_exact", total(by_occurrence, "differing")), (f"{of}_fingerprint_exact", total(by_id, "unequal"))]
        if of != "node":
            checks += [(f"{of}_provenance_exact", total(by_id, "whole_wrong") + total(by_id, "owner_wrong")), (f"{of}_no_extra_occurrence", total(by_occurrence, "extra"))]
    ids_ = F.col("level") == "id"
    nodes, edges = (F.col("of") == "node") & ids_, (F.col("of") != "node") & ids_
    checks += [
        ("node_labels_exact", total(nodes, "label_unlike")), ("node_kind_exact", total(nodes, "value_unlike")), ("relationship_types_exact", total(edges, "value_unlike")),
        ("endpoint_generation_exact", total(edges, "generation_wrong")), ("node_properties_exact", total(nodes, "whole_wrong")), ("no_foreign_project", total(ids_, "own_project_wrong")),
        ("no_duplicate_node_id", total(nodes, "twice")), ("no_duplicate_edge_id", total(edges, "twice")), ("endpoint_occurrences_exist", total((F.col("of") == "node") & ~ids_, "missing")),
    ]
    one = sums.agg(*(F.coalesce(c, F.lit(0)).cast("bigint").alias(name) for name, c in checks))
    named = F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).alias("violations")) for name, _ in sorted(checks)))
    return one.select(F.explode(named).alias("c")).select("c.name", "c.violations", (F.col("c.violations") == 0).alias("passed"))


class Generations:
    """Generations of graphs under one root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def _pointer(self, project: str) -> Pointer:
        return Pointer(self.files, f"pointers/{project}")

    def active(self, project: str) -> dict:
        """What is served: node, native, derived, bundle; previous; counter."""
        return self._pointer(project).now()[1]

    @staticmethod
    def _folders(r: Revisions) -> dict[str, str]:
        edges = lambda owner, revision: f"edges/project_id={r.project}/source_kind={owner}/revision_id={revision}/node_revision_id={r.node}"
        return {"node": f"nodes/project_id={r.project}/node_revision_id={r.node}", "native": edges(NATIVE, r.native), "derived": edges(DERIVED, r.derived)}

    def stage(self, r: Revisions, nodes: DataFrame, native: DataFrame, derived: DataFrame) -> dict:
        """Write a generation beside what is served. A set is written under a name of its own
        and renamed when it is whole, so one that is there is complete and isn't written
        again; the pointer doesn't move. The result says what was served meanwhile."""
        seen, now = self._pointer(r.project).now()
        records = {"node": node_records(nodes, r), "native": edge_records(native, r, NATIVE), "derived": edge_records(derived, r, DERIVED)}
        written = []
        for name, folder in self._folders(r).items():
            if self.files.exists(folder):
                continue
            staged = f".staged/{uuid.uuid4().hex}"
            records[name].write.partitionBy("label" if name == "node" else "predicate").parquet(f"{self.root}/{staged}")
            self.files.create(f"{staged}/_schema", {"schema": records[name].schema.json()})  # a set may have no rows
            try:
                self.files.move(staged, folder)
                written.append(name)
            except Exception:
                if not self.files.exists(folder):
                    raise  # else another writer of the same revision was first
        if self._pointer(r.project).now()[0] != seen and self.active(r.project) != now:
            raise RuntimeError("another generation was published meanwhile")
        return {"revisions": r, "seen": seen, "predecessor": now.get("bundle"), "written": written}

    def stored(self, r: Revisions) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The records of a generation: nodes, native edges, derived edges."""
        schema = lambda folder: StructType.fromJson(json.loads(self.files.read(f"{folder}/_schema")["schema"]))
        read = lambda folder: self.spark.read.schema(schema(folder)).option("basePath", f"{self.root}/{folder}").parquet(f"{self.root}/{folder}")
        return tuple(read(folder) for folder in self._folders(r).values())

    def verify(self, r: Revisions, nodes: DataFrame, native: DataFrame, derived: DataFrame) -> DataFrame:
        """The checks of a staged generation against what it should hold."""
        return verification(self.stored(r), (node_records(nodes, r), edge_records(native, r, NATIVE), edge_records(derived, r, DERIVED)), r)

    def publish(self, staged: dict, checks: DataFrame) -> dict:
        """Serve a verified generation, if what is served is what was when it was staged."""
        failed = sorted(row["name"] for row in checks.where(~F.col("passed")).collect())  # 25 rows
        if failed:
            raise RuntimeError(f"not published, checks failed: {failed}")
        r: Revisions = staged["revisions"]
        seen, now = self._pointer(r.project).now()
        if now.get("bundle") == r.bundle:
            return now | {"changed": False}
        if now.get("bundle") != staged["predecessor"]:
            raise RuntimeError("the active generation changed since staging")
        previous = {k: now[k] for k in ("node", "native", "derived", "bundle")} if now else None
        value = {"node": r.node, "native": r.native, "derived": r.derived, "bundle": r.bundle, "previous": previous, "counter": now.get("counter", 0) + 1}
        if not self._pointer(r.project).advance(seen, value):
            raise RuntimeError("the active generation changed during publication")
        return value | {"changed": True}

    def rollback(self, project: str) -> dict:
        """Serve the previous generation again, if its records are still there; it can be
        done once, for what came before that isn't recorded."""
        seen, now = self._pointer(project).now()
        back = now.get("previous")
        if not back:
            raise RuntimeError("no previous generation is recorded")
        folders = self._folders(Revisions(project, **back)).values()
        if not all(self.files.exists(f) for f in folders):
            raise RuntimeError("the previous generation has been cleaned away")
        value = back | {"previous": None, "counter": now["counter"]}
        if not self._pointer(project).advance(seen, value):
            raise RuntimeError("the active generation changed during rollback")
        return value

    def cleanup(self, project: str, owner: str, retain_previous: bool = True) -> list[str]:
        """Delete this owner's edges that don't belong to a retained generation (revision and
        node revision both), and with the native ones the nodes that no edge of any owner
        needs. Returns the folders deleted. What is served is read again before each
        deletion, so a generation published meanwhile stays."""
        if owner not in (NATIVE, DERIVED):
            raise ValueError(f"{owner} owns no edges")
        kind = "native" if owner == NATIVE else "derived"
        self._retained(project, retain_previous)
        gone = []
        base = f"edges/project_id={project}/source_kind={owner}"
        for revision in self.files.names(base):
            for node in self.files.names(f"{base}/{revision}"):
                if (revision.partition("=")[2], node.partition("=")[2]) not in {(g[kind], g["node"]) for g in self._retained(project, retain_previous)}:
                    gone.append(f"{base}/{revision}/{node}")
                    self.files.delete(gone[-1])
            if not self.files.names(f"{base}/{revision}"):
                self.files.delete(f"{base}/{revision}")
        if owner == NATIVE:
            for node in self.files.names(f"nodes/project_id={project}"):
                name = node.partition("=")[2]
                used = any(node in self.files.names(f"{o}/{rev}") for o in (f"edges/project_id={project}/source_kind={k}" for k in (NATIVE, DERIVED)) for rev in self.files.names(o))
                if not used and name not in {g["node"] for g in self._retained(project, retain_previous)}:
                    gone.append(f"nodes/project_id={project}/{node}")
                    self.files.delete(gone[-1])
        return gone

    def _retained(self, project: str, previous: bool) -> list[dict]:
        now = self.active(project)
        if not now:
            raise RuntimeError("no generation is served: nothing can be told to be stale")
        return [now] + [now["previous"]] * bool(previous and now["previous"])

    def served(self, project: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The records that are served."""
        now = self.active(project)
        if not now:
            raise RuntimeError("no generation is served")
        return self.stored(Revisions(project, *(now[k] for k in ("node", "native", "derived", "bundle"))))

    def rebuild(self, r: Revisions, nodes: DataFrame, native: DataFrame, derived: DataFrame) -> dict:
        """Stage, verify and publish."""
        staged = self.stage(r, nodes, native, derived)
        return self.publish(staged, self.verify(r, nodes, native, derived))

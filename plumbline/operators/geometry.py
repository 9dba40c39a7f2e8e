"""Boxes, meshes and spatial predicates."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = "0.000500"
AXES = ("x", "y", "z")


def overlap(axis: str, a: str = "a", b: str = "b") -> Column:
    """Length that two boxes have in common on an axis; negative: the gap."""
    return F.least(F.col(f"{a}.{axis}1"), F.col(f"{b}.{axis}1")) - F.greatest(F.col(f"{a}.{axis}0"), F.col(f"{b}.{axis}0"))


def contains(a: str, b: str, t: Column) -> Column:
    """Box ``a`` holds box ``b`` within ``t``, and they aren't equal within ``t``."""
    inside, equal = F.lit(True), F.lit(True)
    for x in AXES:
        inside = inside & (F.col(f"{a}.{x}0") <= F.col(f"{b}.{x}0") + t) & (F.col(f"{a}.{x}1") >= F.col(f"{b}.{x}1") - t)
        equal = equal & (F.abs(F.col(f"{a}.{x}0") - F.col(f"{b}.{x}0")) <= t) & (F.abs(F.col(f"{a}.{x}1") - F.col(f"{b}.{x}1")) <= t)
    return inside & ~equal


def predicates(t: Column, a: str = "a", b: str = "b") -> dict[str, Column]:
    """The four predicates on an ordered pair of boxes."""
    o = {x: overlap(x, a, b) for x in AXES}
    inner = (o["x"] > t) & (o["y"] > t) & (o["z"] > t)
    near = (o["x"] >= -t) & (o["y"] >= -t) & (o["z"] >= -t)
    flat = (F.abs(o["x"]) <= t) | (F.abs(o["y"]) <= t) | (F.abs(o["z"]) <= t)
    return {
        "CONTAINS_GEOM": contains(a, b, t),
        "INTERSECTS": inner & ~contains(a, b, t) & ~contains(b, a, t),
        "TOUCHES": near & flat & ~inner,
        "ABOVE": (F.col(f"{a}.z0") >= F.col(f"{b}.z1") - t) & (o["x"] > t) & (o["y"] > t),
    }


#: Members of a class of equal boxes in one row, about, and of those that others are paired with at a time; blocks that
#: all pairs are dealt to; tasks that pairs are made in, at least, and into how many of them a row of members may go.
MEMBERS, RUN, BLOCKS, TASKS, DEALS = 1000, 128, 16, 256, 16


def _ends(axes: tuple[str, ...]) -> list[str]:
    return [f"{x}{k}" for x in axes for k in (0, 1)]


def _id(member: str, boxes: DataFrame, axes: tuple[str, ...]) -> Column:
    """The id of a member, which is all of it unless boxes have other columns."""
    return F.col(member) if set(boxes.columns) == {"id", *_ends(axes)} else F.col(member)["id"]


def _classes(boxes: DataFrame, axes: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Boxes that are equal on ``axes`` as one class (a struct of the ends there, and its number of
    parts), and their members (class, part, rows), MEMBERS or so of them in a row: ids in order,
    or what else the boxes have."""
    ends, boxes = _ends(axes), boxes.where("id IS NOT NULL")  # null is in no pair
    sizes = boxes.groupBy(*ends).agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    rest = [c for c in boxes.columns if c not in ends]
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    rows = boxes.join(sizes, ends).groupBy(F.struct(*ends).alias("class"), part.alias("part")).agg(F.collect_list(F.col("id") if rest == ["id"] else F.struct(*rest)).alias("rows"))
    ordered = F.sort_array("rows") if rest == ["id"] else F.col("rows")
    return sizes.select(F.struct(*ends).alias("class"), "parts"), rows.select("class", "part", ordered.alias("rows"))


def _class_pairs(classes: DataFrame, axes: tuple[str, ...], tolerance: str, cell: float) -> DataFrame:
    """Pairs (a, b) of classes whose extents meet on ``axes`` within the tolerance, in both
    orders, each with itself too. Classes go to the grid cells that their extents cover and
    meet there by an equi-join; a pair is kept in the first cell that both cover."""
    t = F.lit(tolerance).cast("decimal(20,6)")
    lo = lambda x: F.floor((F.col(f"class.{x}0") - t) / cell).cast("int")
    hi = lambda x: F.floor((F.col(f"class.{x}1") + t) / cell).cast("int")
    put, cells = classes, [f"c{x}" for x in axes]
    for x in axes:
        put = put.withColumn(f"f{x}", lo(x)).withColumn(f"c{x}", F.explode(F.sequence(lo(x), hi(x))))
    put = put.repartition(TASKS, *cells)
    a, b = (put.select(F.col("class").alias(n), *(F.col(f"f{x}").alias(f"{n}{x}") for x in axes), *cells) for n in "ab")
    first = [F.col(f"c{x}") == F.greatest(f"a{x}", f"b{x}") for x in axes]
    return a.join(b, cells).where(reduce(Column.__and__, [*first, *(overlap(x) >= -t for x in axes)])).select("a", "b")


def _members(pairs: DataFrame, classes: DataFrame, rows: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pairs of classes (a, b, and what else they have) with rows of their members: m of a, and
    n of b, which are RUN of them or fewer.

    Few rows become many, so they are dealt to tasks whatever their size, of which there are as
    many as MEMBERS go into the boxes; a task has few members of either side. Pairs take little
    space where they are written, for m stands for all of n, and n comes again and again.
    """
    tasks = max(TASKS, boxes.count() // MEMBERS)
    key = ["b", "to", "deal"]
    for n, part in (("a", "from"), ("b", "to")):
        pairs = pairs.join(classes.select(F.col("class").alias(n), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias(part)), n)
    left = pairs.join(rows.select(F.col("class").alias("a"), F.col("part").alias("from"), F.col("rows").alias("m")).hint("merge"), ["a", "from"])
    left = left.withColumn("deal", F.pmod(F.xxhash64("a", "from"), F.lit(DEALS)))
    at = F.explode(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / RUN).cast("int")))
    runs = rows.where(F.size("rows") > 0).select(F.col("class").alias("b"), F.col("part").alias("to"), "rows", at.alias("at")).select("b", "to", F.slice("rows", F.col("at") * RUN + 1, F.lit(RUN)).alias("n"))
    right = runs.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(DEALS - 1).cast("bigint"))))
    return left.repartition(tasks, *key).join(right.repartition(tasks, *key).hint("merge"), key).drop("from", *key[1:])


def column_pairs(boxes: DataFrame, tolerance: str = TOLERANCE, cell: float | None = None) -> DataFrame:
    """Pairs a < b of boxes (id, x0 … z1) whose XY extents meet within the tolerance.

    Boxes that stand on the same place are one until the pairs of places are known, so
    what is searched doesn't grow with the square of their number; only the pairs that
    are asked for do. Z is left out, for ABOVE has no height limit.
    """
    return _pairs(boxes, ("x", "y"), tolerance, cell or max(1000 * float(tolerance), 1.0))


def swept_pairs(boxes: DataFrame, tolerance: str = TOLERANCE, cell: float = 1.0) -> DataFrame:
    """Pairs whose X extents meet, by cells of the X axis alone."""
    return _pairs(boxes, ("x",), tolerance, cell)


def _pairs(boxes: DataFrame, axes: tuple[str, ...], tolerance: str, cell: float) -> DataFrame:
    classes, rows = _classes(boxes, axes)
    whole = lambda box, rest: F.struct(*(F.col(f"{box if c in _ends(axes) else rest}.{c}").alias(c) for c in boxes.columns))
    met = _members(_class_pairs(classes.select("class"), axes, tolerance, cell), classes, rows, boxes)
    m, n = (_id(x, boxes, axes) for x in "mn")
    met = met.withColumn("last", F.array_max(n)).withColumn("m", F.explode("m")).where(m < F.col("last")).withColumn("n", F.explode("n")).where(m < n)
    if set(boxes.columns) == {"id", *_ends(axes)}:
        met = met.withColumns({x: F.struct(F.col(x).alias("id")) for x in "mn"})
    return met.select(whole("a", "m").alias("a"), whole("b", "n").alias("b"))


def exhaustive_pairs(boxes: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """All pairs a < b, as a reference for the others: rows are dealt to blocks, and each
    two blocks meet in a place of their own, so none is held whole."""
    row = boxes.select(F.struct(*boxes.columns).alias("box"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("k"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = row.select(F.col("box").alias("a"), F.col("k").alias("i"), every.alias("j")).repartition(blocks * blocks, "i", "j")
    b = row.select(F.col("box").alias("b"), every.alias("i"), F.col("k").alias("j")).repartition(blocks * blocks, "i", "j")
    return a.join(b, ["i", "j"]).where(F.col("a.id") < F.col("b.id")).select("a", "b")


BROAD_PHASES = {"exhaustive": exhaustive_pairs, "sweep": swept_pairs, "columns": column_pairs}
_SYMMETRIC = ["INTERSECTS", "TOUCHES"]


def relations(boxes: DataFrame, tolerance: str = TOLERANCE, broad_phase: str = "columns") -> DataFrame:
    """(predicate, src, dst, quality) of every pair, in both orientations; symmetric
    ones once, smaller id first. Quality is exact if it holds without tolerance too.
    Predicates are told of classes of equal boxes, and the members of those that have one
    are paired."""
    if broad_phase not in BROAD_PHASES:
        raise KeyError(broad_phase)
    classes, rows = _classes(boxes.select("id", *_ends(AXES)), AXES)
    if broad_phase == "exhaustive":
        pairs = classes.select(F.col("class").alias("a")).crossJoin(classes.select(F.col("class").alias("b")))
    else:
        axes = ("x",) if broad_phase == "sweep" else ("x", "y")
        flat = classes.select(F.struct(*(f"class.{c}" for c in _ends(axes))).alias("flat"), "class")  # boxes above each other meet as one
        pairs = _class_pairs(flat.select(F.col("flat").alias("class")).distinct(), axes, tolerance, max(1000 * float(tolerance), 1.0))
        for n in "ab":
            pairs = pairs.join(flat.select(F.col("flat").alias(n), F.col("class").alias(f"whole_{n}")), n).drop(n)
        pairs = pairs.toDF("a", "b").repartition(TASKS)
    t, zero = F.lit(tolerance).cast("decimal(20,6)"), F.lit("0").cast("decimal(20,6)")
    loose, exact = predicates(t), predicates(zero)
    held = F.array(*(F.when(loose[n], F.struct(F.lit(n).alias("predicate"), F.when(exact[n], "exact").otherwise("tolerant").alias("quality"))) for n in loose))
    found = pairs.select("a", "b", F.explode(F.array_compact(held)).alias("r")).select("a", "b", "r.*")
    found = found.withColumn("symmetric", F.col("predicate").isin(_SYMMETRIC))  # told of a pair of classes, not of each of its members
    met = _members(found, classes, rows, boxes).withColumn("last", F.array_max("n")).withColumn("src", F.explode("m")).where("NOT symmetric OR src < last")
    return met.withColumn("dst", F.explode("n")).where("src < dst OR NOT symmetric AND src > dst").select("predicate", "src", "dst", "quality")


def bounds(vertices: DataFrame, by: str = "element_id") -> DataFrame:
    """Axis-parallel box and its centre, from vertices (x, y, z), six places."""
    out = vertices.groupBy(by).agg(*(f(x).alias(f"{x}{n}") for x in AXES for n, f in ((0, F.min), (1, F.max))))
    return out.select(by, *(F.bround(f"{x}{n}", 6).alias(f"{x}{n}") for x in AXES for n in (0, 1)), *(F.bround((F.col(f"{x}0") + F.col(f"{x}1")) / 2, 6).alias(f"c{x}") for x in AXES))


def _cross(p: str, q: str, r: str) -> list[Column]:
    u, v = ([F.col(f"{b}.{x}") - F.col(f"{a}.{x}") for x in AXES] for a, b in ((p, q), (p, r)))
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def triangle_areas(triangles: DataFrame) -> DataFrame:
    """Triangles (p, q, r: structs of x, y, z) with area; degenerate ones have 0."""
    c = _cross("p", "q", "r")
    return triangles.withColumn("area", F.sqrt(c[0] * c[0] + c[1] * c[1] + c[2] * c[2]) / 2)


def centroids(triangles: DataFrame, by: str = "element_id") -> DataFrame:
    """Centroid of each mesh: of the volume where every edge is used exactly twice,
    else of the surface. Triangles that lie by mesh are not moved."""
    area = triangle_areas(triangles).where(F.col("area") > 0)
    signed = sum((F.col(f"p.{x}") * c for x, c in zip(AXES, _cross("p", "q", "r"), strict=True)), F.lit(0.0)) / 6
    sides = F.array(*(F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")) for a, b in (("p", "q"), ("q", "r"), ("r", "p"))))
    flat = [F.col(f"edge.{end}.{x}").alias(f"{end}{x}") for end in ("lo", "hi") for x in AXES]
    used = area.select(by, F.explode(sides).alias("edge")).select(by, *flat).groupBy(by, *(f"{end}{x}" for end in ("lo", "hi") for x in AXES)).count().groupBy(by).agg(F.bool_and(F.col("count") == 2).alias("closed"))
    mid = {x: (F.col(f"p.{x}") + F.col(f"q.{x}") + F.col(f"r.{x}")) / 3 for x in AXES}
    quarter = {x: (F.col(f"p.{x}") + F.col(f"q.{x}") + F.col(f"r.{x}")) / 4 for x in AXES}
    sums = area.withColumn("v", signed).groupBy(by).agg(
        F.sum("area").alias("surface"), F.sum("v").alias("volume"), *(F.sum(mid[x] * F.col("area")).alias(f"s{x}") for x in AXES), *(F.sum(quarter[x] * F.col("v")).alias(f"v{x}") for x in AXES)
    )
    solid = F.col("closed") & (F.abs("volume") > 1e-12)
    return sums.join(used.hint("merge"), by).select(by, "closed", F.when(solid, "volume").otherwise("surface").alias("kind"), *(F.bround(F.when(solid, F.col(f"v{x}") / F.col("volume")).otherwise(F.col(f"s{x}") / F.col("surface")), 6).alias(f"c{x}") for x in AXES))


def principal_axis(points: DataFrame, by: str = "element_id", separation: float = 0.01) -> DataFrame:
    """Direction of largest spread of each element's points, if it stands out; its
    first component that isn't zero after rounding is positive."""
    moments = points.groupBy(by).agg(F.count("*").alias("n"), *(F.sum(x).alias(x) for x in AXES), *(F.sum(F.col(a) * F.col(b)).alias(a + b) for i, a in enumerate(AXES) for b in AXES[i:]))

    @F.pandas_udf("array<double>")
    def axis(n: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series, xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
        mean = np.stack([x / n, y / n, z / n], axis=1)
        second = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).reshape(-1, 3, 3) / n.to_numpy()[:, None, None]
        values, vectors = np.linalg.eigh(second - mean[:, :, None] * mean[:, None, :])
        out = []
        for w, v in zip(values, vectors, strict=True):
            top = np.round(v[:, 2], 6) + 0.0
            lead = next((c for c in top if c), 0.0)
            out.append((top * np.sign(lead)).tolist() if w[2] > 0 and (w[2] - w[1]) / w[2] > separation else None)
        return pd.Series(out)

    return moments.select(by, axis("n", *AXES, "xx", "xy", "xz", "yy", "yz", "zz").alias("axis"))


def angle(a: Column, b: Column) -> Column:
    """Degrees between two axes, whichever way they point."""
    dot = F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.degrees(F.acos(F.least(F.abs(dot), F.lit(1.0))))


def fact_checksum(columns: list[str]) -> Column:
    """Checksum over the printed quantised values, in a fixed order."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).cast("binary"), 256)


def status(volume: Column, triangles: Column, units: Column) -> Column:
    """The status ladder of a fact, first failing step first."""
    return F.when(units.isNull(), "unit_undetermined").when(triangles.isNull(), "no_geometry").when(triangles == 0, "degenerate").when(volume.isNull(), "partial").otherwise("valid")


def length_unit(units: Column) -> Column:
    """struct(name, factor, issue) of a project's length units, an array of (name,
    factor). Units without a factor don't count; none left, or two that differ, and
    the unit is undetermined."""
    known = F.filter(units, lambda u: u["factor"].isNotNull())
    different = F.size(F.array_distinct(F.transform(known, lambda u: F.bround(u["factor"], 12))))
    issue = F.when(F.coalesce(different, F.lit(0)) == 0, "UNIT_UNRESOLVABLE").when(different > 1, "UNIT_INCONSISTENT")
    first = F.when(issue.isNull(), F.try_element_at(known, F.lit(1)))
    return F.struct(first["name"].alias("name"), first["factor"].alias("factor"), issue.alias("issue"))


def batch_issues(facts: DataFrame, project: str, version: str) -> DataFrame:
    """Facts (geometry_id, element_id, project_id, geometry_version, status, x0) that may
    not replace a project's geometry, each with the first rule that it breaks."""
    repeats = facts.groupBy("geometry_id").agg(F.count("*").alias("_ids")), facts.groupBy("element_id").agg(F.count("*").alias("_elements"))
    counted = facts.join(repeats[0], "geometry_id", "left").join(repeats[1], "element_id", "left")
    issue = (
        F.when(~F.col("project_id").eqNullSafe(F.lit(project)), "other_project")
        .when(~F.col("geometry_version").eqNullSafe(F.lit(version)), "other_version")
        .when(F.col("geometry_id").isNull() | (F.col("_ids") > 1), "duplicate_geometry_id")
        .when(F.col("element_id").isNull() | (F.col("_elements") > 1), "two_facts_of_one_element")
        .when((F.col("status") == "valid") & F.col("x0").isNull(), "valid_without_bounds")
    )
    return counted.withColumn("issue", issue).where("issue IS NOT NULL").select("geometry_id", "element_id", "issue")


def replacement(stored: DataFrame, facts: DataFrame, project: str) -> DataFrame:
    """What becomes of a project's stored facts (geometry_id, project_id, checksum) when
    ``facts`` replace them: write, rewrite, keep or delete, by explicit id. Facts of
    other projects aren't looked at, so none of them can be deleted."""
    old = stored.where(F.col("project_id") == project).select("geometry_id", F.col("checksum").alias("_old"), F.lit(True).alias("_stored"))
    new = facts.where(F.col("project_id") == project).select("geometry_id", F.col("checksum").alias("_new"), F.lit(True).alias("_intended"))
    step = F.when(F.col("_intended").isNull(), "delete").when(F.col("_stored").isNull(), "write").when(F.col("_old").eqNullSafe(F.col("_new")), "keep").otherwise("rewrite")
    return old.join(new, "geometry_id", "full").select("geometry_id", step.alias("step"))

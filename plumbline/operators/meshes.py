"""Geometry facts of triangle meshes: a ladder of statuses, issue codes, and the
measures that a status allows.

Vertices that agree in six places are one. A mesh is closed if every edge between such
vertices is used exactly twice by triangles that have an area; only then it has a centre
of volume. Everything is aggregated by element, triangles meet their corners by one
join, and no mesh is held in one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.geometry import AXES
from plumbline.sources.work import Work

# Limits, in metres and pieces, and what the largest eigenvalue has to exceed the next by.
MAX_ABS, MAX_VERTICES, MAX_TRIANGLES, SEPARATION = 1_000_000.0, 2_000_000, 4_000_000, 0.01
#: Codes that a failed step of reading a shape may have, by the status they lead to. Fixed values.
READING = {
    "shape_creation_error": "shape_creation_failed", "timeout": "shape_creation_failed", "unsupported_representation": "unsupported_representation",
    "vertex_limit_exceeded": "resource_limit_exceeded", "triangle_limit_exceeded": "resource_limit_exceeded", "byte_limit_exceeded": "resource_limit_exceeded",
}
#: Codes that stand for a failure; a valid fact has none of them. Fixed values.
FATAL = [
    "no_representation", "unsupported_representation", "shape_creation_error", "empty_triangulation", "degenerate_extent", "non_finite_coordinate", "coordinate_out_of_range", "vertex_limit_exceeded",
    "triangle_limit_exceeded", "byte_limit_exceeded", "timeout", "unit_unresolvable", "unit_inconsistent",
]


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _quantised(c: Column) -> Column:
    return F.bround(c, 6) + F.lit(0.0)  # no negative zero


def _orientation(moments: DataFrame) -> DataFrame:
    """element_id, axis, separation and what is wrong, from centred second moments."""
    names = ["xx", "xy", "xz", "yy", "yz", "zz"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, *m = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("n", *names))
            full = np.stack([m[k] for k in (0, 1, 2, 1, 3, 4, 2, 4, 5)], axis=1).reshape(-1, 3, 3)
            w, v = np.linalg.eigh(full)
            top = w[:, 2]
            with np.errstate(divide="ignore", invalid="ignore"):
                gap = np.where(top > 0, (top - w[:, 1]) / top, 0.0)
            axis = np.round(v[:, :, 2], 6) + 0.0
            lead = np.argmax(axis != 0, axis=1)
            axis = axis * np.where(axis[np.arange(len(axis)), lead] < 0, -1.0, 1.0)[:, None] + 0.0
            flat, even = (n < 4) | (top <= 1e-18), gap <= SEPARATION
            issue = ["orientation_degenerate" if f else "orientation_ambiguous_symmetry" if e else None for f, e in zip(flat, even, strict=True)]
            good = [i is None for i in issue]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([a if g else None for a, g in zip(axis.tolist(), good, strict=True)], pa.list_(pa.float64())),
                    pa.array([round(s, 6) if g else None for s, g in zip(gap.tolist(), good, strict=True)], pa.float64()), pa.array(issue, pa.string()),
                ], names=["element_id", "axis", "separation", "orientation_issue"],
            )

    kind = moments.schema["element_id"].dataType.simpleString()
    return moments.mapInArrow(run, f"element_id {kind}, axis array<double>, separation double, orientation_issue string")


def _measured(triangles: DataFrame) -> DataFrame:
    """Triangles with corners p, q, r (as they are) and P, Q, R (welded): area, signed
    volume, and whether welding leaves them an area."""
    cross = lambda a, b: [F.col(f"{a}.{AXES[(k + 1) % 3]}") * F.col(f"{b}.{AXES[(k + 2) % 3]}") - F.col(f"{a}.{AXES[(k + 2) % 3]}") * F.col(f"{b}.{AXES[(k + 1) % 3]}") for k in range(3)]

    def area(p: str, q: str, r: str) -> Column:
        u, v = ([F.col(f"{b}.{x}") - F.col(f"{p}.{x}") for x in AXES] for b in (q, r))
        n = [u[(k + 1) % 3] * v[(k + 2) % 3] - u[(k + 2) % 3] * v[(k + 1) % 3] for k in range(3)]
        return F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2

    volume = sum((F.col(f"p.{x}") * c for x, c in zip(AXES, cross("q", "r"), strict=True)), F.lit(0.0)) / 6
    kept = (F.col("wp") != F.col("wq")) & (F.col("wq") != F.col("wr")) & (F.col("wp") != F.col("wr")) & (_quantised(area("wp", "wq", "wr")) != 0)
    return triangles.withColumn("area", area("p", "q", "r")).withColumn("volume", volume).withColumn("kept", kept)


def mesh_facts(elements: DataFrame, vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """One fact for each element: status, issues (sorted), vertex_count, triangle_count, x0
    to z1, rx to rz (middle of the box), cx to cz with centroid_kind, axis and separation.

    elements: element_id, unit (null if undetermined), unit_issue, has_representation,
    reading (a code of READING, or null), identifiers, map_conversion. vertices: element_id,
    vertex, x, y, z. triangles: element_id, a, b, c. The first step that fails decides; a
    triangle with a corner that isn't there makes the representation unsupported. A measure
    that can't be told is null and named by an issue, and makes the fact partial.
    """
    work = Work(elements.sparkSession)
    odd = ~(_finite(F.col("x")) & _finite(F.col("y")) & _finite(F.col("z")))
    size = F.max(F.greatest(*(F.abs(x) for x in AXES)))
    seen = vertices.groupBy("element_id").agg(F.count("*").alias("vertices"), F.max(odd).alias("odd"), size.alias("size"), *(f(_quantised(F.col(x))).alias(f"{x}{k}") for x in AXES for k, f in ((0, F.min), (1, F.max))))
    found = elements.join(seen, "element_id", "left").join(triangles.groupBy("element_id").agg(F.count("*").alias("triangles")), "element_id", "left")
    many = F.when(F.col("vertices") > MAX_VERTICES, "vertex_limit_exceeded").when(F.col("triangles") > MAX_TRIANGLES, "triangle_limit_exceeded")
    code = (
        F.when(F.col("unit").isNull(), F.coalesce("unit_issue", F.lit("unit_unresolvable")))
        .when(~F.coalesce("has_representation", F.lit(False)), "no_representation")
        .when(F.col("reading").isNotNull(), F.col("reading"))
        .when(many.isNotNull(), many)
        .when(F.coalesce("vertices", F.lit(0)) == 0, "empty_triangulation")
        .when(F.col("odd"), "non_finite_coordinate")
        .when(F.col("size") > MAX_ABS, "coordinate_out_of_range")
    )
    found = work.written(found.withColumn("code", code), "found")
    sound = found.where("code IS NULL").select("element_id", "x0", "x1", "y0", "y1", "z0", "z1")
    points = vertices.join(sound, "element_id")
    middle = {x: (F.col(f"{x}0") + F.col(f"{x}1")) / 2 for x in AXES}
    shifted = {x: F.col(x) - middle[x] for x in AXES}  # near the middle, so that squares and volumes keep their digits
    point = F.struct(*(shifted[x].alias(x) for x in AXES))
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    sums = points.groupBy("element_id").agg(F.count("*").alias("n"), *(F.avg(shifted[x]).alias(f"m{x}") for x in AXES), *(F.avg(shifted[a] * shifted[b]).alias(a + b) for a, b in pairs))
    turned = _orientation(sums.select("element_id", "n", *((F.col(a + b) - F.col(f"m{a}") * F.col(f"m{b}")).alias(a + b) for a, b in pairs)))
    corners = triangles.join(sound.select("element_id"), "element_id").withColumn("triangle", F.monotonically_increasing_id())
    corners = work.written(corners.select("element_id", "triangle", F.posexplode(F.array("a", "b", "c")).alias("k", "vertex")), "corners")
    welded = F.struct(*(_quantised(F.col(x)).alias(x) for x in AXES))
    met = corners.join(points.select("element_id", "vertex", point.alias("p"), welded.alias("w")), ["element_id", "vertex"], "left")
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    shaped = met.groupBy("element_id", "triangle").agg(*(at(c, k).alias(n + name) for c, n in (("p", ""), ("w", "w")) for k, name in enumerate("pqr")))
    shaped = work.written(_measured(shaped), "shaped")
    lost = (F.col("p").isNull() | F.col("q").isNull() | F.col("r").isNull()).cast("int")
    kept = F.coalesce("kept", F.lit(False))
    weigh = lambda w, n: [F.sum(F.when(kept, F.col(w) * (F.col(f"p.{x}") + F.col(f"q.{x}") + F.col(f"r.{x}")) / n)).alias(f"{w}_{x}") for x in AXES]
    total = shaped.groupBy("element_id").agg(F.max(lost).alias("lost"), F.count_if(kept).alias("kept"), F.sum(F.when(kept, F.col("area"))).alias("area"), F.sum(F.when(kept, F.col("volume"))).alias("volume"), *weigh("area", 3), *weigh("volume", 4))
    edge = F.array(*(F.array_sort(F.array(a, b)) for a, b in (("wp", "wq"), ("wq", "wr"), ("wp", "wr"))))
    used = shaped.where("kept").select("element_id", F.explode(edge).alias("edge")).groupBy("element_id", "edge").count()
    closed = used.groupBy("element_id").agg(F.bool_and(F.col("count") == 2).alias("closed"))
    facts = found.join(total, "element_id", "left").join(closed, "element_id", "left").join(turned, "element_id", "left")
    flat = (F.coalesce(F.col("kept"), F.lit(0)) == 0) | ((F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1")) & (F.col("z0") == F.col("z1")))
    code = F.coalesce("code", F.when(F.coalesce("lost", F.lit(0)) > 0, "unsupported_representation").when(flat, "degenerate_extent"))
    facts = facts.withColumn("code", code)
    fine = F.col("code").isNull()
    solid = F.coalesce(F.col("closed") & (_quantised(F.abs("volume")) != 0), F.lit(False))
    kind = F.when(fine & solid, "volume").when(fine & (F.col("area") > 0), "surface")
    facts = facts.withColumn("centroid_kind", kind)
    centre = {x: F.when(F.col("centroid_kind") == "volume", F.col(f"volume_{x}") / F.col("volume") + middle[x]).when(F.col("centroid_kind") == "surface", F.col(f"area_{x}") / F.col("area") + middle[x]) for x in AXES}
    status = (
        F.when(F.col("code").isin("unit_unresolvable", "unit_inconsistent"), "unit_undetermined").when(F.col("code") == "no_representation", "missing_representation").when(F.col("code") == "empty_triangulation", "empty_geometry")
        .when(F.col("code") == "non_finite_coordinate", "non_finite_geometry").when(F.col("code") == "coordinate_out_of_range", "out_of_range").when(F.col("code") == "degenerate_extent", "degenerate_geometry")
    )
    for c, s in READING.items():
        status = status.when(F.col("code") == c, s)
    status = status.when(fine & (F.col("centroid_kind").isNull() | F.col("axis").isNull()), "partial").when(fine, "valid")
    issues = F.array_compact(F.array(
        F.col("code"), F.when(F.coalesce("map_conversion", F.lit(False)), "map_conversion_ignored"), F.when(F.col("identifiers") > 1, "multiple_representation_identifiers"),
        F.when(fine & (F.col("size") > MAX_ABS / 10), "large_coordinate_magnitude"), F.when(fine & F.col("centroid_kind").isNull(), "centroid_unsupported_topology"), F.when(fine, F.col("orientation_issue")),
    ))
    counted = fine | (F.col("code") == "degenerate_extent")
    return facts.select(
        "element_id", status.alias("status"), F.sort_array(F.array_distinct(issues)).alias("issues"), F.when(counted, F.col("vertices")).alias("vertex_count"), F.when(counted, F.coalesce("triangles", F.lit(0))).alias("triangle_count"),
        *(F.when(fine, F.col(f"{x}{k}")).alias(f"{x}{k}") for x in AXES for k in (0, 1)), *(F.when(fine, _quantised(middle[x])).alias(f"r{x}") for x in AXES), *(_quantised(centre[x]).alias(f"c{x}") for x in AXES),
        "centroid_kind", F.when(fine, F.col("axis")).alias("axis"), F.when(fine, F.col("separation")).alias("separation"),
    )


def contract_issues(facts: DataFrame) -> DataFrame:
    """Facts that break a rule, with the first they break: a valid one without a box or with
    a fatal issue, a box or counts that the status doesn't allow, a box upside down or without
    extent, a centre outside its box, a centre without a kind."""
    box, measured = F.col("x0").isNotNull(), F.col("status").isin("valid", "partial")
    outside = F.lit(False)
    upside = F.lit(False)
    for x in AXES:
        outside = outside | (F.col(f"c{x}") < F.col(f"{x}0") - 1e-6) | (F.col(f"c{x}") > F.col(f"{x}1") + 1e-6)
        upside = upside | (F.col(f"{x}0") > F.col(f"{x}1"))
    rule = (
        F.when((F.col("status") == "valid") & ~box, "valid_without_box").when((F.col("status") == "valid") & F.arrays_overlap("issues", F.array(*map(F.lit, FATAL))), "valid_with_fatal_issue").when(box & ~measured, "box_not_allowed")
        .when(F.col("vertex_count").isNotNull() & ~(measured | F.col("status").isin("degenerate_geometry", "resource_limit_exceeded")), "counts_not_allowed").when(F.col("cx").isNull() != F.col("centroid_kind").isNull(), "centroid_without_kind")
        .when(F.coalesce(upside, F.lit(False)), "box_upside_down").when((F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1")) & (F.col("z0") == F.col("z1")), "box_without_extent").when(F.coalesce(outside, F.lit(False)), "centroid_outside_box")
    )
    return facts.withColumn("rule", rule).where("rule IS NOT NULL").select("element_id", "status", "rule")

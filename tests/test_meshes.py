"""Mesh facts where the queries have nothing to say: gaps, empties, single points."""

from __future__ import annotations

from plumbline.operators import meshes

ELEMENTS = "element_id int, unit string, unit_issue string, has_representation boolean, reading string, identifiers int, map_conversion boolean"


def facts(spark, elements, vertices, triangles):
    e = spark.createDataFrame([(k, "METRE", None, True, None, 1, False) if isinstance(k, int) else k for k in elements], ELEMENTS)
    v = spark.createDataFrame(vertices, "element_id int, vertex int, x double, y double, z double")
    t = spark.createDataFrame(triangles, "element_id int, a int, b int, c int")
    return {r["element_id"]: r for r in meshes.mesh_facts(e, v, t).collect()}


def test_gaps(spark):
    flat = [(0.0, 0.0, 0.0), (4.0, 0.0, 0.0), (0.0, 2.0, 0.0), (4.0, 2.0, 0.0)]
    vertices = [(1, k, *p) for k, p in enumerate(flat)] + [(2, 0, None, 0.0, 0.0), (3, 0, 1.0, 1.0, 1.0), (4, 0, 0.0, 0.0, 0.0), (4, 1, 1.0, 0.0, 0.0), (4, 2, 1e-9, 1.0, 0.0), (9, 0, 1.0, 1.0, 1.0)]
    triangles = [(1, 0, 1, 2), (1, 3, 2, 1), (4, 0, 1, 2), (9, 0, 0, 0)]
    got = facts(spark, [1, 2, 3, 4, 5, (6, None, None, None, None, None, None), (7, "METRE", None, None, None, None, None), (8, None, "unit_inconsistent", True, "timeout", 2, True)], vertices, triangles)
    assert {k: (r["status"], r["issues"]) for k, r in got.items()} == {
        1: ("valid", []), 2: ("non_finite_geometry", ["non_finite_coordinate"]), 3: ("degenerate_geometry", ["degenerate_extent"]), 4: ("partial", ["orientation_degenerate"]), 5: ("empty_geometry", ["empty_triangulation"]),
        6: ("unit_undetermined", ["unit_unresolvable"]), 7: ("missing_representation", ["no_representation"]), 8: ("unit_undetermined", ["map_conversion_ignored", "multiple_representation_identifiers", "unit_inconsistent"]),
    }
    assert (got[1]["cx"], got[1]["cy"], got[1]["centroid_kind"], got[1]["axis"]) == (2.0, 1.0, "surface", [1.0, 0.0, 0.0])
    assert got[3]["vertex_count"] == 1 and got[3]["triangle_count"] == 0 and got[2]["vertex_count"] is None
    assert facts(spark, [], [], []) == {} and facts(spark, [1], [], [])[1]["status"] == "empty_geometry"


def test_welding_closes_a_mesh(spark):
    """A tetrahedron whose faces have corners of their own, apart by less than the quantum."""
    corners = [(0.0, 0.0, 0.0), (3.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
    faces = [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)]
    vertices = [(1, 3 * f + k, *(c + 1e-8 * f for c in corners[v])) for f, face in enumerate(faces) for k, v in enumerate(face)]
    got = facts(spark, [1], vertices, [(1, 3 * f, 3 * f + 1, 3 * f + 2) for f in range(4)])[1]
    assert got["centroid_kind"] == "volume" and (got["cx"], got["cy"], got["cz"]) == (0.75, 0.25, 0.25)
    assert facts(spark, [1], vertices, [(1, 3 * f, 3 * f + 1, 3 * f + 2) for f in range(3)])[1]["centroid_kind"] == "surface"


def test_far_from_the_origin(spark):
    """A box of 2.25 by 2 by 1 at 900000: its centre is as exact as that of one at 0."""
    corners = [((k & 1) * 2.25, (k >> 1 & 1) * 2.0, float(k >> 2)) for k in range(8)]
    faces = [(0, 2, 3), (0, 3, 1), (0, 1, 5), (0, 5, 4), (2, 6, 7), (2, 7, 3), (0, 4, 6), (0, 6, 2), (1, 3, 7), (1, 7, 5), (4, 5, 7), (4, 7, 6)]
    vertices = [(e, k, x + at, y + at, z) for e, at in ((1, 0.0), (2, 900000.0)) for k, (x, y, z) in enumerate(corners)]
    got = facts(spark, [1, 2], vertices, [(e, *f) for e in (1, 2) for f in faces])
    assert (got[1]["cx"], got[1]["cy"], got[1]["cz"]) == (1.125, 1.0, 0.5) and (got[2]["cx"], got[2]["cy"], got[2]["cz"]) == (900001.125, 900001.0, 0.5)
    assert got[2]["centroid_kind"] == "volume" and got[2]["issues"] == ["large_coordinate_magnitude"]

"""Property facts from nested values against a plain recursion."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from plumbline.operators import unpivot

OCC = "project_id string, element_id string, origin string, source string, container string, property_name string, j string"


def made(spark, rows):
    full = [("p", e, origin, "pset", "C", name, v if isinstance(v, str) or v is None else json.dumps(v)) for e, origin, name, v in rows]
    return spark.createDataFrame(full, OCC).withColumn("value", F.parse_json("j"))


def netstring(s):
    return f"{len(s.encode())}:{s}"


def walk(node, path=(), depth=0):
    """(key, tag, value, unit) of every leaf in order, or the code that drops the property."""
    key = lambda leaf: leaf if not path else f"child:{len(path):06}:{''.join(map(netstring, path))}:{leaf}"
    tag = lambda v: "null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "float" if isinstance(v, float) else "text"
    kind, unit = node["kind"], node.get("unit")
    if kind == "complex":
        out = []
        for child in node["children"]:
            if depth + 1 > 8:
                return "DEPTH_LIMIT_EXCEEDED"
            got = walk(child, (*path, child["name"]), depth + 1)
            if isinstance(got, str):
                return got
            out += got
        return out
    if kind == "single":
        leaves = [("0", node.get("value"))]
    elif kind == "list":
        leaves = [(f"item:{i:06}", v) for i, v in enumerate(node["items"])]
    elif kind == "table":
        leaves = [(f"row:{i:06}:{half}", v) for i, r in enumerate(node["rows"]) for half, v in zip(("defining", "defined"), r, strict=True)]
    else:
        leaves = [(b, node[b]) for b in ("lower", "upper", "setpoint") if node.get(b) is not None]
    if any(isinstance(v, dict) for _, v in leaves):
        return "NON_FINITE_VALUE"
    return [(key(leaf), tag(v), v, unit if kind != "table" else node.get(f"{leaf[11:]}_unit")) for leaf, v in leaves]


def any_node(rng, depth=0):
    scalar = lambda: rng.choice([1, -7, 0, 2.5, 0.0, "x", "é:", True, False, None, *([{"float": "NaN"}] if rng.random() < 0.2 else [])])
    kind = rng.choice(["single", "list", "table", "bounded", *["complex"] * (3 if depth < 10 else 0)])
    node = {"kind": kind, "unit": rng.choice(["m", None])}
    if kind == "complex":
        return node | {"children": [any_node(rng, depth + 1) | {"name": rng.choice(["a", "b:", "ção", ""]) + str(k)} for k in range(rng.choice([0, 1, 1, 2]))]}
    if kind == "single":
        return node | {"value": scalar()}
    if kind == "list":
        return node | {"items": [scalar() for _ in range(rng.randint(0, 3))]}
    if kind == "table":
        return node | {"rows": [[scalar(), scalar()] for _ in range(rng.randint(0, 2))], "defined_unit": "kg"}
    return node | {"lower": scalar(), "setpoint": scalar()}


def test_random_values(spark):
    rng = random.Random(8)
    values = {f"e{k}": any_node(rng) for k in range(150)}
    for deep in (8, 9):
        values[f"deep{deep}"] = {"kind": "single", "value": 1}
        for _ in range(deep):
            values[f"deep{deep}"] = {"kind": "complex", "children": [values[f"deep{deep}"] | {"name": "n"}]}
    facts, said = unpivot.property_facts(made(spark, [(e, "instance", "Prop", v) for e, v in values.items()]))
    got: dict = {e: [] for e in values}
    for r in facts.collect():
        v = r["value"]
        shown = {"null": None, "text": v["value_text"], "integer": v["value_integer"], "float": v["value_number"], "boolean": v["value_boolean"]}[v["value_type"]]
        got[r["element_id"]].append((r["occurrence_key"], v["value_type"], shown, r["unit"]))
    codes = {r["element_id"]: r["code"] for r in said.where(F.col("code").isin(unpivot.HARD)).collect()}
    want = {e: walk(v) for e, v in values.items()}
    assert {e: w for e, w in want.items() if isinstance(w, str)} == codes and {"DEPTH_LIMIT_EXCEEDED", "NON_FINITE_VALUE"} <= set(codes.values())
    assert {e: sorted(g, key=str) for e, g in got.items()} == {e: [] if isinstance(w, str) else sorted(w, key=str) for e, w in want.items()}
    keys = facts.select("occurrence_key", unpivot.parsed_key(F.col("occurrence_key")).alias("p")).where("p IS NOT NULL")
    again = keys.select("occurrence_key", unpivot.key_of(F.col("p.path"), F.col("p.leaf")).alias("k"))
    assert again.count() == facts.count() and again.where("k <> occurrence_key").count() == 0


def test_keys_that_are_none(spark):
    bad = ["", "1", "item:12", "item:0000012", "row:000001:other", "child:000001:2:a:0", "child:000001:1:a0", "child:1:1:a:0", "child:000002:1:a:0", "child:000001:1:a:what", "child:000000::0"]
    df = spark.createDataFrame([(b,) for b in [*bad, None]], "k string")
    assert df.where(unpivot.parsed_key(F.col("k")).isNotNull()).collect() == []


def test_limits_origins_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(unpivot, "MAX_FACTS", 3)
    one, two = {"kind": "single", "value": 1}, {"kind": "single", "value": 2}
    rows = [
        ("a", "instance", "P", one), ("a", "type", "P", one), ("b", "type", "P", two), ("c", "instance", "P", one), ("c", "instance", "P", {"unit": None, **one}), ("d", "instance", "P", one), ("d", "instance", "P", two), ("d", "type", "P", one),
        ("e", "instance", "  ", one), ("f", "instance", "P", None), ("g", "instance", "P", {"kind": "list", "items": [0] * 4097}), ("h", "instance", "P", {"kind": "table", "rows": [[0, 0]] * 4097}), ("i", "instance", "P", {"kind": "list", "items": [1, 2, 3, 4]}),
        ("j", "instance", "P", {"kind": "single", "value": 1, "unit_status": "incompatible"}), ("k", "instance", "P", {"kind": "single", "value": 1, "unit_status": "unknown"}), ("l", "instance", "P", '{"kind":"single","value":99999999999999999999}'),
        ("m", "instance", "P", {"kind": "complex", "children": [{"name": "x", **one}, {"name": "x", **one}, {"name": "y", **one}, {"name": "y", **two}]}), ("n", "instance", "P", {"kind": "complex", "children": []}), ("o", "instance", "P", {"kind": "single"}),
        ("q", "instance", "P", {"kind": "single", "value": {"float": "Infinity"}}), ("q", "type", "P", one),
    ]
    facts, said = unpivot.property_facts(made(spark, rows))
    per = {r["element_id"]: r["n"] for r in facts.groupBy("element_id").agg(F.count("*").alias("n")).collect()}
    assert per == {"a": 1, "b": 1, "c": 1, "i": 4, "k": 1, "m": 1, "o": 1}
    assert {(r["element_id"], r["code"], r["fatal"], r["n"]) for r in said.collect()} == {
        ("c", "REDUNDANT_DUPLICATE", False, 1), ("d", "AMBIGUOUS_SLOT", True, 1), ("e", "EMPTY_PROPERTY_NAME", False, 1), ("f", "UNKNOWN_KIND", False, 1), ("g", "LIST_LIMIT_EXCEEDED", False, 1), ("h", "TABLE_LIMIT_EXCEEDED", False, 1), ("i", "FACTS_PER_ELEMENT_LIMIT", True, 4),
        ("j", "INCOMPATIBLE_UNIT", False, 1), ("k", "UNKNOWN_UNIT", False, 1), ("l", "INTEGER_OUT_OF_RANGE", False, 1), ("m", "REDUNDANT_DUPLICATE", False, 1), ("m", "FACT_ID_COLLISION", True, 1), ("q", "NON_FINITE_VALUE", False, 1),
    }
    facts, said = unpivot.property_facts(made(spark, []))
    assert facts.collect() == [] and said.collect() == []


def test_materials_and_associations_without_anything(spark):
    none = spark.createDataFrame([(1, None), (2, "{}"), (3, '{"type":"IfcMaterialList"}'), (4, '{"type":"IfcMaterialList","Materials":[]}')], "k int, j string").select("k", F.parse_json("j").alias("h"))
    assert [(r["k"], r["name"], r["issue"]) for r in unpivot.holder_materials(none, "k", "h").collect()] == [(2, None, "MATERIAL_WITHOUT_NAME")]
    blank = spark.createDataFrame([("p", "e", k, *[None] * 9) for k in ("classification", "document", None, "x")], "project_id string, element_id string, kind string, system string, code string, name string, edition string, location string, identification string, description string, scope string, purpose string")
    links = unpivot.associations(blank)
    assert sorted(r["warning"] for r in links.collect()) == ["MISSING_SYSTEM", "MISSING_URI"] and unpivot.documents(links).count() == 0


def test_tables_of_occurrences_are_not_broadcast(spark, monkeypatch):
    """However small their files are: they have a row for each occurrence."""
    from plumbline.plans import registry
    from plumbline.sources.work import Work

    plans, written = {}, Work.written

    def seen(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(self, df, name)

    monkeypatch.setattr(Work, "written", seen)
    registry.queries()["K4_diagnostics"](spark, "/root/testdata/sf0.001")
    assert all("SortMergeJoin" in plans[n] and "Broadcast" not in plans[n] for n in ("slots", "facts"))

"""Queries of property facts from nested values, associations and materials."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import unpivot
from plumbline.sources import projections

from .views import table

Q: dict = {}
SQL: dict = {}


def _add(name, run, sql=None):
    Q[name] = run
    if sql:
        SQL[name] = sql


# Parts as properties: each eighth is of one kind, with the part's own numbers and name in it.
_KINDS = [
    """'{"kind":"single","unit":"mm","value":' || p_size || '}'""",
    """'{"kind":"list","items":[' || p_size || ',0.5,null,"' || p_name || '"]}'""",
    """CASE WHEN p_partkey % 16 = 2 THEN '{"kind":"enumerated","items":[]}' ELSE '{"kind":"enumerated","items":["a","b"]}' END""",
    """'{"kind":"bounded","lower":' || p_size || ',"upper":null,"setpoint":' || (p_size + 1) || '}'""",
    """'{"kind":"table","defining_unit":"m","rows":[[1,"' || p_name || '"],[2,true]]}'""",
    """'{"kind":"reference"}'""",
    """'{"kind":"complex","children":[{"name":"a","kind":"single","value":' || p_size || '},{"name":"b:é","kind":"complex","children":[{"name":"c","kind":"list","items":["' || p_name || '"]}]}]}'""",
    """'{"kind":"complex","children":[{"name":"a","kind":"single","value":1},{"name":"b","kind":"single","value":{"float":"NaN"}}]}'""",
]


def _occurrences(s, d):
    """Instances (four of five; some twice, some contradicted) and types (every third)."""
    p = table(s, d, "part").withColumn("own", F.expr("CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_KINDS)) + " END"))
    keys = [F.lit("p").alias("project_id"), F.col("p_partkey").cast("string").alias("element_id")]
    rest = [F.lit("pset").alias("source"), F.lit("C").alias("container"), F.lit("Prop").alias("property_name")]
    row = lambda df, origin, j: df.select(*keys, F.lit(origin).alias("origin"), *rest, F.parse_json(j).alias("value"))
    instance = p.where("p_partkey % 5 <> 0")
    out = row(instance, "instance", F.col("own")).unionByName(row(instance.where("p_partkey % 7 = 0"), "instance", F.col("own")))
    out = out.unionByName(row(instance.where("p_partkey % 11 = 0"), "instance", F.lit('{"kind":"single","value":-1}')))
    return out.unionByName(row(p.where("p_partkey % 3 = 0"), "type", F.lit('{"kind":"single","value":99}')))


def _facts(s, d):
    v = F.col("value")
    shown = F.coalesce(v["value_text"], v["value_integer"].cast("string"), v["value_number"].cast("string"), v["value_boolean"].cast("string"))
    return unpivot.property_facts(_occurrences(s, d))[0].select(F.col("element_id").cast("bigint").alias("k"), "origin", "occurrence_key", v["value_type"].alias("value_type"), shown.alias("value"), "unit", "fact_id")


_LEAF = """CASE p_partkey % 8
  WHEN 0 THEN [['0', 'integer', CAST(p_size AS VARCHAR), 'mm']]
  WHEN 1 THEN [['item:000000', 'integer', CAST(p_size AS VARCHAR), NULL], ['item:000001', 'float', '0.5', NULL], ['item:000002', 'null', NULL, NULL], ['item:000003', 'text', p_name, NULL]]
  WHEN 2 THEN CASE WHEN p_partkey % 16 = 2 THEN [] ELSE [['item:000000', 'text', 'a', NULL], ['item:000001', 'text', 'b', NULL]] END
  WHEN 3 THEN [['lower', 'integer', CAST(p_size AS VARCHAR), NULL], ['setpoint', 'integer', CAST(p_size + 1 AS VARCHAR), NULL]]
  WHEN 4 THEN [['row:000000:defining', 'integer', '1', 'm'], ['row:000000:defined', 'text', p_name, NULL], ['row:000001:defining', 'integer', '2', 'm'], ['row:000001:defined', 'boolean', 'true', NULL]]
  WHEN 6 THEN [['child:000001:1:a:0', 'integer', CAST(p_size AS VARCHAR), NULL], ['child:000002:4:b:é1:c:item:000000', 'text', p_name, NULL]]
  ELSE [] END"""
_add(
    "K2_property_facts",
    _facts,
    f"""WITH f AS (SELECT p_partkey AS k, 'instance' AS origin, unnest({_LEAF}) AS l FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 11 <> 0
        UNION ALL SELECT p_partkey, 'type', ['0', 'integer', '99', NULL] FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 3 = 0)
      SELECT k, origin, l[1] AS occurrence_key, l[2] AS value_type, l[3] AS value, l[4] AS unit,
        'pf_' || substr(sha256('1:p' || strlen(CAST(k AS VARCHAR)) || ':' || k || '4:pset' || '1:C' || '4:Prop' || strlen(l[1]) || ':' || l[1]), 1, 32) AS fact_id FROM f""",
)
_add(
    "K4_diagnostics",
    lambda s, d: unpivot.property_facts(_occurrences(s, d))[1].groupBy("code", "fatal").agg(F.sum("n").alias("n")),
    """WITH i AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 11 <> 0)
      SELECT * FROM (SELECT 'AMBIGUOUS_SLOT' AS code, true AS fatal, count(*) AS n FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 11 = 0
        UNION ALL SELECT 'TYPE_OVERRIDE', false, count(*) FROM i WHERE k % 3 = 0 AND k % 8 <> 7 UNION ALL SELECT 'NON_FINITE_VALUE', false, count(*) FROM i WHERE k % 8 = 7 UNION ALL SELECT 'REDUNDANT_DUPLICATE', false, count(*) FROM i WHERE k % 7 = 0
        UNION ALL SELECT 'EMPTY_ENUM', false, count(*) FROM i WHERE k % 16 = 2 UNION ALL SELECT 'REFERENCE_UNSUPPORTED_V1', false, count(*) FROM i WHERE k % 8 = 5 UNION ALL SELECT 'NULL_ITEM', false, count(*) FROM i WHERE k % 8 = 1) WHERE n > 0""",
)
_add(
    "K3_key_round_trip",
    lambda s, d: unpivot.property_facts(_occurrences(s, d))[0].select("fact_id", unpivot.parsed_key(F.col("occurrence_key")).alias("p")).groupBy(F.array_join("p.path", "/").alias("path"), F.col("p.leaf").alias("leaf")).agg(F.count("*").alias("n")),
    """WITH i AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 11 <> 0), t AS (SELECT count(*) AS n FROM part WHERE p_partkey % 15 = 0),
      c AS (SELECT k % 8 AS kind, k % 16 = 2 AS bare, count(*) AS n FROM i GROUP BY ALL), leafs AS (SELECT kind, unnest(CASE kind WHEN 0 THEN ['/0'] WHEN 1 THEN ['/item:000000', '/item:000001', '/item:000002', '/item:000003'] WHEN 2 THEN CASE WHEN bare THEN [] ELSE ['/item:000000', '/item:000001'] END
        WHEN 3 THEN ['/lower', '/setpoint'] WHEN 4 THEN ['/row:000000:defining', '/row:000000:defined', '/row:000001:defining', '/row:000001:defined'] WHEN 6 THEN ['a/0', 'b:é/c/item:000000'] ELSE [] END) AS l, n FROM c
        UNION ALL SELECT 0, '/0', n FROM t)
      SELECT CASE WHEN l LIKE '/%' THEN '' ELSE regexp_replace(l, '/[^/]*$', '') END AS path, regexp_extract(l, '[^/]*$') AS leaf, CAST(sum(n) AS BIGINT) AS n FROM leafs GROUP BY ALL HAVING sum(n) > 0""",
)


def _associated(s, d):
    """Every order of a customer as an association: classifications and documents, some incomplete."""
    k = F.col("o_orderkey")
    v = lambda cond, x: F.when(cond, x)
    none = F.lit(None).cast("string")
    return table(s, d, "orders").select(
        F.lit("p").alias("project_id"), (F.col("o_custkey") % 50).cast("string").alias("element_id"), F.when(k % 3 == 0, "classification").when(k % 3 == 1, "document").otherwise("other").alias("kind"),
        v(k % 4 > 0, F.col("o_orderstatus")).alias("system"), v(k % 5 > 0, F.col("o_orderpriority")).alias("code"), F.concat(F.lit("t"), (k % 2).cast("string")).alias("name"), F.lit(" ").alias("edition"),
        v(k % 7 > 0, F.concat(F.lit("u"), (k % 40).cast("string"))).alias("location"), v(k % 2 > 0, F.lit("")).alias("identification"), none.alias("description"), v(k % 80 < 40, F.lit("scope")).alias("scope"), none.alias("purpose"),
    )


_add(
    "K12_associations",
    lambda s, d: unpivot.associations(_associated(s, d)).groupBy("kind", F.coalesce("warning", F.lit("")).alias("warning")).agg(F.count("*").alias("n"), F.count_distinct("classification_id").alias("ids")),
    """WITH a AS (SELECT o_orderkey AS k, o_custkey % 50 AS e, o_orderstatus AS s, o_orderpriority AS c FROM orders WHERE o_orderkey % 3 < 2),
      w AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'classification' ELSE 'document' END AS kind, CASE WHEN k % 3 = 0 AND k % 4 = 0 THEN 'MISSING_SYSTEM' WHEN k % 3 = 0 AND k % 5 = 0 THEN 'MISSING_CODE' WHEN k % 3 = 1 AND k % 7 = 0 THEN 'MISSING_URI' ELSE '' END AS warning FROM a)
      SELECT kind, warning, count(*) AS n, count(DISTINCT CASE WHEN kind = 'classification' AND warning = '' THEN e || '|' || s || '|' || c END) AS ids FROM w GROUP BY ALL""",
)
_add(
    "K12_documents",
    lambda s, d: unpivot.documents(unpivot.associations(_associated(s, d))).select("uri", "title", "document_type", F.array_join("linked_element_ids", ",").alias("elements"), "title_conflict", "type_conflict"),
    """WITH a AS (SELECT 'u' || o_orderkey % 40 AS uri, 't' || o_orderkey % 2 AS title, CASE WHEN o_orderkey % 80 < 40 THEN 'scope' ELSE 'document' END AS type, CAST(o_custkey % 50 AS VARCHAR) AS e FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 7 > 0)
      SELECT uri, min(title) AS title, min(type) AS document_type, array_to_string(list_sort(list_distinct(list(e))), ',') AS elements, count(DISTINCT title) > 1 AS title_conflict, count(DISTINCT type) > 1 AS type_conflict FROM a GROUP BY uri""",
)


def _holders(s, d):
    """Parts as holders of every shape."""
    m = lambda inner: '{"Name":"' + inner + '"}'
    refers = """'{"Material":{"Name":"' || p_name || '"}},{"Material":{"Name":" "}},{"x":1}'"""
    shapes = [
        """'{"type":"IfcMaterial","Name":"' || p_brand || '"}'""", f"""'{{"type":"IfcMaterialLayerSetUsage","ForLayerSet":{{"MaterialLayers":[' || {refers} || ']}}}}'""", f"""'{{"type":"IfcMaterialLayerSet","MaterialLayers":[' || {refers} || ']}}'""",
        """'{"type":"IfcMaterialLayer","Material":{"Name":"' || p_name || '"}}'""", f"""'{{"type":"IfcMaterialConstituentSet","MaterialConstituents":[' || {refers} || ']}}'""", f"""'{{"type":"IfcMaterialList","Materials":[{m("a")},' || '{{"Name":"' || p_brand || '"}}' || ']}}'""",
        f"""'{{"type":"IfcMaterialProfileSetUsage","ForProfileSet":{{"MaterialProfiles":[' || {refers} || ']}}}}'""", f"""'{{"type":"IfcMaterialProfileSet","MaterialProfiles":[' || {refers} || ']}}'""", """'{"type":"IfcOther"}'""", "NULL",
    ]
    j = F.expr("CASE p_partkey % 10 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(shapes)) + " END")
    return table(s, d, "part").select(F.col("p_partkey").alias("key"), F.try_parse_json(j).alias("holder"))


_add(
    "K11_holder_materials",
    lambda s, d: unpivot.holder_materials(_holders(s, d), "key", "holder"),
    """WITH r AS (SELECT p_partkey AS key, p_partkey % 10 AS k, p_name, p_brand FROM part),
      e AS (SELECT key, unnest(CASE WHEN k = 0 THEN [{'o': 0, 'n': p_brand, 'r': NULL}] WHEN k IN (1, 2, 4, 6, 7) THEN [{'o': 0, 'n': p_name, 'r': x}, {'o': 1, 'n': NULL, 'r': x}, {'o': 2, 'n': NULL, 'r': x}]
        WHEN k = 3 THEN [{'o': 0, 'n': p_name, 'r': 'layer'}] WHEN k = 5 THEN [{'o': 0, 'n': 'a', 'r': NULL}, {'o': 1, 'n': p_brand, 'r': NULL}] WHEN k = 8 THEN [{'o': 0, 'n': NULL, 'r': NULL}] ELSE [] END) AS e
        FROM (SELECT *, CASE WHEN k IN (1, 2) THEN 'layer' WHEN k = 4 THEN 'constituent' ELSE 'profile' END AS x FROM r))
      SELECT key, CAST(e.o AS INTEGER) AS ordinal, e.n AS name, e.r AS role, CASE WHEN e.n IS NULL THEN 'MATERIAL_WITHOUT_NAME' END AS issue FROM e""",
)


def _records(s, d):
    """Parts as property facts, each ninth of one kind of value, some of which can't be stored."""
    kinds = [("int", "CAST(p_size AS STRING)"), ("float", "p_size || '.5'"), ("bool", "CAST(p_size % 2 = 0 AS STRING)"), ("text", "p_name"), ("null", "NULL"), ("null", "'x'"), ("int", "'99999999999999999999'"), ("float", "'1e999'"), ("bool", "'yes'"), ("date", "'x'"), ("int", "'1.0'")]
    pick = lambda at: F.expr("CASE p_partkey % 11 " + " ".join(f"WHEN {k} THEN {x[at] if at else repr(x[0])}" for k, x in enumerate(kinds)) + " END")
    text = F.col("p_partkey").cast("string")
    fixed = {c: F.lit(c) for c in ("project_id", "element_id", "source", "container", "property_name", "property_name_norm", "occurrence_key", "unit")}
    return table(s, d, "part").select(F.when(F.col("p_partkey") % 50 > 0, text).alias("fact_id"), *(v.alias(c) for c, v in fixed.items()), pick(0).alias("value_type"), pick(1).cast("string").alias("value"))


_add(
    "B19_property_projection",
    lambda s, d: projections.projected(_records(s, d), "property_fact").select("fact_id", "refused", "value_type", "value_is_null", "value_text", "value_integer", "value_number", "value_boolean"),
    """WITH p AS (SELECT CASE WHEN p_partkey % 50 > 0 THEN CAST(p_partkey AS VARCHAR) END AS fact_id, p_partkey % 11 AS k, p_size AS z, p_name AS n, p_partkey % 50 > 0 AND p_partkey % 11 < 5 AS good FROM part)
      SELECT fact_id, CASE WHEN fact_id IS NULL THEN 'missing_id' ELSE ['null_with_payload', 'int_out_of_range', 'not_finite', 'wrong_payload', 'unknown_value_type', 'wrong_payload'][CASE WHEN k >= 5 THEN k - 4 END] END AS refused,
        CASE WHEN good THEN ['int', 'float', 'bool', 'text', 'null'][k + 1] END AS value_type, CASE WHEN good THEN k = 4 END AS value_is_null, CASE WHEN good AND k = 3 THEN n END AS value_text, CASE WHEN good AND k = 0 THEN CAST(z AS BIGINT) END AS value_integer,
        CASE WHEN good AND k = 1 THEN z + 0.5::DOUBLE END AS value_number, CASE WHEN good AND k = 2 THEN z % 2 = 0 END AS value_boolean FROM p""",
)
_add(
    "B24_bounded_report",
    lambda s, d: projections.bounded_report(projections.projected(_records(s, d), "property_fact").where("fact_id IS NOT NULL").select("fact_id", F.coalesce("refused", F.lit("stored")).alias("outcome")), "fact_id", "outcome", 100)[1],
    """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS fact_id, CASE WHEN p_partkey % 11 < 5 THEN 'stored' ELSE ['null_with_payload', 'int_out_of_range', 'not_finite', 'wrong_payload', 'unknown_value_type', 'wrong_payload'][p_partkey % 11 - 4] END AS outcome FROM part WHERE p_partkey % 50 > 0)
      SELECT fact_id, outcome, (SELECT count(*) FROM p) > 100 AS truncated FROM p ORDER BY fact_id LIMIT 100""",
)

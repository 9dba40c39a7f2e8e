"""Questions made of the table's own words and numbers, so that every row has another one."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import questions

from .views import dealt, table

Q: dict = {}
SQL: dict = {}


def _add(name, question, shown, sql):
    def run(s, d):
        rows = dealt(table(s, d, "part"), "p_partkey").select("p_partkey", F.expr(question).alias("q"))
        return questions.asked(rows, "q", "a").select("p_partkey", shown().alias("answer"))

    Q[name], SQL[name] = run, sql


_ORDINALS = "['primeiro', 'segundo', 'terceiro', 'quarto', 'quinto', 'sexto', 'sétimo', 'oitavo', 'nono', 'décimo']"
_add(
    "H7_storey_made",
    f"""concat_ws(' ', p_name, 'em', CASE p_partkey % 9 WHEN 0 THEN 'Piso 0' || p_size WHEN 1 THEN p_size || '.º andar' WHEN 2 THEN get(array{_ORDINALS.replace('[', '(').replace(']', ')')}, p_size % 10) || ' piso' WHEN 3 THEN 'nível ' || get(array{_ORDINALS.replace('[', '(').replace(']', ')')}, p_size % 10)
      WHEN 4 THEN 'storey ' || char(97 + p_partkey % 26) || p_size WHEN 5 THEN 'no rés-do-chão' WHEN 6 THEN 'andar -' || p_size WHEN 7 THEN 'piso: ' || p_size ELSE 'escavar' END, CASE WHEN p_partkey % 2 = 0 THEN 'ou na cave?' ELSE '!' END)""",
    lambda: F.col("a.storey"),
    """SELECT p_partkey, coalesce(CASE p_partkey % 9 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN CAST(p_size % 10 + 1 AS VARCHAR) WHEN 3 THEN CAST(p_size % 10 + 1 AS VARCHAR) WHEN 4 THEN upper(chr(CAST(97 + p_partkey % 26 AS INTEGER))) || p_size
      WHEN 5 THEN '0' WHEN 6 THEN CASE WHEN p_size = 0 THEN '0' ELSE '-' || p_size END END, CASE WHEN p_partkey % 2 = 0 THEN '-1' END) AS answer FROM part""",
)
_PHRASES = ["id do projeto", "quantos por andar", "quais são os meus projectos", "que materiais", "a classificação", "os níveis", "tipos de coisas", "contagem", "olhar", "número de coisas"]
_FIELDS = ["project_id", "storey", "project", "material", "classification", "storey", "ifc_class", "count", None, "count"]
_RANKS = [1, 2, 3, 4, 5, 6, 7, 8, 99, 8]
_listed = ", ".join(f"'{p}'" for p in _PHRASES)
_add(
    "H10_field_made",
    f"concat_ws(' e ', get(array({_listed}), p_partkey % 10), p_name, get(array({_listed}), (p_partkey div 10) % 10))",
    lambda: F.col("a.agg_field"),
    f"""WITH f AS (SELECT p_partkey, p_partkey % 10 + 1 AS i, p_partkey // 10 % 10 + 1 AS j, {_RANKS} AS r, [{", ".join("NULL" if x is None else f"'{x}'" for x in _FIELDS)}] AS n FROM part)
      SELECT p_partkey, CASE WHEN r[i] <= r[j] THEN n[i] ELSE n[j] END AS answer FROM f""",
)
_add(
    "H11_names_made",
    """CASE p_partkey % 5 WHEN 0 THEN 'mostra "' || p_name || '" do modelo ' || p_brand || ' com vidro' WHEN 1 THEN 'o ' || replace(p_name, ' ', '_') || ' e código do projecto ' || p_brand || '_x' WHEN 2 THEN 'projeto ' || p_name || ', piso ' || p_size
      WHEN 3 THEN 'id do projeto ' || p_name ELSE 'no ' || p_type || ' a ' || replace(p_name, ' ', '_') || '?' END""",
    lambda: F.concat_ws("|", *(F.coalesce(F.col(f"a.{n}"), F.lit("")) for n in ("name", "project_id", "project_name"))),
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || '||' || p_brand WHEN 1 THEN replace(p_name, ' ', '_') || '|' || regexp_extract(p_brand, '^[A-Za-z0-9_-]+') || '|' WHEN 2 THEN '||' || p_name WHEN 3 THEN '||' ELSE replace(p_name, ' ', '_') || '||' END AS answer FROM part""",
)


def _conditions():
    return F.array_join(F.transform("a.conditions", lambda c: F.concat_ws(" ", c["field"], c["op"], F.format_number(c["value"], 3))), ",")


_add(
    "H8_conditions_made",
    """concat_ws(' ', p_name, CASE p_partkey % 6 WHEN 0 THEN 'com altura maior que ' || p_size || ' m' WHEN 1 THEN 'entre ' || p_size || ' e ' || (p_size + 2) || ' metros' WHEN 2 THEN 'menos de ' || p_size || ',5 m2 de area' WHEN 3 THEN 'espessura de pelo menos ' || p_size || ' cm'
      WHEN 4 THEN 'volume menor que ' || p_size || ' m2' ELSE 'peso de ' || p_size || ' m' END)""",
    _conditions,
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN printf('height gt %.3f', p_size::DOUBLE) WHEN 1 THEN printf('height gte %.3f,height lte %.3f', p_size::DOUBLE, p_size + 2.0) WHEN 2 THEN printf('area lt %.3f', p_size + 0.5) WHEN 3 THEN printf('thickness gte %.3f', p_size / 100.0) ELSE '' END AS answer FROM part""",
)

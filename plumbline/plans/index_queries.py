"""Queries over stored inverted indices, and vectors searched in blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import inverted, ranking, retrieval

from .views import table

Q: dict = {}
SQL: dict = {}
_stored: dict[tuple, inverted.Index] = {}


def _add(name, run, sql=None):
    Q[name] = run
    if sql:
        SQL[name] = sql


def stored(s, d, name, make) -> inverted.Index:
    """An index of a table, built once for each folder in an application."""
    key = (s.sparkContext.applicationId, d, name)
    if key not in _stored:
        _stored[key] = make()
    return _stored[key]


_terms = retrieval.analysed


def _chunk_index(s, d):
    fields = {"text": _terms(F.col("text")), "section_title": _terms(F.col("source")), "section_path": _terms(F.concat_ws(" ", "lang", "source"))}
    return stored(s, d, "chunks", lambda: inverted.build(table(s, d, "documents"), "doc_id", fields))


def _asked(s, d):
    q = table(s, d, "benchmark").where("item_id % 20 = 0")
    return q.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))


def _chunk_search(s, d):
    return inverted.search(_chunk_index(s, d), _asked(s, d), retrieval.CHUNK_FIELDS)


_SPLIT = lambda c: rf"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_SCORED = """post AS (SELECT id, field, part, term, dl, count(*) AS tf FROM (SELECT id, field, part, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY ALL),
  stats AS (SELECT field, count(*) AS n, avg(len(w)) AS avg_dl FROM t WHERE len(w) > 0 GROUP BY field),
  idf AS (SELECT field, term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post JOIN stats USING (field) GROUP BY field, term, n),
  fp AS (SELECT query_id, id, field, part, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS s FROM asked JOIN post USING (term) JOIN idf USING (field, term) JOIN stats USING (field) GROUP BY query_id, id, field, part),
  f AS (SELECT query_id, id, field, max(s) AS s FROM fp GROUP BY query_id, id, field)"""
_CHUNKS = rf"""t AS (SELECT doc_id AS id, 'text' AS field, 0 AS part, {_SPLIT('text')} AS w FROM documents UNION ALL SELECT doc_id, 'section_title', 0, {_SPLIT('source')} FROM documents
    UNION ALL SELECT doc_id, 'section_path', 0, {_SPLIT("concat_ws(' ', lang, source)")} FROM documents),
  asked AS (SELECT DISTINCT item_id AS query_id, unnest({_SPLIT('text')}) AS term FROM benchmark WHERE item_id % 20 = 0), {_SCORED},
  chunk_scores AS (SELECT query_id, id, round_even(sum(s * CASE field WHEN 'text' THEN 1.0 WHEN 'section_title' THEN 0.5 ELSE 0.25 END), 6) AS score FROM f GROUP BY query_id, id),
  chunk_ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM chunk_scores)"""
_add("G3_chunk_search", lambda s, d: _chunk_search(s, d), f"WITH {_CHUNKS} SELECT query_id, id, score, rank FROM chunk_ranks WHERE rank <= 200")
_add(
    "G3_chunk_search_among",
    lambda s, d: inverted.search(_chunk_index(s, d), _asked(s, d), retrieval.CHUNK_FIELDS, depth=20, among=table(s, d, "documents").where("lang = 'de'").select(F.col("doc_id").alias("id"))),
    f"WITH {_CHUNKS}, de AS (SELECT chunk_scores.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM chunk_scores JOIN documents ON id = doc_id WHERE lang = 'de') SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM de WHERE rank <= 20",
)


def _element_index(s, d):
    k = F.col("p_partkey")
    text = lambda *parts: _terms(F.concat_ws(" ", *parts))
    fields = {
        "name": text("p_name"), "semantic_label": text("p_type"), "object_type": text("p_brand"), "description": text("p_type", "p_name", F.lit("with a"), "p_type"), "site": text(F.lit("North")),
        "building": text(F.lit("B"), (k % 3).cast("string")), "storey": text(F.lit("piso"), (F.col("p_size") % 10).cast("string")), "space": text(F.lit("S"), (k % 50).cast("string")),
    }
    materials = F.array(text(F.lit("steel"), "p_type"), text("p_name"), text("p_brand", F.lit("steel"), F.lit("steel")))
    return stored(s, d, "elements", lambda: inverted.build(table(s, d, "part"), "p_partkey", fields, {"materials": materials}))


def _wording(s, d):
    """A question for every twentieth element, stop words included."""
    q = table(s, d, "part").where("p_partkey % 20 = 0")
    text = F.concat_ws(" ", F.lit("Onde está the"), "p_name", F.lit("of"), "p_type", F.lit("no piso"), (F.col("p_size") % 10).cast("string"), F.lit("?"))
    return q.select(F.col("p_partkey").alias("query_id"), F.explode(inverted.asked_terms(text)).alias("term"))


_ELEMENTS = rf"""parts AS (SELECT p_partkey AS id, unnest([
    {{'field': 'name', 'part': 0, 'text': p_name}}, {{'field': 'semantic_label', 'part': 0, 'text': p_type}}, {{'field': 'object_type', 'part': 0, 'text': p_brand}}, {{'field': 'description', 'part': 0, 'text': p_type || ' ' || p_name || ' with a ' || p_type}},
    {{'field': 'site', 'part': 0, 'text': 'North'}}, {{'field': 'building', 'part': 0, 'text': 'B ' || p_partkey % 3}}, {{'field': 'storey', 'part': 0, 'text': 'piso ' || p_size % 10}}, {{'field': 'space', 'part': 0, 'text': 'S ' || p_partkey % 50}},
    {{'field': 'materials', 'part': 0, 'text': 'steel ' || p_type}}, {{'field': 'materials', 'part': 1, 'text': p_name}}, {{'field': 'materials', 'part': 2, 'text': p_brand || ' steel steel'}}]) AS p FROM part),
  t AS (SELECT id, p.field AS field, p.part AS part, {_SPLIT('p.text')} AS w FROM parts),
  asked AS (SELECT DISTINCT p_partkey AS query_id, unnest({_SPLIT("p_name || ' ' || p_type || ' piso ' || p_size % 10")}) AS term FROM part WHERE p_partkey % 20 = 0), {_SCORED},
  w AS (SELECT query_id, id, field, s * CASE field WHEN 'name' THEN 3.0 WHEN 'semantic_label' THEN 2.0 WHEN 'object_type' THEN 1.5 WHEN 'materials' THEN 1.5 ELSE 1.0 END AS w FROM f),
  e AS (SELECT query_id, id, max(w) FILTER (WHERE field <> 'materials') AS most, sum(w) FILTER (WHERE field <> 'materials') AS all_, sum(w) FILTER (WHERE field = 'materials') AS inner_ FROM w GROUP BY query_id, id),
  es AS (SELECT query_id, id, round_even(coalesce(most + 0.3 * (all_ - most), 0.0) + coalesce(inner_, 0.0), 6) AS score FROM e),
  er AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM es)"""
_add("G2_element_search", lambda s, d: inverted.element_search(_element_index(s, d), _wording(s, d), retrieval.ELEMENT_FIELDS), f"WITH {_ELEMENTS} SELECT query_id, id, score, rank FROM er WHERE rank <= 200")


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


_add(
    "G7_hybrid_search",
    lambda s, d: retrieval.hybrid(_chunk_search(s, d), ranking.ranked(retrieval.dense(_vectors(s, d), _vectors(s, d).join(table(s, d, "benchmark").select(F.col("item_id").alias("id")), "id", "left_semi").where("id % 20 = 0").withColumnRenamed("id", "query_id")).select("query_id", "id", "score"), ["query_id"])).select("query_id", "id", "rank", "score"),
    f"""WITH {_CHUNKS}, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      dn AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(v.e, q.e) AS score FROM v, v AS q WHERE q.vec_id IN (SELECT item_id FROM benchmark WHERE item_id % 20 = 0)),
      dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dn),
      u AS (SELECT query_id, id, CAST(l.rank AS DOUBLE) AS x, CAST(o.rank AS DOUBLE) AS y FROM (SELECT * FROM chunk_ranks WHERE rank <= 200) AS l FULL JOIN (SELECT * FROM dr WHERE rank <= 200) AS o USING (query_id, id)),
      e AS (SELECT *, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN (x + y + 120) / ((x + 60) * (y + 60)) ELSE 1.0::DOUBLE / (coalesce(x, y) + 60) END AS exact, (x IS NOT NULL)::INT + (y IS NOT NULL)::INT AS sources FROM u)
      SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, sources DESC, id) AS INTEGER) AS rank, round_even(exact, 6) AS score FROM e""",
)

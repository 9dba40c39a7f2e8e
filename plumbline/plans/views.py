"""Adapter views: the driver's generic tables read as building records.

Each view exists twice, as a DataFrame here and as a DuckDB common table
expression (``*_SQL``), so that queries over it can be held against plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks that rows are dealt to; with so few a task writes them as they come, without sorting them first.
DEALT = 192


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows spread over a stated number of tasks by ``key``: a small file is read by one task,
    however much is made of its rows."""
    return df.repartition(DEALT, key)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` as elements of four projects on ten storeys."""
    p = table(spark, sf_dir, "part")
    project = F.concat(F.lit("proj-"), (F.col("p_partkey") % 4).cast("string"))
    gid = F.lpad(F.col("p_partkey").cast("string"), 22, "0")
    return p.select(
        F.col("p_partkey").alias("key"),
        project.alias("project_id"),
        gid.alias("global_id"),
        ids.element_id(project, gid).alias("element_id"),
        F.col("p_type").alias("ifc_class"),
        F.col("p_name").alias("name"),
        F.concat(F.array("p_brand"), F.split("p_name", " ")).alias("materials"),
        (F.col("p_size") % 10).cast("string").alias("storey"),
        F.col("p_size").cast("double").alias("height"),
        F.col("p_retailprice").alias("area"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") * F.col("p_retailprice") / 100).alias("volume"),
    )


ELEMENTS_SQL = """elements AS (
  SELECT p_partkey AS key, 'proj-' || (p_partkey % 4) AS project_id, lpad(CAST(p_partkey AS VARCHAR), 22, '0') AS global_id,
    'el_' || substr(sha256('6:' || 'proj-' || (p_partkey % 4) || '22:' || lpad(CAST(p_partkey AS VARCHAR), 22, '0')), 1, 32) AS element_id,
    p_type AS ifc_class, p_name AS name, list_concat([p_brand], string_split(p_name, ' ')) AS materials, CAST(p_size % 10 AS VARCHAR) AS storey,
    CAST(p_size AS DOUBLE) AS height, p_retailprice AS area, CASE WHEN p_partkey % 7 <> 0 THEN p_size * p_retailprice / 100 END AS volume
  FROM part)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` measures as quantity facts, one row for each."""
    line = table(spark, sf_dir, "lineitem")
    cols = "stack(4, 'quantity', l_quantity, 'extendedprice', l_extendedprice, 'discount', l_discount, 'tax', l_tax) AS (property_name, value)"
    return line.select("l_orderkey", "l_partkey", "l_linenumber", F.expr(cols))


FACTS_SQL = """facts AS (
  SELECT l_orderkey, l_partkey, l_linenumber, unnest(['quantity', 'extendedprice', 'discount', 'tax']) AS property_name,
    unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` as axis-parallel boxes with exact decimal corners."""
    k, s = F.col("p_partkey"), F.col("p_size")
    d = lambda x: x.cast("decimal(20,6)")
    x0, y0, z0 = (k * 37) % 200, (k * 53) % 200, (k * 11) % 12
    return table(spark, sf_dir, "part").select(
        k.alias("id"), d(x0).alias("x0"), d(y0).alias("y0"), d(z0).alias("z0"), d(x0 + s % 7 + 1).alias("x1"), d(y0 + s % 5 + 1).alias("y1"), d(z0 + s % 3 + 1).alias("z1")
    )


BOXES_SQL = """boxes AS (
  SELECT p_partkey AS id, CAST((p_partkey * 37) % 200 AS DECIMAL(20,6)) AS x0, CAST((p_partkey * 53) % 200 AS DECIMAL(20,6)) AS y0, CAST((p_partkey * 11) % 12 AS DECIMAL(20,6)) AS z0,
    CAST((p_partkey * 37) % 200 + p_size % 7 + 1 AS DECIMAL(20,6)) AS x1, CAST((p_partkey * 53) % 200 + p_size % 5 + 1 AS DECIMAL(20,6)) AS y1, CAST((p_partkey * 11) % 12 + p_size % 3 + 1 AS DECIMAL(20,6)) AS z1
  FROM part)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, customer and order as a containment graph."""
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edge = lambda df, p, a, b: df.select(F.lit(p).alias("predicate"), a.alias("src"), b.alias("dst"))
    nation, customer, orders = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    out = edge(nation, "HAS_SITE", node("r", "n_regionkey"), node("n", "n_nationkey"))
    out = out.unionByName(edge(customer, "HAS_BUILDING", node("n", "c_nationkey"), node("c", "c_custkey")))
    out = out.unionByName(edge(orders, "HAS_STOREY", node("c", "o_custkey"), node("o", "o_orderkey")))
    return out.withColumn("edge_id", ids.identity("native_edge", "1", "tpch", F.col("predicate"), F.col("src"), F.col("dst"), "rel", "0"))


EDGES_SQL = """edges0 AS (
  SELECT 'HAS_SITE' AS predicate, 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'HAS_BUILDING', 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'HAS_STOREY', 'c' || o_custkey, 'o' || o_orderkey FROM orders
), edges AS (
  SELECT *, 'ge_' || substr(sha256('1:1' || '4:tpch' || strlen(predicate) || ':' || predicate || strlen(src) || ':' || src || strlen(dst) || ':' || dst || '3:rel' || '1:0'), 1, 32) AS edge_id FROM edges0)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of `documents` as text chunks."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return d.where("text <> ''").withColumn("chunk_id", ids.identity("chunk", "chunk", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))


CHUNKS_SQL = """chunks0 AS (
  SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS chunk_index, unnest(string_split(text, chr(10))) AS text FROM documents
), chunks AS (
  SELECT doc_id, chunk_index, text, 'ch_' || substr(sha256('5:chunk' || strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id || strlen(CAST(chunk_index AS VARCHAR)) || ':' || chunk_index), 1, 32) AS chunk_id
  FROM chunks0 WHERE text <> '')"""

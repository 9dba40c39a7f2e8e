"""Queries of thresholds chosen out of fold."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import thresholds
from plumbline.sources.work import Work

from .views import table

Q: dict = {}
SQL: dict = {}


def _lists(s, d):
    """Customers as queries, lines of their orders as ranked candidates: better grades tend to have better scores."""
    line = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    grade = (F.col("l_quantity").cast("int") % 4).alias("grade")
    score = ((F.col("l_quantity").cast("int") % 4 * 11 + F.col("l_partkey") % 67) / 100).alias("score")
    each = line.select(F.col("o_custkey").alias("query_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", grade, score)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("grade"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return each.withColumn("rank", F.row_number().over(order)).where("rank <= 30").select("query_id", "rank", "score", "grade")


def _judged(s, d):
    """The lists, made once, and their queries."""
    lists = Work(s).written(_lists(s, d), "lists")
    best = F.slice(F.sort_array(F.collect_list("grade"), asc=False), 1, 10)
    return lists, lists.groupBy("query_id").agg(F.count_if(F.col("grade") >= 2).alias("relevant_total"), best.alias("ideal_grades")).withColumn("fold", (F.col("query_id") % 5).cast("int"))


_ALL = """l AS (SELECT o_custkey AS q, CAST(trunc(l_quantity) AS INTEGER) % 4 AS g, round_even((CAST(trunc(l_quantity) AS INTEGER) % 4 * 11 + l_partkey % 67) / 100, 6) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY (CAST(trunc(l_quantity) AS INTEGER) % 4 * 11 + l_partkey % 67) / 100 DESC, CAST(trunc(l_quantity) AS INTEGER) % 4 DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  c AS (SELECT * FROM l WHERE r <= 30), ideal0 AS (SELECT q, g, row_number() OVER (PARTITION BY q ORDER BY g DESC) AS r FROM c),
  qs AS (SELECT q, q % 5 AS fold, count(*) FILTER (WHERE g >= 2) AS rel, count(*) AS m, sum(CASE WHEN r <= 10 THEN (pow(2.0, g) - 1) / log2(r + 1) ELSE 0 END) AS ideal FROM ideal0 GROUP BY q HAVING rel > 0),
  cuts AS (SELECT DISTINCT s AS cut FROM c JOIN qs USING (q) UNION ALL SELECT -1),
  acc AS (SELECT qs.q, fold, cut, m, rel, ideal, count(c.q) AS n, count(c.q) FILTER (WHERE g >= 2) AS tp, count(c.q) FILTER (WHERE g >= 2 AND r <= 10) AS near, coalesce(sum(CASE WHEN r <= 10 THEN (pow(2.0, g) - 1) / log2(r + 1) END), 0.0) AS dcg
    FROM qs CROSS JOIN cuts LEFT JOIN c ON c.q = qs.q AND c.s >= cut GROUP BY ALL),
  st AS (SELECT q, fold, cut, n, CASE WHEN tp > 0 THEN 2.0 * (tp / n) * (tp / rel) / ((tp / n) + (tp / rel)) ELSE 0.0 END AS f1, near / rel AS rec, CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0.0 END AS nd, (m - n) / m AS rej FROM acc),
  fm AS (SELECT fold, cut, round_even(avg(f1), 6) AS f1, round_even(avg(rec), 6) AS rec, round_even(avg(nd), 6) AS nd, round_even(avg(rej), 6) AS rej FROM st GROUP BY fold, cut),
  mg AS (SELECT a.fold, a.cut, a.f1, a.rej, round_even(a.rec - b.rec, 6) AS rec, round_even(a.nd - b.nd, 6) AS nd FROM fm AS a JOIN fm AS b ON a.fold = b.fold AND b.cut = -1),
  hs AS (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS h),
  own AS (SELECT DISTINCT h, s AS cut FROM hs JOIN (SELECT s, fold FROM c JOIN qs USING (q)) ON fold <> h UNION ALL SELECT h, -1 FROM hs),
  tr AS (SELECT h, cut, min(rec) AS lr, min(nd) AS ln, round_even(sum(CAST(round(rec * 1000000) AS BIGINT)) / count(*), 0) / 1000000 AS mr, round_even(sum(CAST(round(nd * 1000000) AS BIGINT)) / count(*), 0) / 1000000 AS mn, round_even(sum(CAST(round(f1 * 1000000) AS BIGINT)) / count(*), 0) / 1000000 AS mf, round_even(sum(CAST(round(rej * 1000000) AS BIGINT)) / count(*), 0) / 1000000 AS rj FROM hs JOIN mg ON fold <> h JOIN own USING (h, cut) GROUP BY h, cut),
  rk AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY lr DESC, ln DESC, mr DESC, mn DESC, rj, (cut >= 0)::INT, cut, mf DESC) AS k, count(*) OVER (PARTITION BY h) AS eligible FROM tr WHERE lr >= 0 AND ln >= 0),
  ch AS (SELECT rk.*, (SELECT count(*) FROM tr WHERE tr.h = rk.h) AS candidates FROM rk WHERE k = 1)"""
_add = Q.__setitem__
_add("N25_out_of_fold", lambda s, d: thresholds.protocol(*_judged(s, d))[0])
SQL["N25_out_of_fold"] = f"""WITH {_ALL} SELECT CAST(h AS INTEGER) AS held_out, CASE WHEN cut < 0 THEN 'accept_all' ELSE 'numeric' END AS mode, CASE WHEN cut >= 0 THEN CAST(cut AS DOUBLE) END AS threshold, candidates, eligible, CAST(lr AS DOUBLE) AS least_recall, CAST(ln AS DOUBLE) AS least_ndcg, CAST(mr AS DOUBLE) AS macro_recall, CAST(mn AS DOUBLE) AS macro_ndcg, CAST(rj AS DOUBLE) AS rejection, CAST(mf AS DOUBLE) AS macro_f1 FROM ch"""
_add("N25_outcome", lambda s, d: thresholds.protocol(*_judged(s, d))[1])
SQL["N25_outcome"] = f"""WITH {_ALL}, o AS (SELECT st.*, a.rec AS arec, a.nd AS an FROM st JOIN ch ON ch.h = st.fold AND ch.cut = st.cut JOIN st AS a ON a.q = st.q AND a.cut = -1),
  one AS (SELECT round_even(avg(rec), 6) AS recall, round_even(avg(nd), 6) AS ndcg, round_even(avg(f1), 6) AS f1, CAST(count(*) FILTER (WHERE n = 0) AS BIGINT) AS empty, round_even(avg(arec), 6) AS recall_all, round_even(avg(an), 6) AS ndcg_all FROM o)
  SELECT one.*, recall >= recall_all AND ndcg >= ndcg_all AS passed, CASE WHEN recall >= recall_all AND ndcg >= ndcg_all THEN CASE WHEN cut < 0 THEN 'accept_all' ELSE 'numeric' END END AS mode, CASE WHEN recall >= recall_all AND ndcg >= ndcg_all AND cut >= 0 THEN CAST(cut AS DOUBLE) END AS threshold FROM one, ch WHERE h = -1"""
_add("N15_fold_means", lambda s, d: thresholds.fold_means(thresholds.steps(*_judged(s, d))).select("fold", F.coalesce("score", F.lit(-1.0)).alias("score"), "f1", "recall", "ndcg", "rejected", "n"))
SQL["N15_fold_means"] = f"""WITH {_ALL} SELECT CAST(fold AS INTEGER) AS fold, CAST(cut AS DOUBLE) AS score, f1, rec AS recall, nd AS ndcg, rej AS rejected, n FROM fm JOIN (SELECT fold, count(*) AS n FROM qs GROUP BY fold) USING (fold)"""

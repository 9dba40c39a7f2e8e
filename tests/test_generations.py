"""Work tables, pointers, the index-all protocol and generations of a graph."""

from __future__ import annotations

import threading
import uuid

import pytest
from pyspark.sql import functions as F

from plumbline.functions import digests
from plumbline.sources import generations as g
from plumbline.sources import store
from plumbline.sources.work import Files, Pointer, Work


def test_work_belongs_to_its_call(spark):
    a, b = Work(spark), Work(spark)
    x, y, z = a.written(spark.range(3), "x"), b.written(spark.range(4), "y"), a.written(spark.range(5), "z")
    a.drop(keep=[z])
    assert y.count() == 4 and z.count() == 5
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND"):
        x.count()


def test_pointer_moves_once(spark, tmp_path):
    p = Pointer(Files(spark, f"file://{tmp_path}"), "p/q")
    assert p.now() == (0, {})
    won: list[int] = []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if p.advance(0, {"by": k}) else None) for k in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and p.now() == (1, {"by": won[0]}) and p.advance(1, {}) and not p.advance(1, {})
    assert [f.name for f in (tmp_path / "p/q").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")] == []


def test_digest_is_of_the_set(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None), (3, "")], "k int, t string")
    one = lambda d: digests.digest(d).first()["digest"]
    assert one(df) == one(df.repartition(3).orderBy(F.desc("k")))
    others = [df.dropDuplicates(), df.fillna(""), df.where("k < 3"), df.withColumn("t", F.lit("a"))]
    assert len({one(df), *map(one, others)}) == 5 and digests.digest(df.limit(0)).first()["n"] == 0
    parts = digests.digest(df, by=["k"])
    assert [r["k"] for r in digests.changed(parts, digests.digest(df.fillna("x"), by=["k"]), ["k"]).collect()] == [2]
    assert sorted(r["k"] for r in digests.changed(parts, parts.where("k = 1"), ["k"]).collect()) == [2, 3]


def test_replace_is_all_or_nothing(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    name = s.create("t", 1, {})
    with pytest.raises(ValueError, match="holds no rows"):
        s.read(name)
    df = spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).alias("v"))
    assert s.replace(name, df, "id", batches=4)["batches"] == 4 and s.read(name).count() == 100
    for bad, rule in ((df.unionByName(df.where("id = '5'")), "repeated_key"), (df.withColumn("id", F.when(F.col("id") != "5", F.col("id"))), "missing_key"), (df, "negative")):
        with pytest.raises(store.Refused) as e:
            s.replace(name, bad.withColumn("v", F.col("v") - 1) if rule == "negative" else bad, "id", invalid={"negative": F.col("v") < 0} if rule == "negative" else None)
        assert list(e.value.report) == [rule] and s.read(name).agg(F.sum("v")).first()[0] == df.agg(F.sum("v")).first()[0]
    assert s.replace(name, df.limit(0), "id")["rows"] == 0 and s.read(name).count() == 0 and s.read(name).columns == ["id", "v"]


def test_replace_resumes_after_credited_batches(spark, tmp_path, monkeypatch):
    s = store.Store(spark, f"file://{tmp_path}")
    name = s.create("t", 1, {})
    df = spark.range(60).select(F.col("id").cast("string").alias("id"))
    credited = s._credited

    def breaks(df, staged, k, wanted):
        if k == 2:
            raise OSError("lost")
        credited(df, staged, k, wanted)

    monkeypatch.setattr(s, "_credited", breaks)
    with pytest.raises(OSError):
        s.replace(name, df, "id", batches=4, run="r1")
    monkeypatch.setattr(s, "_credited", credited)
    with pytest.raises(store.Refused, match="not the one"):
        s.replace(name, df.where("id < 50"), "id", batches=4, run="r1")
    done = s.replace(name, df, "id", batches=4, run="r1")
    assert done["resumed"] == 2 and done["rows"] == 60 and s.read(name).distinct().count() == 60


def test_replace_refuses_input_that_changes(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    name = s.create("t", 1, {})
    other = F.udf(lambda: uuid.uuid4().hex).asNondeterministic()
    moving = spark.range(20).select(F.col("id").cast("string").alias("id"), other().alias("v"))
    with pytest.raises(store.Refused):
        s.replace(name, moving, "id")
    with pytest.raises(ValueError, match="holds no rows"):
        s.read(name)


def test_two_promotions_of_one_alias(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    names = [s.create("t", k, {}) for k in range(5)]
    s.promote("t", names[0])
    outcome: list = []

    def run(k):
        try:
            s.promote("t", names[k], expected=names[0])
            outcome.append(names[k])
        except RuntimeError:
            outcome.append(None)

    threads = [threading.Thread(target=run, args=(k,)) for k in range(1, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [n for n in outcome if n] == [s.resolve("t")]


def test_vectors_round_trip(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    name = s.create("v", 1, {"dim": 2})
    rows = spark.createDataFrame([(str(k), "x" * k) for k in range(30)], "id string, text string")
    calls = tmp_path / "calls"
    calls.mkdir()

    def embed(texts):
        import math

        (calls / uuid.uuid4().hex).write_text(str(len(texts)))
        return [[math.cos(len(t)), math.sin(len(t))] for t in texts]

    done = store.index_vectors(s, name, rows, "id", "text", embed, 2, batches=3)
    assert done["rows"] == 30 and s.read(name).count() == 30
    assert sum(int(f.read_text()) for f in calls.iterdir()) == 30  # each text once
    with pytest.raises(Exception, match="unit norm"):
        store.index_vectors(s, name, rows, "id", "text", lambda texts: [[1.0, 1.0]] * len(texts), 2)


def graph(spark, n=6, wrong=False):
    nodes = spark.createDataFrame([(f"n{k}", "element", f"name {k}") for k in range(n)], "node_id string, kind string, name string")
    native = spark.createDataFrame([("CONTAINS", f"n{k}", f"n{k + 1}", f"e{k}") for k in range(n - 1)], "predicate string, src string, dst string, edge_id string")
    derived = spark.createDataFrame([("TOUCHES", "n0", "missing" if wrong else "n2", "d0")], native.schema)
    return nodes, native, derived


def revisions(k):
    return g.Revisions("p", f"n{k}", f"a{k}", f"d{k}", f"b{k}")


def test_publish_roll_back_and_clean(spark, tmp_path):
    s = g.Generations(spark, f"file://{tmp_path}")
    with pytest.raises(RuntimeError):
        s.cleanup("p", g.NATIVE)
    for k in (1, 2, 3):
        assert s.rebuild(revisions(k), *graph(spark, 5 + k))["counter"] == k
    assert s.served("p")[0].count() == 8 and not s.rebuild(revisions(3), *graph(spark, 8))["changed"]
    staged = s.stage(revisions(4), *graph(spark, 6, wrong=True))
    assert s.active("p")["bundle"] == "b3" and staged["written"] == ["node", "native", "derived"]
    checks = s.verify(revisions(4), *graph(spark, 6, wrong=True))
    assert {r["name"] for r in checks.where("NOT passed").collect()} == {"endpoint_occurrences_exist"} and checks.count() == 25
    with pytest.raises(RuntimeError, match="endpoint_occurrences_exist"):
        s.publish(staged, checks)
    assert s.cleanup("p", g.DERIVED) == [f"edges/project_id=p/source_kind={g.DERIVED}/revision_id=d{k}/node_revision_id=n{k}" for k in (1, 4)]
    gone = s.cleanup("p", g.NATIVE)
    assert {x.rpartition("=")[2] for x in gone} == {"n1", "n4"} and len(gone) == 4
    assert s.rollback("p")["bundle"] == "b2" and s.served("p")[0].count() == 7
    with pytest.raises(RuntimeError, match="no previous"):
        s.rollback("p")
    s.rebuild(revisions(3), *graph(spark, 8))
    s.cleanup("p", g.NATIVE, retain_previous=False)
    s.cleanup("p", g.DERIVED, retain_previous=False)
    with pytest.raises(RuntimeError, match="cleaned away"):
        s.rollback("p")
    assert s.served("p")[1].count() == 7


def test_publishers_race(spark, tmp_path):
    s = g.Generations(spark, f"file://{tmp_path}")
    s.rebuild(revisions(1), *graph(spark))
    staged = [s.stage(revisions(k), *graph(spark)) for k in (2, 3)]
    checks = [s.verify(revisions(k), *graph(spark)).persist() for k in (2, 3)]
    won: list = []

    def run(k):
        try:
            won.append(s.publish(staged[k], checks[k])["bundle"])
        except RuntimeError as e:
            assert "changed" in str(e)

    threads = [threading.Thread(target=run, args=(k,)) for k in (0, 1)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and s.active("p")["bundle"] == won[0] and s.active("p")["previous"]["bundle"] == "b1"


def test_empty_generation(spark, tmp_path):
    s = g.Generations(spark, f"file://{tmp_path}")
    nodes, native, derived = graph(spark)
    assert s.rebuild(revisions(1), nodes.limit(0), native.limit(0), derived.limit(0))["counter"] == 1
    assert [df.count() for df in s.served("p")] == [0, 0, 0]

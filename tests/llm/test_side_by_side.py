"""Two operators at once in one session, each with work tables of its own."""

from __future__ import annotations

import threading
from pathlib import Path

from plumbline.llm import common
from plumbline.llm.decontaminate import decontamination_report
from plumbline.llm.embeddings import linked_vectors
from plumbline.llm.neardup import near_duplicate_report

SMALL = Path("/root/testdata/sf0.001")


def test_two_calls_at_once(spark):
    vectors, docs = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("embeddings", "documents"))
    calls = {"vectors": lambda: linked_vectors(spark, vectors), "again": lambda: linked_vectors(spark, vectors), "docs": lambda: near_duplicate_report(spark, docs)}
    alone = {name: sorted(map(str, calls[name]().collect())) for name in ("vectors", "docs")}
    got: dict = {}

    def run(name):
        got[name] = sorted(map(str, calls[name]().collect()))

    threads = [threading.Thread(target=run, args=(name,)) for name in calls]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == alone | {"again": alone["vectors"]}


def test_tables_go_with_their_owner(spark):
    with common.Owned(spark) as outer:
        kept = common.written(spark, spark.range(3), "kept")
        with common.Owned(spark) as inner:
            lost = common.written(spark, spark.range(4), "lost")
            inner.keep(common.written(spark, spark.range(5), "also"))
        assert kept.count() == 3 and [p for p in outer.paths] == [kept.work_path]
        outer.keep(kept)
    assert kept.count() == 3
    try:
        lost.count()
        raise AssertionError("still there")
    except Exception as e:
        assert "NOT_EXIST" in str(e) or "NOT_FOUND" in str(e)


def test_items_without_an_id_make_hits(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "alpha beta gamma")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, "two three"), (7, "three four"), (None, None), (8, "two three")], "item_id bigint, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in decontamination_report(spark, docs, items).collect()}
    assert got == {1: (3, 2, True), 2: (0, 0, False)}
    alone = decontamination_report(spark, docs, items.where("item_id IS NULL")).where("doc_id = 1").first()
    assert (alone["n_hit"], alone["n_items"]) == (2, 0)

"""Projections: schema checked first, refusals beside what is stored."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.sources import projections, store

COLUMNS = ", ".join(f"{c} {t}" for c, t in (projections._CHUNK | projections._OCR).items())


def chunk(k, version="1.0", index=0, page=1, text="t", link=None):
    return (k, "d", "p", "r", index, page, ["a"], None, text, 1, version, True, 0.5, "b", link, ["e"])


def test_chunks(spark, tmp_path):
    rows = [chunk("a"), chunk("b", "2.0"), chunk("c", "3.0", link="l"), chunk("d", "3.0"), chunk("e", "9"), chunk("f", index=-1), chunk("g", index=2**31), chunk("h", page=0), chunk("i", page=None), chunk("j", text=None), chunk("", text="x"), chunk("k", text="")]
    df = spark.createDataFrame(rows, COLUMNS)
    s = store.Store(spark, f"file://{tmp_path}")
    report, refused = projections.index(s, s.create("c", 1, {}), df, "chunk")
    assert report["rows"] == 4 and {r["chunk_id"]: r["refused"] for r in refused.collect()} == {
        "d": "no_link_revision", "e": "unknown_version", "f": "number_out_of_range", "g": "number_out_of_range", "h": "number_out_of_range", "i": "number_out_of_range", "j": "no_text", "": "missing_id",
    }
    got = {r["chunk_id"]: (r["ocr"], r["link_revision_id"], r["text"]) for r in s.read("c_v1").collect()}
    assert got == {"a": (None, None, "t"), "b": (True, None, "t"), "c": (True, "l", "t"), "k": (None, None, "")}
    with pytest.raises(ValueError, match="can't be projected"):
        projections.projected(df.withColumn("page_number", F.lit("1")), "chunk")
    with pytest.raises(ValueError, match="has a projection"):
        projections.register("chunk", projections.REGISTRY["property_fact"])
    assert projections.projected(df.limit(0), "chunk").collect() == []

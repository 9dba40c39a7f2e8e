"""Texts beyond the bounds of linking have an outcome; the others are linked as ever."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import linking


def test_long_texts_do_not_stop_the_others(spark):
    elements = spark.createDataFrame([("el_1", "Caldeira Norte")], "element_id string, name string")
    texts = [(1, "a Caldeira Norte aqui"), (2, "palavra " * 5000), (3, "Caldeira Norte, " * 300), (4, None), (5, "")]
    df = spark.createDataFrame(texts, "k int, t string").select("k", linking.mentions_of(spark, F.col("t"), elements).alias("m"))
    got = {r["k"]: None if r["m"] is None else [(m["outcome"], m["start"], m["stop"]) for m in r["m"]] for r in df.collect()}
    assert got == {1: [("linked", 2, 16)], 2: [("refused_word_bound", 0, 40000)], 3: [("refused_mention_bound", 0, 4800)], 4: None, 5: []}

"""How five quality filters interact, whatever the order they are applied in.

A relational word pipeline: texts are dealt by document, exploded into words,
aggregated by (document, word) and then by document for totals and distinct
words; the other flags are computed beside that and outer-joined. Every document
then has one of 32 patterns of failed filters, and one aggregation with 32
conditional counts (for all, good and toxic documents) answers all 120 orders.

Texts are the only large thing shuffled, once: the aggregates by word need no
further exchange, since their keys begin with those that texts were dealt by.
Copies are recognised by a digest and collapsed to counts before their groups
meet, so a group of any size is a row for each task that read some of it.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The filters; the letter at position k stands for bit k of a pattern.
FILTERS = "ABCDE"
#: The least number of words, the least distinct words in a hundred, the most capitals in a hundred.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10

_SPACE = "[ \\t-\\r]+"
_SYMBOLS = r"[#$%&*|]"
_ID = ["_id", "_text"]


def _identified(docs: DataFrame) -> DataFrame:
    """Documents under two keys that are never null: the id, and a hash of the text
    (and of whether there is an id), by which rows that repeat an id differ."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("_id"),
        F.xxhash64(F.col("doc_id").isNull(), text).alias("_text"),
        F.col("doc_id").isNotNull().alias("_known"),
        F.coalesce("lang", F.lit("")).alias("part"),
        text.alias("text"),
    )


def word_totals(docs: DataFrame) -> DataFrame:
    """Per document (``_id``, ``_text``) that has words: words and distinct, over all
    rows that repeat it."""
    texts = _identified(docs).select(*_ID, "text").repartition(*_ID)
    words = texts.select(*_ID, F.explode(F.split("text", _SPACE)).alias("word")).where("word <> ''")
    by_word = words.groupBy(*_ID, "word").agg(F.count("*").alias("n"))
    return by_word.groupBy(*_ID).agg(F.sum("n").alias("words"), F.count("*").alias("distinct"))


def failure_patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of documents by what they fail: part, pattern (bits 0 to 4 for A to E),
    good and toxic (whether labelled so), n.

    A null text is empty, a null lang is the part ''. Of equal texts all but those
    with the smallest doc_id fail E, rows that repeat that id included in neither;
    a row without an id has no smaller one and doesn't fail E. A document is good
    or toxic if any label row of its id says so. Empty tables give no rows; other
    columns aren't looked at.
    """
    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    flags = _identified(docs).select(
        *_ID, "_known", "part", F.unhex(F.sha2("text", 256)).alias("digest"), (100 * capitals > MOST_CAPITALS * F.length("text")).alias("c"), F.col("text").rlike(_SYMBOLS).alias("d")
    )
    flags = flags.groupBy(*flags.columns).agg(F.count("*").alias("n"))  # rows that repeat a document
    counted = flags.join(word_totals(docs), _ID, "left").withColumn("rows", F.sum("n").over(Window.partitionBy(*_ID)))
    words, distinct = F.expr("coalesce(words, 0) div rows"), F.coalesce("distinct", F.lit(0))
    failed = [words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, F.col("c"), F.col("d")]
    marked = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    judged = counted.select("_id", "_known", "part", "digest", "n", _pattern(failed).alias("pattern")).join(marked, "_id", "left")
    said = lambda c: F.col("_known") & F.coalesce(c, F.lit(False))
    alike = judged.groupBy("digest", "part", "pattern", said("good").alias("good"), said("toxic").alias("toxic")).agg(
        F.sum("n").alias("n"), F.sum(F.when(~F.col("_known"), F.col("n")).otherwise(0)).alias("lost"), F.min(F.when(F.col("_known"), F.struct("_id", "n"))).alias("first")
    )
    smallest = F.min("first._id").over(Window.partitionBy("digest"))  # a row for each part and label of equal texts
    passing = F.col("lost") + F.when(F.col("first._id") == smallest, F.col("first.n")).otherwise(0)
    alike = alike.withColumn("passing", passing)
    both = F.array(F.struct(F.col("pattern"), F.col("passing").alias("n")), F.struct((F.col("pattern") + 16).alias("pattern"), (F.col("n") - F.col("passing")).alias("n")))
    return alike.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.*").where("n > 0")


def _pattern(failed: list[Column]) -> Column:
    bits = [F.when(f, F.lit(1 << k)).otherwise(0) for k, f in enumerate(failed)]
    return sum(bits[1:], bits[0])


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the five filters and step what the step does: kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``shapley`` sums what the step's filter removes over all orders: a document that
    fails k filters is removed by each of them in 120 / k orders. Nulls, repeats, ties
    and empty tables are as in failure_patterns; every part has its 600 rows.
    """
    patterns = range(1 << len(FILTERS))
    rows = failure_patterns(docs, labels)
    counts = lambda name, which: [F.sum(F.when((F.col("pattern") == m) & which, F.col("n")).otherwise(0)).alias(f"{name}{m}") for m in patterns]
    parts = rows.groupBy("part").agg(*counts("all", F.lit(True)), *counts("good", F.col("good")), *counts("toxic", F.col("toxic")))
    parts = parts.select("part", *(F.array(*(f"{name}{m}" for m in patterns)).alias(name) for name in ("all", "good", "toxic")))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    before = F.left("filter_order", F.col("step") - 1)
    bits = lambda text: sum(F.when(F.contains(text, F.lit(f)), 1 << k).otherwise(0) for k, f in enumerate(FILTERS))
    steps = steps.withColumn("own", bits(letter)).withColumn("earlier", bits(before))

    def total(name: str, wanted, weight=None) -> Column:  # of the patterns that satisfy a condition
        each = F.transform(name, lambda n, m: F.when(wanted(m), (n * weight(m)).cast("bigint") if weight else n).otherwise(0))
        return F.aggregate(each, F.lit(0).cast("bigint"), lambda a, b: a + b)

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("earlier")) != 0
    removed = lambda m: fails(m) & ~gone(m)
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total("all", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("all", removed).alias("removed"),
        total("all", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("all", lambda m: m == F.col("own")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("all", fails, lambda m: F.lit(len(list(permutations(FILTERS)))) / F.bit_count(m)).alias("shapley"),
    )

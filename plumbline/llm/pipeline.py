"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and
returns a DataFrame, which is written and read again as the next one's docs. All
but the last return the columns of documents, whatever others there are, in their
order. Repeated rows are judged each alone unless a stage says otherwise; an empty
table gives an empty table. No stage can be put into SQL as a
whole (two learned models, a randomised sketch and a genetic search), so
ORACLE_SQL is None and the tests hold the stages against brute force.
"""

from __future__ import annotations

import gc

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import give_back, table, written
from .decontaminate import clean_documents
from .langid import identified
from .neardup import deduplicated
from .packing import packed_documents
from .quality import good_documents


#: Pre-tokens that a worker keeps, and bytes it cuts at once: fewer than when packing alone, for the workers of all stages share their memory.
KEPT = 100_000
SLICE = 1 << 20


def _lean(out: DataFrame) -> DataFrame:
    """``out``; what training has used on the driver goes back to the system, for the
    stages that follow share the driver."""
    gc.collect()
    give_back()
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with confidence.

    Null and empty texts, and those without a letter, go; where no document has a
    ``lang``, nothing can be learned and all go. Ties go to the language that sorts first.
    """
    return _lean(identified(spark, docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers keep.

    Without labels of both classes all stay; nulls and empty texts are judged by
    features of their own; a score equal to the threshold stays.
    """
    return _lean(good_documents(spark, docs, table(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    The smallest doc_id of a group stays; of rows that repeat one id in a group the
    first by text. Rows with a null text all stay.
    """
    return deduplicated(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without more than a trace of the benchmark.

    A null or empty text has no words and stays; an empty benchmark keeps all.
    """
    return clean_documents(spark, docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens.

    A null or empty text is a piece of one token, the end id; no documents, no rows.
    """
    return packed_documents(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), kept=KEPT, slice_bytes=SLICE)


STAGES = [("language", language), ("quality", quality), ("dedup", dedup), ("decontaminate", decontaminate), ("pack", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

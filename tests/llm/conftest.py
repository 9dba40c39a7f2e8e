"""Shared helpers for the tests of the training-data operators."""

from __future__ import annotations

import pytest

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) or (doc_id, text, lang) as a documents table."""

    def make(rows, extra: bool = False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCUMENT)
        if extra:  # clashing names that operators use within
            from pyspark.sql import functions as F

            for name in ("key", "bands", "label", "contamination2", "_language", "_quality", "_rank", "hits"):
                df = df.withColumn(name, F.lit(1))
        return df

    return make

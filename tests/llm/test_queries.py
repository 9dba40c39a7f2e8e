"""The registered queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

from pathlib import Path

import pytest

from plumbline.llm import queries

SMALL = Path("/root/testdata/sf0.001")


def comparable(rows) -> list[tuple]:
    def plain(v):
        return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(name, spark, duck):
    df = queries.queries()[name](spark, str(SMALL))
    columns = sorted(df.columns)
    got = comparable(df.select(*columns).collect())
    result = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert got == comparable(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())


def test_pipeline(spark):
    import corpus_pipeline
    from plumbline.llm.common import written

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "dedup", "decontaminate", "pack"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(spark, stage(spark, docs, str(SMALL)), name)
        kept.append(docs.count())
        assert docs.columns == columns
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.5 * kept[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(SMALL))
    assert packed.select("doc_id").distinct().count() == kept[-1]
    assert corpus_pipeline.run(spark, str(SMALL)).count() == packed.count()

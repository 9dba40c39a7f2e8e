"""Every registered query of the engine against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest
from oracle_support import SMALL, comparable

from plumbline.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, spark, duck):
    df = registry.queries()[name](spark, str(SMALL))
    columns = sorted(df.columns)
    got = comparable(df.select(*columns).collect())
    result = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    rows = result.fetchall()
    assert sorted(names) == columns
    assert got == comparable(tuple(r[names.index(c)] for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(name, spark):
    assert registry.queries()[name](spark, str(SMALL)).count() >= 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and [r["n"] for r in rows] == sorted((r["n"] for r in rows), reverse=True)

"""Every registered engine query against its SQL at the smallest size."""

from pathlib import Path

import duckdb
import pytest

from foliospark.plans import registry

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(repr(tuple(v[k] for k in order)) for v in values)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, duck, name):
    mine = registry.QUERIES[name](spark, str(SF))
    theirs = duck.sql(registry.SQL[name])
    assert rows(mine.columns, [tuple(r) for r in mine.collect()]) == rows(theirs.columns, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, str(SF)).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

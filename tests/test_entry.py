import duckdb
import pytest

import __spark_entry__ as entry
from vicinal.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_sql_says_the_same(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = c.sql(catalog.ORACLE[name]), catalog.QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    order = [want.columns.index(x) for x in got.columns]
    tidy = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    assert tidy(map(tuple, got.collect())) == tidy(tuple(r[i] for i in order) for r in want.fetchall())


def test_every_query_is_listed():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0

"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""
import math

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

QUERIES, ORACLES = queries(), oracle_sql()
TABLES = "documents embeddings events pages labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    db = duckdb.connect(config={"temp_directory": ""})
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tiny}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_same_rows_as_sql(key, spark, duck, tiny):
    df = QUERIES[key](spark, tiny)
    names = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = duck.execute(ORACLES[key])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_the_others_run(key, spark, tiny):
    assert QUERIES[key](spark, tiny).count() > 0

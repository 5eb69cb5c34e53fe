"""Every registered query with SQL against DuckDB, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from bahikhata.plans.registry import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{tiny}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.isoformat()[:10] if isinstance(value, datetime.date) else value


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, tiny, name):
    df = QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    answer = duck.execute(ORACLE[name])
    names = [d[0] for d in answer.description]
    at = [names.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in at) for r in answer.fetchall()]
    assert sorted(names) == columns and sorted(map(repr, got)) == sorted(map(repr, want))


def test_every_query_runs(spark, tiny):
    for name in sorted(set(QUERIES) - set(ORACLE)):
        assert QUERIES[name](spark, tiny).count() > 0

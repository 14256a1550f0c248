"""Every registered query with SQL against DuckDB on the same tables."""

from decimal import Decimal

import duckdb
import pytest

from tracemill.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return round(float(v), 6) if isinstance(v, (float, Decimal)) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    out = QUERIES[name](spark, sf)
    columns = sorted(out.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in out.collect()), key=str)
    result = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(norm(dict(zip(names, r))[c]) for c in columns) for r in result.fetchall()), key=str)


def test_every_query_reads_and_returns(spark, sf):
    for name in sorted(set(QUERIES) - set(ORACLE_SQL)):
        assert QUERIES[name](spark, sf).count() > 0, name

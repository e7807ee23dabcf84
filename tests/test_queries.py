"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__  # noqa: F401 - its modules register their queries
from docforge.plans.registry import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 6) + 0.0) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, sf, name):
    query = QUERIES[name]
    df = query.run(spark, sf)
    got = [tuple(r) for r in df.collect()]
    if query.sql is None:
        assert got
        return
    r = db.execute(query.sql)
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(got, df.columns) == rows(r.fetchall(), columns)


def test_no_python_in_sql_queries(spark, sf):
    """Queries that SQL can express run without Python, but for the streaming one."""
    for name, query in QUERIES.items():
        if query.sql and name != "stream_change":
            plan = query.run(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
            assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, name

"""All queries with SQL against DuckDB, the others for their rows."""

import math
from decimal import Decimal

import duckdb
import pytest

from vqspark.plans.oracle import ORACLE_SQL
from vqspark.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, DATA)
    found = table(frame.columns, [tuple(r) for r in frame.collect()])
    if name not in ORACLE_SQL:
        assert found[1]
        return
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    cursor = db.execute(ORACLE_SQL[name])
    assert found == table([c[0] for c in cursor.description], cursor.fetchall())


def test_all_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)

"""Queries of this subpackage against their SQL, on the smallest tables."""

import math

import duckdb
import pytest

from vqspark.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=str), [names[i] for i in order]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for table in "documents embeddings pages benchmark labels conversations".split():
        db.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    found = QUERIES[name](spark, DATA)
    cursor = db.execute(ORACLE_SQL[name])
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == want

"""Queries against their SQL twins at the smallest size."""

import duckdb
import pytest

from habitat.llm.oracle import ORACLE
from habitat.llm.queries import QUERIES
from tools.check import rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    link = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        link.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found = link.execute(ORACLE[name])
    names = [c[0] for c in found.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(found.fetchall(), names)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))

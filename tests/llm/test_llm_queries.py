from collections import Counter

import duckdb
import pytest

from quireflow.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())

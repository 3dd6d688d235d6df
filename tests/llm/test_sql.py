"""Corpus queries against their SQL, over whole tables."""

import duckdb
import pytest

from idiolect.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "labels", "clicks"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(ORACLE_SQL[name]).to_arrow_table()
    got = QUERIES[name](spark, SF).toArrow()
    names = sorted(want.column_names)
    assert sorted(got.column_names) == names and want.num_rows > 0
    rows = lambda t: sorted(map(str, zip(*(t.column(c).to_pylist() for c in names))))
    assert rows(got) == rows(want)

"""Every query with SQL, against DuckDB over the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"


def test_queries_with_sql(spark):
    import duckdb

    from palimpsest.operator_queries import ORACLE_SQL, QUERIES

    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    shown = lambda v: round(v, 9) if isinstance(v, float) else v
    wrong = []
    for name, sql in ORACLE_SQL.items():
        df, want = QUERIES[name](spark, SF), con.sql(sql)
        columns = sorted(df.columns)
        at = [want.columns.index(c) for c in columns]
        got = sorted(str([shown(r[c]) for c in columns]) for r in df.collect())
        if got != sorted(str([shown(r[i]) for i in at]) for r in want.fetchall()):
            wrong.append(name)
    assert not wrong

"""Compares a query with its SQL on the smallest tables."""

import duckdb
import pytest

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture
def oracle_rows(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")

    def rows(columns, values):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        same = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
        return sorted(columns), sorted(([same(r[i]) for i in order] for r in values), key=str)

    def both(query, sql):
        df, found = query(spark, DIR), con.execute(sql)
        return rows(df.columns, df.collect()), rows([d[0] for d in found.description], found.fetchall())

    return both

"""Every query with an oracle, against DuckDB on the smallest tables; the entry point."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from linkloom.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    same = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted(([same(r[i]) for i in order] for r in values), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    found = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


def test_pair_cosines_of_pairs_without_a_shared_term(spark, tmp_path):
    """More than max_df records share every name, size and type, so S1-10 and S3-10 have no term in common that counts."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT k AS p_partkey, 'large ring' AS p_name, 'Brand#1' AS p_brand, 'LARGE' AS p_type, 10 AS p_size, 1.0 AS p_retailprice FROM range(15030) t(k)) TO '{tmp_path}/part.parquet'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    df = registry.QUERIES["pair_cosines"](spark, str(tmp_path))
    found = con.execute(registry.ORACLES["pair_cosines"])
    columns = [d[0] for d in found.description]
    got, wanted = rows(df.columns, df.collect()), rows(columns, found.fetchall())
    assert got == wanted and "S3-10" not in {v for r in got for v in r}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    """Every column of every row is computed."""
    rows = registry.QUERIES[name](spark, DIR).collect()
    assert rows and all(len(r) == len(rows[0]) for r in rows)


def test_spooled_tables_can_be_removed(spark):
    from pyspark.sql import functions as F

    from linkloom.sources import shared

    df = shared.spool(spark.range(10).withColumn("x", F.lit(1)), "kept")
    at = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 10 and shared.remove_spooled(spark) >= 1
    assert not Path(at).exists()


def test_most_queries_have_sql():
    assert len(set(registry.QUERIES) - set(registry.ORACLES)) <= 8

"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.shipping import ship
from linkloom.sources.shared import shared_dir, spool

__all__ = ["cut", "join_hot", "join_split", "prepare", "rows_in", "spool", "table"]


def cut(df: DataFrame) -> DataFrame:
    """Narrow rows, written once to the checkpoint folder; for what is used more than once or in a loop."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rows_in(df: DataFrame) -> int:
    """How many rows a table that ``cut`` wrote has, or a filter of it: one job without a shuffle."""
    return df._jdf.queryExecution().toRdd().count()


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
MAX_BATCH_ROWS = 2000  # texts are long: a batch of Spark's usual 10,000 rows is tens of MB on either side


def prepare(spark: SparkSession) -> None:
    """Before an operator runs: the package at the workers, and Arrow batches of a modest size."""
    ship(spark)
    if int(spark.conf.get(BATCH_ROWS, "10000")) > MAX_BATCH_ROWS:
        spark.conf.set(BATCH_ROWS, str(MAX_BATCH_ROWS))


def join_split(rows: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str = "left", parts: int = 64) -> DataFrame:
    """rows joined with right, which has at most one row a key, where a key may hold a large share of rows.

    The rows of a key are dealt to ``parts`` by a hash of the columns ``by``. right is first brought to the
    groups there are, at most ``parts`` a key, so that no task of either join has to take a key whole.
    """
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int"))
    brought = dealt.select(*keys, "_deal").distinct().join(right, keys, "inner")
    return dealt.join(brought, [*keys, "_deal"], how).drop("_deal")


MOST_HOT, LEAST_HOT = 1000, 10_000


def join_hot(rows: DataFrame, right: DataFrame, keys: list[str], n: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """rows joined with right, which has one row a key and in column ``n`` how many of rows have it.

    The MOST_HOT keys with the most rows, of those with LEAST_HOT or more, are sent to their rows where these are; of
    any other key there are fewer rows than LEAST_HOT or than a thousandth of all, so a task can take it. rows is read
    twice, and only narrow columns of a right that has few of them should come along. total: the number of rows, where
    it is known; below LEAST_HOT no key can be hot, and a plain join takes half as many stages.
    """
    if total is not None and total < LEAST_HOT:
        return rows.join(right, keys, how)
    hot = right.where(F.col(n) >= LEAST_HOT).orderBy(F.col(n).desc(), *keys).limit(MOST_HOT)
    light = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right, keys, how)
    return light.unionByName(rows.join(F.broadcast(hot), keys).select(*light.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Entity records, truth and scored pairs derived from the test tables, whole tables each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.shipping import ship
from linkloom.sources.shared import TASK_ROWS, dealt  # noqa: F401  (TASK_ROWS is named with dealt)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _country(names: tuple[str, str, str]):
    return F.when(F.col("p_partkey") % 3 == 0, names[0]).when(F.col("p_partkey") % 3 == 1, names[1]).otherwise(names[2])


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S1: a company for every part; S2, S3: rewritten copies of every second and every fifth."""
    part = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size"), "p_partkey")
    k, z = F.col("p_partkey"), F.col("p_size")
    say = F.concat

    def source(tag: str, name, address, countries) -> DataFrame:
        return part.select(say(F.lit(f"{tag}-"), k).alias("entity_id"), name.alias("business_name"), address.alias("business_address"), _country(countries).alias("country"))

    s1 = source("S1", say("p_name", F.lit(" Corporation")), say(z, F.lit(" "), "p_type", F.lit(" Street, Suite "), k), ("US", "India", "France"))
    part_all = part
    part = part_all.where(k % 2 == 0)
    s2 = source("S2", say(F.upper("p_name"), F.lit(" Corp.")), say(z, F.lit(" "), "p_type", F.lit(" St Ste "), k), ("USA", "IND", "FR"))
    part = part_all.where(k % 5 == 0)
    s3 = source("S3", say("p_name", F.lit(", Private Limited")), say("p_type", F.lit(" Street "), k), ("United States", "Bharat", "France"))
    return s1, s2, s3


def all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, s2, s3 = sources(spark, sf_dir)
    return s1.unionByName(s2).unionByName(s3)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_id, ids) of every S1."""
    k = F.col("p_partkey")
    ids = F.array_compact(F.array(F.when(k % 2 == 0, F.concat(F.lit("S2-"), k)), F.when(k % 5 == 0, F.concat(F.lit("S3-"), k))))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("S1-"), k).alias("s1_id"), ids.alias("ids"))


PAIR_ROWS = 100_000  # scored pairs that one task sorts and ranks, at any size of the tables


def pair_parts(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the scored pairs are dealt to."""
    return max(1, -(-table(spark, sf_dir, "lineitem").count() // PAIR_ROWS))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs (src, q_id, s1_id, p, ncos, acos, score) made of line items, one for each: queries are orders, parents parts."""
    li = table(spark, sf_dir, "lineitem")
    num = lambda a, b, c: F.pmod(F.col("l_partkey") * a + F.col("l_suppkey") * b + F.col("l_linenumber") * c, F.lit(997)) / 997.0
    # A query's pairs come together at once: what ranks them finds them in place.
    rows = li.select((F.pmod("l_orderkey", F.lit(2)) + 2).cast("int").alias("src"), F.col("l_orderkey").alias("q_id"), F.col("l_partkey").alias("s1_id"), num(31, 17, 7).alias("p"), num(13, 29, 3).alias("ncos"), num(41, 5, 11).alias("acos"))
    return rows.repartition(pair_parts(spark, sf_dir), "src", "q_id").groupBy("src", "q_id", "s1_id").agg(F.max("p").alias("p"), F.max("ncos").alias("ncos"), F.max("acos").alias("acos")).withColumn("score", 0.5 * (F.col("ncos") + F.col("acos")))


# The same in DuckDB's SQL, as common table expressions.

SOURCES_SQL = """
s1 AS (SELECT concat('S1-', p_partkey) AS entity_id, concat(p_name, ' Corporation') AS business_name, concat(p_size, ' ', p_type, ' Street, Suite ', p_partkey) AS business_address,
  CASE p_partkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END AS country FROM part),
s2 AS (SELECT concat('S2-', p_partkey) AS entity_id, concat(upper(p_name), ' Corp.') AS business_name, concat(p_size, ' ', p_type, ' St Ste ', p_partkey) AS business_address,
  CASE p_partkey % 3 WHEN 0 THEN 'USA' WHEN 1 THEN 'IND' ELSE 'FR' END AS country FROM part WHERE p_partkey % 2 = 0),
s3 AS (SELECT concat('S3-', p_partkey) AS entity_id, concat(p_name, ', Private Limited') AS business_name, concat(p_type, ' Street ', p_partkey) AS business_address,
  CASE p_partkey % 3 WHEN 0 THEN 'United States' WHEN 1 THEN 'Bharat' ELSE 'France' END AS country FROM part WHERE p_partkey % 5 = 0),
records AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)"""

TRUTH_SQL = """
truth AS (SELECT concat('S1-', p_partkey) AS s1_id, list_filter([CASE WHEN p_partkey % 2 = 0 THEN concat('S2-', p_partkey) END, CASE WHEN p_partkey % 5 = 0 THEN concat('S3-', p_partkey) END], lambda x: x IS NOT NULL) AS ids FROM part),
truth_pairs AS (SELECT s1_id, unnest(ids) AS cand_id FROM truth)"""

SCORED_SQL = """
scored AS (SELECT *, 0.5 * (ncos + acos) AS score FROM (
  SELECT CAST(l_orderkey % 2 + 2 AS INTEGER) AS src, l_orderkey AS q_id, l_partkey AS s1_id, max((l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7) % 997 / CAST(997 AS DOUBLE)) AS p,
    max((l_partkey * 13 + l_suppkey * 29 + l_linenumber * 3) % 997 / CAST(997 AS DOUBLE)) AS ncos, max((l_partkey * 41 + l_suppkey * 5 + l_linenumber * 11) % 997 / CAST(997 AS DOUBLE)) AS acos
  FROM lineitem GROUP BY ALL))"""

"""Streams: URLs analysed as they arrive, and new records matched with a standing table of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from linkloom.functions.text import normalized_records
from linkloom.functions.url import analyze
from linkloom.operators.blocking import blocking_keys


def read_stream(spark: SparkSession, path: str, schema: StructType, per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def analyzed_urls(urls: DataFrame) -> DataFrame:
    """The same columns as in batch: nothing about a URL depends on another."""
    return analyze(urls)


def arriving_candidates(records: DataFrame, target_keys: DataFrame) -> DataFrame:
    """(s1_id, cand_id, key, blocker) of arriving records against pruned keys of the targets, a stream-static join."""
    left = blocking_keys(normalized_records(records)).select("entity_id", "key").withColumnRenamed("entity_id", "s1_id")
    right = target_keys.select("key", "blocker", target_keys["entity_id"].alias("cand_id"))
    return left.join(right, "key")


def arriving_lists(records: DataFrame, lists: DataFrame) -> DataFrame:
    """(s1_id, bits, cand_ids): what each key of arriving records leads to; lists: (key, bits, cand_ids) of the targets, written."""
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a batch of few files is much work on few bytes
    left = blocking_keys(normalized_records(records.repartition(parts, "entity_id"))).select(F.col("entity_id").alias("s1_id"), "key")
    return left.join(lists, "key").select("s1_id", "bits", "cand_ids")


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """To Parquet, each row once across restarts, until what is there is done."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

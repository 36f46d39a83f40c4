"""Tables written once to the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


TASK_ROWS = 5_000  # of what is normalised and split into keys or terms: much work on rows of few bytes


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows in as many parts as their number asks for; a scan goes by bytes, and a small file is one task."""
    parts = -(-rows.count() // TASK_ROWS)
    return rows.repartition(parts, key) if parts > 1 else rows


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; where that is unset, a folder of our own in local mode, else an error."""
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and own.isDefined():
        return own.get()
    if named is None and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = named or tempfile.mkdtemp(prefix="linkloom-")
    if not own.isDefined():
        context.setCheckpointDir(folder)
    return folder


def spool(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cuts the lineage of what several later steps read."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _written.append(path)
    return df.sparkSession.read.parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """A side of a join that Spark sorts and merges but never sends whole through the driver to all executors.

    For what grows with the input. Spark takes a written table for as large as its files, and arrays for one element, so that it
    sends tables of well compressed ids and lists that are many times larger than its limit.
    """
    return df.hint("merge")


_written: list[str] = []


def remove_spooled(spark: SparkSession) -> int:
    """Deletes the tables that ``spool`` wrote in this process, once no DataFrame needs them; returns how many."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    paths, _written[:] = list(_written), []
    for path in paths:
        at = Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)

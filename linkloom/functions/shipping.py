"""Gives the package to the Python workers, for sessions whose executors don't have it installed."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from linkloom.sources.shared import shared_dir

PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application, writes a zip of the package to the shared folder and has the workers import from it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    at = f"{shared_dir(spark).rstrip('/')}/linkloom-{uuid.uuid4().hex}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(at)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(at)
    _shipped.add(sc.applicationId)

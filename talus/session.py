"""Session defaults: UTC, adaptive execution, Arrow, and partitions sized by the adaptive planner."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "talus", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return b.config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers that don't share the driver's path."""
    bound_batches(spark)
    root = Path(__file__).resolve().parents[1]
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    sc = spark.sparkContext
    if str(root) in on_path or getattr(sc, "_talus_shipped", False):
        return
    out = Path(tempfile.mkdtemp()) / "talus_package.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in (root / "talus").rglob("*.py"):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(out))
    sc._talus_shipped = True


#: Arrow batches of whole texts: rows that a Python worker holds at once, where the session keeps Spark's default.
BATCH_ROWS = 1500


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default of 10,000 rows, for the memory of workers; a value that is set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))

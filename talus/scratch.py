"""Scratch folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_talus_shared", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = spark.sparkContext._talus_shared = f"file://{tempfile.mkdtemp(prefix='talus-shared-')}"
    return at.rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/talus/{what}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm = spark._jvm
    for at in paths:
        p = jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def retire(spark: SparkSession, *paths: str) -> None:
    """Scratch tables that a result still reads; sweep deletes them."""
    sc = spark.sparkContext
    sc._talus_retired = [*getattr(sc, "_talus_retired", []), *paths]


def retired(spark: SparkSession) -> list[str]:
    return list(getattr(spark.sparkContext, "_talus_retired", []))


def sweep(spark: SparkSession, keep: list[str] | None = None) -> None:
    """Delete the scratch tables of results that are written or used by now, but for those to keep."""
    held = set(keep or ())
    discard(spark, *[p for p in retired(spark) if p not in held])
    spark.sparkContext._talus_retired = [p for p in retired(spark) if p in held]

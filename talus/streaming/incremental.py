"""Incremental forms: file streams into state tables, deduplication and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

#: Hash partitions of an ingested table.
PARTS = 64


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def ingest_messages(stream: DataFrame, target: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Insert rows with new keys: each batch writes only its own new rows, to a folder of hash partitions of the keys.

    A batch is held against the keys in the partitions that it touches; of rows that share a key within it, the first by the other
    columns counts. A replayed batch overwrites its own folder, which it leaves out of what was there before, so restarts insert nothing
    twice. Every COMPACT batches what came before is written together, so that neither folders nor small files pile up."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        first = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row")).select(*[F.col(c) if c in keys else F.col(f"__row.`{c}`").alias(c) for c in batch.columns]) if rest else batch.distinct()
        rows = first.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")).persist()
        base, there = folders_of(spark, target)
        if len(there) >= COMPACT and there[-1] < epoch:
            compact(spark, target)
            base, there = folders_of(spark, target)
        held = [f"{target}/base={base}"] * (base is not None) + [f"{target}/batch={b}" for b in there if b != epoch]
        new = rows
        if held:
            touched = [r.part for r in rows.select("part").distinct().collect()]  # at most PARTS
            new = rows.join(_read(spark, rows.schema, *held).where(F.col("part").isin(touched)).select(*keys), keys, "left_anti").select(*batch.columns, "part")
        new.write.mode("overwrite").partitionBy("part").parquet(f"{target}/batch={epoch}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Batches that lie apart before they are written together.
COMPACT = 64


def _read(spark: SparkSession, schema: T.StructType, *paths: str) -> DataFrame:
    """Rows of folders of hash partitions, with their partition."""
    out = [spark.read.schema(schema).parquet(p) for p in paths]
    return reduce(DataFrame.unionByName, out)


def folders_of(spark: SparkSession, target: str) -> tuple[int | None, list[int]]:
    """The last batch of the compacted folder, if there is one, and the batches behind it that are written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    found = lambda kind: sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in fs.globStatus(path(f"{target}/{kind}=*/_SUCCESS")) or [])
    bases = found("base")
    return (bases[-1] if bases else None), [b for b in found("batch") if not bases or b > bases[-1]]


def compact(spark: SparkSession, target: str) -> None:
    """Write the compacted folder and all batches as one new compacted folder; what it replaces goes once it is whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    base, there = folders_of(spark, target)
    if not there:
        return
    old = [f"{target}/base={base}"] * (base is not None) + [f"{target}/batch={b}" for b in there]
    schema = spark.read.parquet(*old[:1]).schema
    _read(spark, schema, *old).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{target}/base={there[-1]}")
    for at in old:
        fs.delete(path(at), True)


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """All rows that batches have inserted."""
    base, there = folders_of(spark, target)
    paths = [f"{target}/base={base}"] * (base is not None) + [f"{target}/batch={b}" for b in there]
    return reduce(DataFrame.unionByName, [spark.read.parquet(p) for p in paths]).drop("part")


def dedupe(stream: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; its state goes when the watermark passes."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, ts: str, by: list[str], width: str = "1 hour", delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and totals per window; late rows beyond the watermark are dropped by definition."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, delay).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(stream: DataFrame, ts: str, by: list[str], gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n_events")).select(F.col("w.start").alias("start"), *by, "n_events")


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drive the stream over what there is now into Parquet and read it."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""What the corpus operators share: shared scratch tables, hashing and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.scratch import discard, retire, retired, shared_dir, sweep  # noqa: F401  (operators take them from here)
from talus.scratch import fresh as fresh_path
from talus.session import ship  # noqa: F401

#: Sides of a join up to this many bytes (rows x row width, counted first) are broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: later stages don't depend on lost executors."""
    at = fresh_path(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at), at


#: What a Python worker keeps from one task to the next, by the module that keeps it and a key.
HELD: dict[tuple[str, str], object] = {}


def give_back() -> None:
    """Memory that this process no longer uses goes back to the system: allocators keep it else."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # other libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def forget(keeps: str) -> None:
    for key in [k for k in HELD if k[0] != keeps]:
        del HELD[key]


def lean(run: Callable[[Iterator], Iterator], keeps: str = "") -> Callable[[Iterator], Iterator]:
    """run, a function over Arrow batches, whose worker holds little once it has ended: workers stay and wait beside those of the
    next stages. What modules other than `keeps` hold from earlier tasks goes first."""

    def go(batches):
        forget(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return go


def bucket_of_id(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, mod m; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def bytes_of(column) -> list[bytes]:
    """Arrow strings as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def words_of(raw: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased."""
    return raw.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles_of(raw: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `size` words; fewer words count as one run, none as no run."""
    h = word_hashes(words_of(raw))
    if not len(h):
        return h
    span = min(size, len(h))
    mult = np.array([_MULT[i % len(_MULT)] + np.uint64(2 * (i // len(_MULT))) for i in range(span)], dtype=np.uint64)
    n = len(h) - span + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(span):
        total += mix64(h[i : i + n] + np.uint64(i)) * mult[i]
    return np.unique(mix64(total + np.uint64(span)))


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where a table comes in fewer partitions than there are cores; large tables stay as they are, and so
    does what a shuffle deals anyway (counting its partitions would run it)."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_enough(n_rows: int, row_bytes: int) -> bool:
    return n_rows * row_bytes <= BROADCAST_BYTES


def least_neighbours(hit: np.ndarray) -> np.ndarray:
    """For each row of a symmetric adjacency matrix the smallest row of its component."""
    label = np.arange(len(hit))
    while True:
        low = np.minimum(label, np.where(hit, label[None, :], len(hit)).min(axis=1, initial=len(hit)))
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def components(edges: DataFrame, what: str = "components") -> tuple[DataFrame, str]:
    """Connected components of edges (a long, b long) as (node, component), component the smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each step only groups by node
    with a partial minimum and joins the minimum back, so a hub's neighbours never meet in one task. Each
    step is written to the shared folder; the loop ends when every node points to a node that points nowhere, which is
    when a step can change nothing. Self-loops and nulls are ignored. Nothing is collected but a flag a step."""
    spark = edges.sparkSession
    pair = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur, path = materialize(pair, what)

    def settled(df: DataFrame) -> bool:
        """Whether all edges are stars: no node has two lesser ones, and none is both a leaf and a centre."""
        if not df.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return False
        return df.select("v").distinct().join(df.select("u"), F.col("v") == F.col("u"), "left_semi").isEmpty()

    while not settled(cur):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first, so that the join deals both sides itself and adaptive execution can split a hub's rows.
        low, low_path = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), what)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        mid, mid_path = materialize(large, what)
        discard(spark, low_path)
        low, low_path = materialize(mid.groupBy("u").agg(F.min("v").alias("m")), what)
        small = mid.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new, new_path = materialize(small, what)
        discard(spark, path, mid_path, low_path)
        path, cur = new_path, new
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), path

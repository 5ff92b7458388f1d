"""Nearest vectors by blocks: numpy products inside tasks, partial top-k per block, one final ranking.

No pairs leave a task but each block's best. Queries lie in blocks in the shared folder, where the tasks read them: none
goes through the driver, nothing is broadcast, and the items are scanned once."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.scratch import fresh, retire
from talus.session import ship

#: Query vectors of a block, items that a task holds at once, and members of a group in one block.
QUERY_BLOCK, ITEM_CHUNK, GROUP_BLOCK = 4096, 100_000, 1024


def _flat(column) -> np.ndarray:
    """A list column as a matrix, from its values as they lie in memory; missing components are NaN."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _best(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every entry that is among the k largest of its row, ties included, NaN excluded."""
    sim = np.where(np.isnan(sim), -np.inf, sim)
    if sim.shape[1] > k:
        least = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
        return np.nonzero((sim >= least[:, None]) & np.isfinite(sim))
    return np.nonzero(np.isfinite(sim))


def nearest_to_queries(queries: DataFrame, items: DataFrame, query_id: str, query_vec: str, item_id: str, item_vec: str, k: int, differ: tuple[str, str] | None = None) -> DataFrame:
    """(query_id, item_id, sim, rank): the k items of greatest inner product for each query; ties by item id.

    differ names a column of the queries and one of the items that must not be equal. Items and queries without a
    vector are left out."""
    spark = items.sparkSession
    ship(spark)
    own = differ or (None, None)
    rows = items.where(F.col(item_vec).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_vec).alias("v"), (F.col(own[1]).cast("string") if own[1] else F.lit(None).cast("string")).alias("g"))
    asked = queries.where(F.col(query_vec).isNotNull()).select(F.col(query_id).alias("q"), F.col(query_vec).cast("array<double>").alias("v"), (F.col(own[0]).cast("string") if own[0] else F.lit(None).cast("string")).alias("g"))
    kinds = f"q {asked.schema['q'].dataType.simpleString()}, item {rows.schema['i'].dataType.simpleString()}, sim double"
    at = fresh(spark, "queries")
    asked.write.option("maxRecordsPerFile", QUERY_BLOCK).parquet(at)
    retire(spark, at)

    def search(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(at)
        blocks = sorted(f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet"))

        def best(held):
            ids = pa.concat_arrays([b.column(0) for b in held])
            matrix, groups = np.concatenate([_flat(b.column(1)) for b in held]).astype(np.float64), np.array([x for b in held for x in b.column(2).to_pylist()], dtype=object)
            for path in blocks:
                for t in pq.ParquetFile(path, filesystem=store).iter_batches(QUERY_BLOCK):
                    for lo in range(0, t.num_rows, 256):
                        part = t.slice(lo, 256)
                        sim = _flat(part.column(1)) @ matrix.T
                        if own[0]:
                            sim[np.array(part.column(2).to_pylist(), dtype=object)[:, None] == groups[None, :]] = -np.inf
                        r, c = _best(sim, k)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), ids.take(pa.array(c)), pa.array(sim[r, c], pa.float64())], names=["q", "item", "sim"])

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= ITEM_CHUNK:
                yield from best(held)
                held, n = [], 0
        if held:
            yield from best(held)

    out = rows.mapInArrow(search, kinds)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "item"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("item").alias(item_id), "sim", "rank")


def nearest_in_group(rows: DataFrame, group: list[str], id_col: str, vec_col: str, k: int, skip: str | None = None) -> DataFrame:
    """(a, b, sim): for each row the k most similar others of its group by cosine, leaving out ids in the array `skip`.

    A group is dealt to blocks of about GROUP_BLOCK rows, which lie in the shared folder once. A unit is one block: its task reads the
    group's blocks one by one and keeps the best k of each row, so what is written and shuffled grows as the rows do."""
    spark = rows.sparkSession
    ship(spark)
    whole = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in group], F.col(vec_col).isNotNull())
    unit = F.md5(F.to_json(F.struct(*group)).cast("binary"))
    base = rows.where(whole).select(unit.alias("unit"), F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<double>").alias("v"), (F.col(skip) if skip else F.array()).cast("array<bigint>").alias("s"))
    sizes = base.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / GROUP_BLOCK).cast("int").alias("blocks"))
    dealt = base.join(sizes, "unit").withColumn("block", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int")).drop("blocks")
    at = fresh(spark, "group-blocks")
    dealt.repartition("unit", "block").sortWithinPartitions("unit", "block").write.partitionBy("unit", "block").parquet(at)
    retire(spark, at)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    units = sizes.select("unit", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "blocks").repartition(tasks, "unit", "block")

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(at)

        def block(unit, n):
            found = store.get_file_info(fs.FileSelector(f"{folder}/unit={unit}/block={n}", allow_not_found=True))
            parts = [pq.ParquetFile(f.path, filesystem=store).read(["i", "v", "s"]) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".parquet")]
            if not parts:
                return None
            t = pa.concat_tables(parts).combine_chunks()
            m = _flat(t["v"].combine_chunks())
            with np.errstate(divide="ignore", invalid="ignore"):
                return t["i"].to_numpy(), m / np.linalg.norm(m, axis=1)[:, None], t["s"]

        for batch in batches:
            for unit, own, blocks in zip(*[batch.column(n).to_pylist() for n in range(3)], strict=True):
                left = block(unit, own)
                if left is None:
                    continue
                ids, vectors, skips = left
                skips = [(i, *(x or ())) for i, x in zip(ids.tolist(), skips.to_pylist(), strict=True)]
                row, other, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                for n in range(blocks):
                    right = left if n == own else block(unit, n)
                    if right is None:
                        continue
                    sim = vectors @ right[1].T
                    place = {i: c for c, i in enumerate(right[0].tolist())}
                    for r, without in enumerate(skips):
                        for i in without:
                            if i in place:
                                sim[r, place[i]] = -np.inf
                    r, c = _best(sim, k)
                    row, other, best = np.concatenate([row, r]), np.concatenate([other, right[0][c]]), np.concatenate([best, sim[r, c]])
                    order = np.lexsort((other, -best, row))
                    row, other, best = row[order], other[order], best[order]
                    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                    row, other, best = row[keep], other[keep], best[keep]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row], pa.int64()), pa.array(other, pa.int64()), pa.array(best, pa.float64())], names=["a", "b", "sim"])

    found = units.mapInArrow(run, "a long, b long, sim double")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")

"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one vector kept a group.

Equal vectors are one class first. Each class goes to its nearest cells; a cell's members are dealt to blocks, and each
pair of blocks of a cell is one unit of work whose products give link counts and a spanning forest, never the pairs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, least_neighbours, materialize, retire, ship, small_enough

#: Cells are fitted on at most so many vectors and bytes, those whose id hash comes first; every vector is assigned.
FIT_VECTORS, ROUNDS = 65_536, 8
FIT_BYTES = 64 << 20
#: Classes a cell should have, and the most cells there are; larger cells only mean more pairs of blocks.
PER_CELL, MAX_CELLS = 400, 4096
#: Each class is compared in its home cell and in up to so many others whose centre is nearly as near; the exact mode takes
#: all cells that can be home to a vector within the angle.
NEAREST, SLACK = 6, 0.25
#: Classes of a cell that meet in one block.
BLOCK = 512


def _unit(batches):
    """(vec_id, embedding) to (vec_id, key, vector): unit double vectors, null where there is no direction."""
    import pyarrow as pa

    for batch in batches:
        keys, out = [], []
        for x in batch.column(1).to_pylist():
            v = None
            if x is not None and len(x) and None not in x:
                v = np.array(x, dtype=np.float64)
                top = np.abs(v).max()
                # Scaled first, so that very large or small components neither overflow nor vanish.
                v = v / top if np.isfinite(top) and top > 0 and np.isfinite(v).all() else None
            if v is None:
                keys.append(None)
                out.append(None)
            else:
                v = v / np.sqrt(v @ v)
                keys.append(v.tobytes())
                out.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["vec_id", "key"])


def fit_cells(sample: np.ndarray, n_cells: int, seed: int = 11) -> np.ndarray:
    """Unit centres of spherical k-means; an empty cell takes the vector that is farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(n_cells, len(sample)), replace=False)].copy()
    for _ in range(ROUNDS):
        own, near = np.empty(len(sample), np.int64), np.empty(len(sample))
        for at in range(0, len(sample), 4096):
            s = sample[at : at + 4096] @ centres.T
            own[at : at + 4096], near[at : at + 4096] = s.argmax(axis=1), s.max(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        size = np.linalg.norm(total, axis=1)
        lost = np.flatnonzero(size < 1e-9)
        if len(lost):
            total[lost] = sample[np.argsort(near)[: len(lost)]]
            size[lost] = 1
        centres = total / np.maximum(size, 1e-12)[:, None]
    return centres


def cells_of(v: np.ndarray, centres: np.ndarray, sine: float | None) -> np.ndarray:
    """Which cells each unit vector is compared in, its home among them.

    With the sine of an angle: all cells that may be home to a vector within it. The bisector of the home centre h and
    another c parts their cells; v is (h - c) v / |h - c| from it in sine, and vectors beyond it are at least that far from v."""
    s = v @ centres.T
    home = s.argmax(axis=1)
    if sine is None:
        k = min(NEAREST, s.shape[1])
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out = np.zeros(s.shape, dtype=bool)
        np.put_along_axis(out, top, np.take_along_axis(s, top, 1) >= s.max(axis=1, keepdims=True) - SLACK, 1)
        return out
    apart = np.sqrt(np.maximum(2 - 2 * (centres[home] @ centres.T), 0))
    return s.max(axis=1, keepdims=True) - s <= sine * apart + 1e-9


def _assign(shared, sine: float | None = None):
    """Each class once for each of its cells, with the list of them all."""

    def run(batches):
        import pyarrow as pa

        centres = shared.value
        for batch in batches:
            ids, n, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            cell, cells, at = [], [], []
            for dim in {len(k) for k in keys}:
                which = [i for i, k in enumerate(keys) if len(k) == dim]
                c = centres[dim // 8]
                for lo in range(0, len(which), 1024):
                    part = which[lo : lo + 1024]
                    inside = cells_of(np.frombuffer(b"".join(keys[i] for i in part)).reshape(len(part), -1), c, sine)
                    for i, own in zip(part, inside, strict=True):
                        mine = np.flatnonzero(own).tolist()
                        for x in mine:
                            at.append(i)
                            cell.append(x)
                            cells.append(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(keys[i]) // 8 for i in at], pa.int32()), pa.array(cell, pa.int32()), pa.array([ids[i] for i in at], pa.int64()), pa.array([n[i] for i in at], pa.int64()), pa.array([keys[i] for i in at], pa.binary()), pa.array(cells, pa.list_(pa.int32()))],
                names=["dim", "cell", "vec_id", "n", "key", "cells"],
            )

    return run


def _forest(hit: np.ndarray) -> list[tuple[int, int]]:
    """(node, smallest node of its component) of a symmetric adjacency matrix, without the roots."""
    return [(i, int(j)) for i, j in enumerate(least_neighbours(hit)) if i != j]


def _compare(cosine: float):
    """Rows (dim, cell, u1, u2, side, vec_id, n, key, cells) sorted by unit; yields (a, b, links): a star link a-b of
    the unit, or with b null the number of vectors linked to a that the unit is the one to count."""

    def close(unit, rows):
        u1, u2 = unit[2], unit[3]
        if u1 != u2 and len({r[0] for r in rows}) < 2 or len(rows) < 2:
            return [], [], []
        rows.sort(key=lambda r: (r[0], r[1]))
        side, ids, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        v = np.frombuffer(b"".join(r[3] for r in rows)).reshape(len(rows), -1)
        hit = v @ v.T >= cosine
        np.fill_diagonal(hit, False)
        if u1 != u2:
            hit &= side[:, None] != side[None, :]
        if not hit.any():
            return [], [], []
        # A pair that shares several cells counts in the first of them.
        first = np.ones_like(hit)
        live = np.flatnonzero(hit.any(axis=1))
        earlier = {i: {c for c in rows[i][4] if c < unit[1]} for i in live}
        busy = [i for i in live if earlier[i]]
        if busy:
            names = sorted(set().union(*(earlier[i] for i in busy)))
            m = np.zeros((len(rows), len(names)), dtype=np.float32)
            for i in busy:
                m[i, [names.index(c) for c in earlier[i]]] = 1
            first = m @ m.T == 0
        links = (hit & first) @ n
        a, b, k = [], [], []
        for i, j in _forest(hit):
            x, y = int(ids[i]), int(ids[j])
            a.append(max(x, y))
            b.append(min(x, y))
            k.append(0)
        for i in np.flatnonzero(links):
            a.append(int(ids[i]))
            b.append(None)
            k.append(int(links[i]))
        return a, b, k

    def run(batches):
        import pyarrow as pa

        def out(unit, rows):
            a, b, k = close(unit, rows)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(k, pa.int64())], names=["a", "b", "links"])

        unit, rows = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(9)]
            for row in zip(*columns, strict=True):
                if row[:4] != unit:
                    if unit is not None:
                        yield out(unit, rows)
                    unit, rows = row[:4], []
                rows.append(row[4:])
        if unit is not None:
            yield out(unit, rows)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, exact: bool = False) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Without exact, pairs whose vectors share none of their NEAREST cells are lost; with it none is, at the cost of many
    more cells where vectors form no clusters.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do vectors of
    different lengths. Equal directions link. Rows that repeat an id are one node for components, but each is a vector
    that others link to. Null ids link with nothing, have a null component and are kept. Other columns are ignored; an
    empty table gives an empty result."""
    spark = vectors.sparkSession
    ship(spark)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    unit, unit_path = materialize(base.mapInArrow(_unit, "vec_id long, key binary"), "cells-unit")
    classes, class_path = materialize(unit.where("key is not null and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).select("rep", "n", "key"), "cells-classes")
    dims = [(r.dim, r.n) for r in classes.groupBy((F.length("key") / 8).cast("int").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()]  # a row for each length of vector
    centres = {}
    for dim, n in dims:
        n_cells = max(1, min(MAX_CELLS, math.ceil(n / PER_CELL)))
        rows = classes.where(F.length("key") == 8 * dim).orderBy(F.xxhash64("rep"), "rep").limit(min(FIT_VECTORS, 40 * n_cells + 1000, max(1000, FIT_BYTES // (8 * dim)))).select("key").collect()
        centres[dim] = fit_cells(np.frombuffer(b"".join(bytes(r.key) for r in rows)).reshape(len(rows), dim), n_cells)
    placed, placed_path = materialize(classes.mapInArrow(_assign(spark.sparkContext.broadcast(centres), math.sqrt(1 - cosine**2) if exact else None), "dim int, cell int, vec_id long, n long, key binary, cells array<int>"), "cells-placed")
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sizes = F.broadcast(sizes) if small_enough(sum(len(c) for c in centres.values()), 32) else sizes
    blocked = placed.join(sizes, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("u1"), F.greatest(k, F.col("block")).alias("u2"), F.when(k < F.col("block"), 1).otherwise(0).alias("side")))
    units = blocked.select("dim", "cell", F.explode(pairs).alias("u"), "vec_id", "n", "key", "cells").select("dim", "cell", "u.u1", "u.u2", "u.side", "vec_id", "n", "key", "cells")
    found = units.repartition("dim", "cell", "u1", "u2").sortWithinPartitions("dim", "cell", "u1", "u2").mapInArrow(_compare(cosine), "a long, b long, links long")
    found, found_path = materialize(found, "cells-found")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    joined, joined_path = components(found.where("b is not null").select("a", "b"), "cells-joined")
    joined = joined.groupBy(F.col("node").alias("rep")).agg(F.min("component").alias("component"))
    labelled = classes.join(counts, "rep", "left").join(joined, "rep", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("label"))
    out = unit.join(labelled.withColumnRenamed("key", "its_key"), F.col("vec_id").isNotNull() & (F.col("key") == F.col("its_key")), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("label", "vec_id").alias("component_id"))
    out, at = materialize(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "cells-out")
    retire(spark, at)
    discard(spark, unit_path, class_path, placed_path, found_path, joined_path)
    return out

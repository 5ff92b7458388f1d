"""MinHash near-duplicates by min-max hashing.

Each permutation of a document's shingle hashes gives two signature values, its minimum and its maximum, so
half as many evaluations fill a signature (Ji et al., 2013). Documents that share a band are compared by their whole
signatures; those that come near the threshold there, and chains of them, are a family, within which every link is
confirmed on the full shingle sets before components are formed. Groups of either kind are compared in blocks: all
members with a pivot first, and only those that don't reach it with all others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, components, discard, lean, least_neighbours, materialize, retire, shingles_of, ship, small_enough, spread

#: 90 permutations give 180 values: 30 bands of 6. A pair at similarity 0.85 is in no common band with
#: probability (1 - 0.85**6)**30 < 7e-7, at 0.8 below 1.3e-4.
PERMUTATIONS, BAND_ROWS = 90, 6
#: Signatures that agree in a share of values this much below the threshold make a family. Minimum and maximum of one
#: permutation agree with a correlation below zero, so that is 4.7 standard errors of 180 values at 0.8, and 5.2 at 0.85.
MARGIN = 0.14
#: Documents of a family, and signatures of a bucket, that meet in one block.
BLOCK, SIGNATURE_BLOCK = 256, 512
_CHUNK = 1 << 16


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20140611)
    return rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32), rng.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 2 x PERMUTATIONS uint32 values for each non-empty set."""
    xor, mult = _permutations()
    out = np.empty((len(sets), 2 * PERMUTATIONS), dtype=np.uint32)
    first = 0
    while first < len(sets):
        last, n = first, 0
        while last < len(sets) and (last == first or n + len(sets[last]) <= _CHUNK):
            n += len(sets[last])
            last += 1
        x = np.concatenate(sets[first:last])
        x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[first : last - 1]])]).astype(np.intp)
        for k in range(PERMUTATIONS):
            y = (x ^ xor[k]) * mult[k]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            out[first:last, k] = np.minimum.reduceat(y, starts)
            out[first:last, PERMUTATIONS + k] = np.maximum.reduceat(y, starts)
        first = last
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; each band takes minima and maxima of neighbouring permutations."""
    from xxhash import xxh3_64_intdigest

    order = np.arange(2 * PERMUTATIONS).reshape(2, PERMUTATIONS).T.reshape(-1, BAND_ROWS)
    keys = np.empty((len(sig), len(order)), dtype=np.int64)
    for b, cols in enumerate(order):
        part = np.ascontiguousarray(sig[:, cols])
        keys[:, b] = np.array([xxh3_64_intdigest(row.tobytes(), seed=b) for row in part], dtype=np.uint64).view(np.int64)
    return keys


def short_signatures(sig: np.ndarray) -> np.ndarray:
    """A byte for each value: equal values agree, others do in 1 of 256 cases."""
    return ((sig * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _sketch(size: int):
    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            ids, texts = batch.column(0), bytes_of(batch.column(1))
            for at in range(0, len(texts), 256):
                sets = [shingles_of(t, size) for t in texts[at : at + 256]]
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                short: list = [None] * len(sets)
                if full:
                    sig = signatures([sets[i] for i in full])
                    for i, row, own in zip(full, band_keys(sig), short_signatures(sig), strict=True):
                        bands[i], short[i] = row, own.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, 256), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary())],
                    names=["doc_id", "n_shingles", "set_key", "bands", "short"],
                )

    return run


def near_signatures(rows: list[bytes], least: int) -> np.ndarray:
    """Which pairs of short signatures agree in at least so many values."""
    m = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)
    if len(rows) <= 48:
        return (m[:, None, :] == m[None, :, :]).sum(axis=2) >= least
    same = np.zeros((len(rows), len(rows)), dtype=np.uint8)  # there are 180 values at most
    for c in range(m.shape[1]):
        same += m[:, c, None] == m[None, :, c]
    return same >= least


def near_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets have 100 * intersection >= percent * union."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    both = np.zeros((n, n), dtype=np.int64)
    if n <= 6:
        for i in range(n):
            for j in range(i + 1, n):
                if 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j]):
                    both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(n), sizes)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for c in range(0, len(values), 4096):
            lo, hi = np.searchsorted(column, [c, c + 4096])
            m = np.zeros((n, 4096), dtype=np.float32)
            m[row[lo:hi], column[lo:hi] - c] = 1
            live = np.flatnonzero(m.sum(axis=0) > 1)
            if len(live):
                m = m[:, live]
                both += (m @ m.T).astype(np.int64)
    return (both > 0) & (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both))


def _linked(near, prepare):
    """Rows (grp, u1, u2, side, blocks, id, payload) sorted by (grp, u1, u2). A unit with side 0 alone has the group's pivot,
    its smallest id, and members: yields (a, b, null) links that span its components and, where the group has more blocks,
    (id, null, grp) of members that don't reach the pivot. In a unit with both sides only links between them count."""

    def close(grp, rows, out):
        if len(rows) < 2:
            return
        side, ids = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
        hit = near([prepare(r[3]) for r in rows])
        crossed = bool(side.any())
        if crossed:
            hit = hit & (side[:, None] != side[None, :])
        hit = hit | (ids[:, None] == ids[None, :])
        np.fill_diagonal(hit, False)
        label = least_neighbours(hit)
        for i in np.flatnonzero(label != np.arange(len(rows))):
            x, y = int(ids[i]), int(ids[label[i]])
            if x != y:
                out.append((max(x, y), min(x, y), None))
        if not crossed and rows[0][1] > 1:
            pivot = label[int(ids.argmin())]
            out += [(int(ids[i]), None, grp) for i in np.flatnonzero(label != pivot)]

    def run(batches):
        import pyarrow as pa

        def packed(out):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["a", "b", "grp"])

        unit, rows, out = None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            side, blocks, ids = (batch.column(i).to_pylist() for i in (3, 4, 5))
            for i, x in enumerate(bytes_of(batch.column(6))):
                if keys[i] != unit:
                    if unit is not None:
                        close(unit[0], rows, out)
                    unit, rows = keys[i], []
                rows.append((side[i], blocks[i], ids[i], x))
            if len(out) > 4096:
                yield packed(out)
                out = []
        if unit is not None:
            close(unit[0], rows, out)
        yield packed(out)

    return run


def link_groups(members: DataFrame, payload, near, prepare, block: int, what: str) -> tuple[DataFrame, list[str]]:
    """Links (a, b) that span the components which near forms within groups, and scratch tables to discard.

    members: grp, id; payload gives (id, payload) rows joined to those of a frame with an id. A group's members are dealt to blocks. Each block meets the group's pivot;
    members that reach it there are in one component and needn't be compared any more. The others meet all blocks, so
    that no pair of different components is left out. A group of near copies costs as much as its members; one without links, as its pairs."""
    unit = ["grp", "u1", "u2"]
    schema = "a long, b long, grp long"
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("pivot"))
    placed = members.join(sizes, "grp").where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed, placed_path = materialize(placed.select("grp", "id", "blocks", "block", (F.col("id") == F.col("pivot")).alias("first")), what)

    def compared(rows: DataFrame) -> tuple[DataFrame, str]:
        n = rows.count()
        rows = F.broadcast(rows) if small_enough(n, 60) else rows
        full = payload(rows).select(*unit, "side", "blocks", "id", "payload")
        return materialize(full.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(lean(_linked(near, prepare)), schema), what)

    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    stars = placed.select("grp", F.explode(F.when(F.col("first"), every).otherwise(F.array("block"))).alias("u1"), F.lit(-1).alias("u2"), F.lit(0).alias("side"), "blocks", "id")
    found, found_path = compared(stars)
    paths = [placed_path, found_path]
    left = found.where("b is null").select("grp", F.col("a").alias("id")).distinct()
    if not left.isEmpty():
        others = left.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
        moved = left.join(others, "grp").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("grp", "id", "part")
        one = moved.join(placed.select("grp", "id", "blocks"), ["grp", "id"]).select("grp", F.col("part").alias("u1"), F.explode(every).alias("u2"), F.lit(1).alias("side"), "blocks", "id")
        two = placed.join(others, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("u1"), F.col("block").alias("u2"), F.lit(0).alias("side"), "blocks", "id")
        rest, rest_path = compared(one.union(two))
        paths.append(rest_path)
        found = found.union(rest)
    return found.where("b is not null").select("a", "b"), paths


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets have 100 * intersection >= percent * union.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest id reachable), kept. Null or empty
    texts have an empty set and link with nothing. Rows with a null id link with nothing, have a null component
    and are kept. Repeated rows share a component; rows that repeat an id with other texts are one node, which all their
    texts link, and an empty one among them goes with the others. Other columns of docs are ignored, whatever their
    names. An empty table gives an empty result."""
    spark = docs.sparkSession
    ship(spark)
    base = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    sketched, sketch_path = materialize(base.mapInArrow(lean(_sketch(shingle)), "doc_id long, n_shingles long, set_key binary, bands array<long>, short binary"), "minmax-sketch")
    # Equal sets are one class from here on; only its smallest id goes further.
    classes, class_path = materialize(sketched.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "bands", "short")).alias("r")).select("set_key", F.col("r.doc_id").alias("rep"), F.col("r.bands").alias("bands"), F.col("r.short").alias("short")), "minmax-classes")
    repeated, repeated_path = materialize(sketched.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("set_key").alias("first_key")).where("n > 1 and doc_id is not null and first_key is not null").select("doc_id", "first_key"), "minmax-repeated")
    paths = [sketch_path, class_path, repeated_path]
    member = classes.select("rep", F.explode("bands").alias("grp"))
    buckets = member.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp")
    shared, shared_path = materialize(member.join(buckets, "grp").select("grp", F.col("rep").alias("id")), "minmax-buckets")
    least = int(np.ceil(2 * PERMUTATIONS * (percent / 100 - MARGIN)))
    alike, alike_paths = link_groups(shared.distinct(), lambda rows: classes.select(F.col("rep").alias("id"), F.col("short").alias("payload")).join(rows, "id"), lambda rows: near_signatures(rows, least), bytes, SIGNATURE_BLOCK, "minmax-alike")
    family, family_path = components(alike, "minmax-family")
    family, family_table = materialize(family.groupBy("node").agg(F.min("component").alias("grp")).select("grp", F.col("node").alias("id")), "minmax-families")
    ids = F.broadcast(repeated) if small_enough(repeated.count(), 64) else repeated
    again = not repeated.isEmpty()

    def texts(rows: DataFrame) -> DataFrame:
        full = base.select(F.col("doc_id").alias("id"), F.col("text").alias("payload")).join(rows, "id")
        if not again:
            return full
        # Of rows that repeat an id, one for each text, however often it is there.
        twice = ids.select(F.col("doc_id").alias("id"))
        keys = [c for c in full.columns if c != "payload"]
        few = full.join(twice, "id", "left_semi").groupBy(*keys, F.xxhash64("payload").alias("text_hash")).agg(F.first("payload").alias("payload"))
        return full.join(twice, "id", "left_anti").unionByName(few.drop("text_hash"))

    links, link_paths = link_groups(family, texts, lambda sets: near_sets(sets, percent), lambda raw: shingles_of(raw, shingle), BLOCK, "minmax-links")
    twice = sketched.where("set_key is not null").join(ids, "doc_id").join(classes.select("set_key", "rep"), "set_key").select("doc_id", "rep")
    twice = twice.join(twice.groupBy("doc_id").agg(F.min("rep").alias("low")), "doc_id").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    found, found_path = components(links.union(twice), "minmax-found")
    found = found.groupBy("node").agg(F.min("component").alias("component"))
    labelled = classes.select("set_key", "rep").join(found, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("label"))
    whole = sketched.select("doc_id", "n_shingles", "set_key").join(ids, "doc_id", "left").withColumn("set_key", F.coalesce("set_key", "first_key")).drop("first_key")
    out = whole.join(labelled, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    out, at = materialize(out, "minmax-out")
    retire(spark, at)
    discard(spark, *paths, shared_path, *alike_paths, family_path, family_table, *link_paths, found_path)
    return out

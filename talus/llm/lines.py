"""Line deduplication with two Bloom filters.

Every task sketches the distinct line keys of its documents in a once-seen and a twice-seen filter; merged,
the twice-seen filter holds every key of two or more documents. Only lines that pass it are shuffled, counted
exactly, and used to choose what goes."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, discard, materialize, retire, ship, small_enough, spread

_SPACE = b" \t\n\x0b\x0c\r"
#: Filters have 8 bits a key, no fewer than 2**20 bits and no more than 2**27 (16 MB each, however much data
#: there is): a full filter only lets more lines through to the exact count.
MIN_BITS, MAX_BITS, HASHES = 20, 27, 3
#: Filters travel in segments of so many bytes, merged segment by segment.
SEGMENT = 1 << 16


def keys_of(raw: bytes) -> tuple[list[bytes], list[bytes]]:
    lines = raw.split(b"\n")
    return lines, [x.strip(_SPACE).lower() for x in lines]


def _slots(low: np.ndarray, high: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return [((low + np.uint64(i) * (high | np.uint64(1))) & mask).astype(np.int64) for i in range(HASHES)]


def _digests(keys: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_128_digest

    return np.frombuffer(b"".join(map(xxh3_128_digest, keys)), dtype=np.uint64).reshape(-1, 2)


def _has(filt: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    ok = np.ones(len(low), dtype=bool)
    for s in _slots(low, high, bits):
        ok &= (filt[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
    return ok


def _put(filt: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> None:
    for s in _slots(low, high, bits):
        np.bitwise_or.at(filt, s >> 3, np.left_shift(np.uint8(1), (s & 7).astype(np.uint8)))


def _build(bits: int, min_chars: int):
    def run(batches):
        import pyarrow as pa

        once, twice = np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            texts = bytes_of(batch.column(0))
            for at in range(0, len(texts), 512):
                keys = [k for t in texts[at : at + 512] for k in {k for k in keys_of(t)[1] if _long(k, min_chars)}]
                if not keys:
                    continue
                # Within the slice counts are exact; the filters carry what earlier slices held.
                d, n = np.unique(_digests(keys), axis=0, return_counts=True)
                low, high = d[:, 0], d[:, 1]
                again = _has(once, low, high, bits) | (n > 1)
                _put(twice, low[again], high[again], bits)
                _put(once, low, high, bits)
        for kind, filt in ((1, once), (2, twice)):
            parts = filt.reshape(-1, min(SEGMENT, len(filt)))
            live = np.flatnonzero(parts.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(live), kind), pa.int32()), pa.array(live, pa.int32()), pa.array([parts[i].tobytes() for i in live], pa.binary())], names=["kind", "segment", "bits"])

    return run


def _merge(batches):
    """Twice = all twice-seen bits, and those of once-seen filters that two tasks share; rows sorted by segment."""
    import pyarrow as pa

    segment, once, twice = None, None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int32()), pa.array([segment, segment], pa.int32()), pa.array([once.tobytes(), twice.tobytes()], pa.binary())], names=["kind", "segment", "bits"])

    for batch in batches:
        for kind, s, bits in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            x = np.frombuffer(bits, np.uint8)
            if s != segment:
                if segment is not None:
                    yield out()
                segment, once, twice = s, np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8)
            if kind == 1:
                twice |= once & x
                once |= x
            else:
                twice |= x
    if segment is not None:
        yield out()


def _long(key: bytes, min_chars: int) -> bool:
    """At least min_chars code points (UTF-8 continuation bytes don't count)."""
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def repeated_filter(docs: DataFrame, text_col: str, bits: int, min_chars: int) -> np.ndarray:
    """The merged twice-seen filter: 2**bits bits, whatever the input holds."""
    spark = docs.sparkSession
    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_build(bits, min_chars), "kind int, segment int, bits binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge, "kind int, segment int, bits binary")
    merged, at = materialize(merged.where("kind = 2"), "lines-filter")
    filt = np.zeros(1 << (bits - 3), np.uint8)
    step = min(SEGMENT, len(filt))
    for row in merged.toLocalIterator():
        filt[row.segment * step : row.segment * step + step] = np.frombuffer(row.bits, np.uint8)
    discard(spark, at)
    return filt


def _suspects(shared, bits: int, min_chars: int):
    def run(batches):
        import pyarrow as pa

        filt = shared.value
        for batch in batches:
            ids, order, texts = batch.column(0), batch.column(1).to_pylist(), bytes_of(batch.column(2))
            for at in range(0, len(texts), 512):
                held = [{k for k in keys_of(t)[1] if _long(k, min_chars)} for t in texts[at : at + 512]]
                doc = np.repeat(np.arange(len(held)), [len(x) for x in held])
                keys = [k for x in held for k in x]
                if not keys:
                    continue
                d = _digests(keys)
                ok = np.flatnonzero(_has(filt, d[:, 0], d[:, 1], bits))
                yield pa.RecordBatch.from_arrays([pa.array([d[i].tobytes() for i in ok], pa.binary()), ids.slice(at, 512).take(pa.array(doc[ok])), pa.array([order[at + i] for i in doc[ok]], pa.int64())], names=["key", "doc_id", "row"])

    return run


def _drop(known, min_chars: int, keep_first: bool):
    """Rows (doc_id, row, text, keys that go or null); known: all such keys, sorted, or None where rows carry them."""

    def run(batches):
        import pyarrow as pa

        every = None if known is None else known.value
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1).to_pylist()
            texts, own = bytes_of(batch.column(2)), batch.column(3).to_pylist()
            total, gone, left = [], [], []
            for i, raw in enumerate(texts):
                lines, keys = keys_of(raw)
                if every is not None:
                    out = {k for k, d in zip(keys, _digests(keys), strict=True) if (x := every.get(d.tobytes())) is not None and _long(k, min_chars) and x != rows[i]}
                else:
                    mine = set(own[i] or ())
                    out = {k for k, d in zip(keys, _digests(keys), strict=True) if d.tobytes() in mine and _long(k, min_chars)} if mine else set()
                stay, seen = [], set()
                for line, key in zip(lines, keys, strict=True):
                    if key in out or keep_first and key in seen and _long(key, min_chars):
                        continue
                    seen.add(key)
                    stay.append(line)
                total.append(len(lines))
                gone.append(len(lines) - len(stay))
                left.append(b"\n".join(stay).decode())
            yield pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])

    return run


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """Drop the lines whose key at least min_docs documents hold; with keep="first" one occurrence of each stays.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Returns per row doc_id, n_lines,
    n_dropped, kept_text. Null and empty texts are one empty line, which stays as its key has no code points
    (unless min_chars is 0). With keep="first" the kept document is the one of the smallest (id, text hash), nulls
    last, and of several such lines within it the first. Repeated rows are documents of their own; so are rows with
    null ids. Other columns are ignored."""
    spark = docs.sparkSession
    ship(spark)
    first = keep == "first"
    row = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    docs = spread(docs.select(F.col(id_col), F.col(text_col)))
    base = docs.select(F.col(id_col).alias("doc_id"), row.alias("row"), F.col(text_col).cast("string").alias("text"))
    n_chars = docs.agg(F.sum(F.length(F.col(text_col).cast("string")))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(1, n_chars) / 8)), MIN_BITS, MAX_BITS))
    filt = spark.sparkContext.broadcast(repeated_filter(docs, text_col, bits, min_chars))
    suspects = base.mapInArrow(_suspects(filt, bits, min_chars), base.select(F.lit(b"").alias("key"), "doc_id", "row").schema)
    counted = suspects.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")).alias("least")).where(F.col("n") >= min_docs)
    counted, at = materialize(counted.select("key", F.col("least.row").alias("first_row")), "lines-keys")
    n_keys = counted.count()
    schema = base.select("doc_id", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), "text").withColumnRenamed("text", "kept_text").schema
    if small_enough(n_keys, 200):
        keys = {bytes(r.key): (r.first_row if first else -(1 << 63) - 1) for r in counted.toLocalIterator()}
        discard(spark, at)
        return base.withColumn("keys", F.lit(None).cast("array<binary>")).mapInArrow(_drop(spark.sparkContext.broadcast(keys), min_chars, first), schema)
    retire(spark, at)
    own = suspects.join(counted, "key")
    own = own.where("row <> first_row") if first else own
    # Identical rows share their keys: distinct pairs, then one list a row.
    own = own.groupBy("row").agg(F.collect_set("key").alias("keys"))
    return base.join(own, "row", "left").select("doc_id", "row", "text", "keys").mapInArrow(_drop(None, min_chars, first), schema)

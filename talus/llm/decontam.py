"""Benchmark decontamination by latent semantic retrieval.

Benchmark items and document windows are TF-IDF vectors over the benchmark's words, with document frequencies of the
whole corpus. A randomised SVD, whose products with the passage matrix run in Spark tasks, gives a latent space.
Every window of every document is looked up there by cosine; hits are checked by the longest common subsequence of
words, and by whether the item's answer, its last sentence, is there too, which also finds paraphrases."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bytes_of, discard, lean, materialize, retire, ship, small_enough, spread, words_of

#: An item is looked up by windows of the largest of these lengths that it fills, a quarter of a window apart.
WINDOWS = (6, 12, 24, 48)
#: Items are taken in blocks of so many passages, each against all documents. An item of twice the longest window or more
#: is looked up by passages of that length to twice as long; its words in common are still counted over the whole item.
ITEM_BLOCK = 2000
#: The bases of a block's latent spaces have at most so many bytes.
BLOCK_BYTES = 32 << 20
#: Within a block, so many passages share a latent space: of more, its dimensions would keep too little of each.
SPACE_ITEMS = 240
#: A latent space has at most so many dimensions, fitted on all its items and at most so many windows of documents
#: (those whose document's id hash comes first).
RANK, OVERSAMPLE, FIT_DOCS, FIT_WINDOWS = 192, 16, 2000, 8192
#: Least cosine of a window and an item, times the length of what the space keeps of the item.
COSINE = 0.4
#: Share of an item's words that a common subsequence must have; with less than SURE the answer must be there.
COMMON, SURE, ANSWER = 0.7, 0.9, 0.5


@dataclass
class Space:
    """Passages of a latent space: the position of their items in the block, terms and weights, latent vectors and least cosines; local
    has each word's row of the basis, -1 for words of other items."""

    which: np.ndarray
    sizes: np.ndarray
    units: list[tuple[np.ndarray, np.ndarray]]
    local: np.ndarray
    basis: np.ndarray
    latent: np.ndarray
    kept: np.ndarray

    def by_window(self, idf: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each length of window its items, and for each word the most that it adds to a product with one of them."""
        groups: dict[int, list[int]] = {}
        for i, n in enumerate(self.sizes.tolist()):
            groups.setdefault(max((w for w in WINDOWS if w <= n), default=WINDOWS[0]), []).append(i)
        out = {}
        for size, which in groups.items():
            peak = np.zeros(len(idf), dtype=np.float32)
            for i in which:
                t, w = self.units[i]
                peak[t] = np.maximum(peak[t], w * idf[t])
            out[size] = (np.array(which), peak)
        return out


@dataclass
class Block:
    """Items of a block, their words, and latent spaces of their passages."""

    item_ids: list[int]
    items: list[list[bytes]]
    vocabulary: dict[bytes, int]
    idf: np.ndarray
    other_idf: float
    spaces: list[Space]

    def by_window(self) -> list[dict[int, tuple[np.ndarray, np.ndarray]]]:
        return [x.by_window(self.idf) for x in self.spaces]


def answer_of(words: list[bytes]) -> list[bytes]:
    """The last sentence, if what comes before it is a sentence too; else the last quarter."""
    ends = [i for i, w in enumerate(words[:-1]) if w[-1:] in b".?!"]
    at = ends[-1] + 1 if ends else len(words) - max(1, len(words) // 4)
    return words[max(at, len(words) // 2) :]


def common_length(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, with a row of the table in one integer."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = where.get(w, 0)
        if m:
            hit = row & m
            row = (row + hit | row - hit) & full
    return len(a) - bin(row).count("1")


def _frequencies(shared):
    def run(batches):
        import pyarrow as pa

        vocabulary = shared.value
        held = frozenset(vocabulary)
        count, n = np.zeros(len(vocabulary) + 1, np.int64), 0
        for batch in batches:
            for raw in bytes_of(batch.column(0)):
                n += 1
                count[[vocabulary[w] for w in held.intersection(words_of(raw))]] += 1
        count[-1] = n
        live = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int64()), pa.array(count[live], pa.int64())], names=["term", "n"])

    return run


def _windows(size: int):
    """Non-overlapping windows of words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for raw in bytes_of(batch.column(0)):
                words = words_of(raw)
                out += [words[at : at + size] for at in range(0, len(words), size)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary()))], names=["words"])

    return run


def _weighed(shared):
    """TF-IDF rows of windows that hold words of the vocabulary."""

    def run(batches):
        import pyarrow as pa

        vocabulary, idf, other = shared.value
        for batch in batches:
            rows = [_unit(np.array([vocabulary.get(w, -1) for w in words], dtype=np.int64), idf, other) for words in batch.column(0).to_pylist()]
            rows = [(t, w) for t, w in rows if len(t)]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.list_(pa.int64())), pa.array([w for _, w in rows], pa.list_(pa.float64()))], names=["terms", "weights"])

    return run


def _unit(ids: np.ndarray, idf: np.ndarray, other: float) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights of a passage; words outside the vocabulary count in its length."""
    known = ids[ids >= 0]
    terms, tf = np.unique(known, return_counts=True)
    w = tf * idf[terms]
    norm = np.sqrt((w**2).sum() + (len(ids) - len(known)) * other**2)
    return terms, w / norm if norm else w


def _product(shared):
    """The task's part of A^T (A X): one row for each 256 terms."""

    def run(batches):
        import pyarrow as pa

        x, local = shared.value
        out = np.zeros_like(x)
        for batch in batches:
            for t, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t, w = local[np.array(t, np.int64)], np.array(w)
                t, w = t[t >= 0], w[t >= 0]
                out[t] += w[:, None] * (w @ x[t])
        blocks = [(i, out[i * 256 : i * 256 + 256]) for i in range(-(-len(out) // 256))]
        blocks = [(i, b) for i, b in blocks if b.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in blocks], pa.int64()), pa.array([b.tobytes() for _, b in blocks], pa.binary())], names=["block", "part"])

    return run


def _sum_parts(batches):
    import pyarrow as pa

    block, total = None, None
    for batch in batches:
        for b, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(part)
            if b != block:
                if block is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["block", "part"])
                block, total = b, x.copy()
            else:
                total += x
    if block is not None:
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["block", "part"])


def randomised_svd(passages: DataFrame, local: np.ndarray, rank: int, rounds: int = 2) -> np.ndarray:
    """The leading right singular vectors (n_terms x rank) of the sparse passage matrix, for the terms that have a row in
    local.

    Each round multiplies A^T A onto a thin block in Spark tasks and orthonormalises the sum; only that block of
    n_terms x (rank + oversampling) is on the driver."""
    spark = passages.sparkSession
    n_terms = int(local.max()) + 1
    width = min(rank + OVERSAMPLE, n_terms)
    x = np.linalg.qr(np.random.default_rng(7).standard_normal((n_terms, width)))[0]

    def times(x: np.ndarray) -> np.ndarray:
        parts = passages.mapInArrow(lean(_product(spark.sparkContext.broadcast((x, local)))), "block long, part binary")
        out = np.zeros_like(x)
        for r in parts.repartition("block").sortWithinPartitions("block").mapInArrow(lean(_sum_parts), "block long, part binary").toLocalIterator():
            out[r.block * 256 : r.block * 256 + 256] = np.frombuffer(r.part).reshape(-1, x.shape[1])
        return out

    for _ in range(rounds):
        x = np.linalg.qr(times(x))[0]
    small = x.T @ times(x)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-value)[:rank]
    return x @ vector[:, order[value[order] > 1e-9]]


def document_frequencies(texts: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """In how many texts each word is; behind them the number of texts. A row for each word comes to the driver."""
    counts = texts.mapInArrow(lean(_frequencies(texts.sparkSession.sparkContext.broadcast(vocabulary))), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    for r in counts.toLocalIterator():
        df[r.term] = r.n
    return df


def sample_windows(docs: DataFrame, text_col: str, id_hash) -> tuple[DataFrame, list[str]]:
    """At most FIT_WINDOWS windows of words of documents, the same for all blocks of items."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"), id_hash.alias("h")).where("text is not null")
    hashes, hash_path = materialize(texts.select("h").orderBy("h").limit(FIT_DOCS).distinct(), "latent-sample")
    windows, at = materialize(texts.join(F.broadcast(hashes), "h").select("text").mapInArrow(lean(_windows(WINDOWS[-1])), "words array<binary>").limit(FIT_WINDOWS), "latent-windows")
    return windows, [hash_path, at]


def build_block(windows: DataFrame, items: list[tuple[int, list[bytes], list[tuple[int, int]]]], frequency: dict[bytes, int], n_texts: int) -> Block:
    spark: SparkSession = windows.sparkSession
    vocabulary: dict[bytes, int] = {}
    for _, words, _ in items:
        for w in words:
            vocabulary.setdefault(w, len(vocabulary))
    df = np.array([frequency.get(w, 0) for w in vocabulary], dtype=np.int64)
    idf = np.maximum(np.log((n_texts + 1) / (df + 1)), 0.05)
    other = float(np.median(idf))
    sampled, sample_path = materialize(windows.mapInArrow(lean(_weighed(spark.sparkContext.broadcast((vocabulary, idf, other)))), "terms array<long>, weights array<double>"), "latent-weighed")
    held = [(i, words[s:e]) for i, (_, words, spans) in enumerate(items) for s, e in spans]
    units = [_unit(np.array([vocabulary[w] for w in words], dtype=np.int64), idf, other) for _, words in held]
    item, sizes = np.array([i for i, _ in held]), np.array([len(words) for _, words in held])
    spaces = []
    for at in range(0, len(units), SPACE_ITEMS):
        which = np.arange(at, min(at + SPACE_ITEMS, len(units)))
        spaces.append(_space(sampled, item[which], sizes[which], [units[i] for i in which], len(vocabulary)))
    discard(spark, sample_path)
    return Block([i for i, _, _ in items], [w for _, w, _ in items], vocabulary, idf.astype(np.float32), other, spaces)


def _space(sampled: DataFrame, which: np.ndarray, sizes: np.ndarray, units: list[tuple[np.ndarray, np.ndarray]], n_words: int) -> Space:
    spark = sampled.sparkSession
    terms = np.unique(np.concatenate([t for t, _ in units]))
    local = np.full(n_words, -1, dtype=np.int64)
    local[terms] = np.arange(len(terms))
    # Items weigh as much as all windows, so that the space keeps what tells them apart.
    own = spark.createDataFrame([(t.tolist(), (w * 10).tolist()) for t, w in units], "terms array<long>, weights array<double>")
    passages, at = materialize(own.union(sampled).repartition(8), "latent-passages")
    basis = randomised_svd(passages, local, min(RANK, len(terms)))
    discard(spark, at)
    latent = np.array([w @ basis[local[t]] for t, w in units])
    kept = np.maximum(np.linalg.norm(latent, axis=1), 1e-12)
    return Space(which, sizes, units, local, basis.astype(np.float32), (latent / kept[:, None]).astype(np.float32), np.minimum(kept, 1))


def find_items(raw: bytes, block: Block, by_window: list[dict[int, tuple[np.ndarray, np.ndarray]]], cosine: float = COSINE) -> list[tuple[int, float]]:
    """Items (position, share of their words in common) that the text holds."""
    words = words_of(raw)
    n = len(words)
    if not n:
        return []
    get = block.vocabulary.get
    ids = np.fromiter(map(get, words, repeat(-1)), dtype=np.int64, count=n)
    held = ids >= 0
    if not held.any():
        return []
    weight = np.where(held, block.idf[ids], np.float32(block.other_idf))
    energy = np.concatenate([[0], np.cumsum(weight.astype(np.float64) ** 2)])
    hits: dict[int, list[tuple[int, int]]] = {}
    for space, windows in zip(block.spaces, by_window, strict=True):
        rows = np.where(held, space.local[ids], -1)
        known = rows >= 0
        if not known.any():
            continue
        for size, (which, peak) in windows.items():
            start = np.arange(0, max(1, n - size + size // 4), max(1, size // 4))
            end = np.minimum(start + size, n)
            most = np.concatenate([[0], np.cumsum(np.where(known, peak[ids], 0).astype(np.float64))])
            # No item of this length has a larger product with the window, but for what the latent space rounds off.
            good = np.flatnonzero((most[end] - most[start] >= 0.8 * cosine * np.sqrt(energy[end] - energy[start])) & (most[end] > most[start]))
            for at in range(0, len(good), 2048):
                s, e = start[good[at : at + 2048]], end[good[at : at + 2048]]
                row = np.repeat(np.arange(len(s)), e - s)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(e - s) - (e - s), e - s) + np.repeat(s, e - s)
                m = known[pos]
                row, pos = row[m], pos[m]
                first = np.searchsorted(row, np.arange(len(s)))
                vec = np.add.reduceat(space.basis[rows[pos]] * block.idf[ids[pos], None], first, axis=0)
                norm = np.sqrt(energy[e] - energy[s])
                cos = (vec @ space.latent[which].T) / norm[:, None]
                for i, j in zip(*np.nonzero(cos >= cosine * space.kept[which]), strict=True):
                    hits.setdefault(int(space.which[which[j]]), []).append((int(s[i]), int(e[i])))
    out = []
    for item, spans in hits.items():
        got = held_at(words, block.items[item], spans)
        if got is not None:
            out.append((item, got))
    return sorted(out)


def held_at(words: list[bytes], own: list[bytes], spans: list[tuple[int, int]]) -> float | None:
    """The largest share of an item's words in common at any of the spans where the item is held; None if at none."""
    answer = answer_of(own)
    best, done = None, -1
    for s, e in sorted(spans):
        if e <= done:  # within the words that the last span was checked in
            continue
        lo, hi = max(0, s - len(own)), min(len(words), e + len(own))
        done = e + len(own) // 2
        near = words[lo:hi]
        got = common_length(own, near) / len(own)
        if got >= COMMON and (best is None or got > best) and (got >= SURE or common_length(answer, near) >= ANSWER * len(answer)):
            best = got
        if best == 1:
            break
    return best


def _search(shared, text_at: int):
    def run(batches):
        import pyarrow as pa

        block = shared.value
        by_window = block.by_window()
        for batch in batches:
            found = [find_items(raw, block, by_window) for raw in bytes_of(batch.column(text_at))]
            ids = [[block.item_ids[i] for i, _ in x] for x in found]
            best = [max((v for _, v in x), default=0.0) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.float64())], names=[*batch.schema.names, "__talus_items", "__talus_common"])

    return run


def passages_of(n: int) -> list[tuple[int, int]]:
    """Starts and ends of the passages by which an item of n words is looked up."""
    parts = max(1, n // WINDOWS[-1])
    return [(n * i // parts, n * (i + 1) // parts) for i in range(parts)]


def item_blocks(benchmark: DataFrame, item_id: str, item_text: str):
    """Blocks of items with words and passages, in the order of id and text; an item may go on in the next block. A block
    ends before its latent spaces could have more than BLOCK_BYTES."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null").orderBy("i", "t")
    most = BLOCK_BYTES // (4 * RANK)
    block, held, terms = [], 0, 0
    for r in rows.toLocalIterator():
        words = words_of(r.t.encode())
        now: list[tuple[int, int]] = []
        for span in passages_of(len(words)) if words else []:
            if held and (held == ITEM_BLOCK or terms + span[1] - span[0] > most):
                if now:
                    block.append((r.i, words, now))
                yield block
                block, held, terms, now = [], 0, 0, []
            now.append(span)
            held += 1
            terms += span[1] - span[0]
        if now:
            block.append((r.i, words, now))
    if block:
        yield block


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """All columns of docs, __talus_items (ids of the items its text holds, sorted) and __talus_common (the largest
    share of an item's words). With one block of items that is a map over docs; more blocks are looked up one
    after the other, each in a job of its own that keeps hits alone, and the hits are joined to docs."""
    spark = docs.sparkSession
    ship(spark)
    blocks = item_blocks(benchmark, item_id, item_text)
    block, following = next(blocks, None), None
    empty = docs.select("*", F.array().cast("array<bigint>").alias("__talus_items"), F.lit(0.0).alias("__talus_common"))
    if block is None:
        return empty
    texts = spread(docs.select(F.col(text_col).cast("string").alias("text")))
    windows, paths = sample_windows(docs, text_col, F.xxhash64(F.col(id_col).cast("string")))
    every = vocabulary_of(benchmark, item_text)
    known: dict[bytes, int] = {}
    if every is not None:
        df = document_frequencies(texts, every)
        known, n_texts = dict(zip(every, df[:-1].tolist(), strict=True)), int(df[-1])
    hits, key = [], F.xxhash64(F.col(text_col).cast("string"))
    while block is not None:
        if every is None:
            own = {w: None for _, words, _ in block for w in words}
            own = {w: i for i, w in enumerate(own)}
            df = document_frequencies(texts, own)
            known, n_texts = dict(zip(own, df[:-1].tolist(), strict=True)), int(df[-1])
        built = spark.sparkContext.broadcast(build_block(windows, block, known, n_texts))
        following = next(blocks, None)
        if following is None and not hits:
            discard(spark, *paths)
            return spread(docs).mapInArrow(lean(_search(built, docs.columns.index(text_col))), empty.schema)
        keyed = docs.select(key.alias("__talus_row"), F.col(text_col).cast("string").alias("__talus_text"))
        found = spread(keyed).mapInArrow(lean(_search(built, 1)), keyed.select("*", F.array().cast("array<bigint>").alias("__talus_items"), F.lit(0.0).alias("__talus_common")).schema)
        found, at = materialize(found.where(F.size("__talus_items") > 0).select("__talus_row", "__talus_items", "__talus_common"), "decontam-hits")
        built.destroy()
        hits.append(found)
        paths.append(at)
        block = following
    total = hits[0]
    for x in hits[1:]:
        total = total.union(x)
    total = total.groupBy("__talus_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("__talus_items")))).alias("__talus_items"), F.max("__talus_common").alias("__talus_common"))
    total, at = materialize(total, "decontam-marks")
    retire(spark, at)
    discard(spark, *paths)
    side = F.broadcast(total) if small_enough(total.count(), 200) else total
    joined = docs.withColumn("__talus_row", key).join(side, "__talus_row", "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce("__talus_items", F.array().cast("array<bigint>")).alias("__talus_items"), F.coalesce("__talus_common", F.lit(0.0)).alias("__talus_common"))


def vocabulary_of(benchmark: DataFrame, item_text: str) -> dict[bytes, int] | None:
    """The distinct words of all items, for one pass over the documents; None if they are too many to hold at once."""
    words = benchmark.select(F.explode(F.split(F.lower(F.col(item_text).cast("string")), r"[\x20\x09-\x0D]+")).alias("w"))
    n, size = words.distinct().agg(F.count(F.lit(1)), F.sum(F.octet_length("w"))).first()
    if n * 100 + (size or 0) > BROADCAST_BYTES:
        return None
    out: dict[bytes, int] = {}
    for r in benchmark.select(F.col(item_text).cast("string").alias("t")).where("t is not null").toLocalIterator():
        for w in words_of(r.t.encode()):
            out.setdefault(w, len(out))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, contaminated, item_ids, common of every row.

    Null and empty texts hold nothing; items without words are no items; an item in several rows is found under each
    id. Repeated rows are rows like others; null ids too. Other columns are ignored. Without items nothing is
    contaminated; without documents the result is empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = mark_contaminated(rows, benchmark, "doc_id", "text", item_id, item_text)
    return out.select("doc_id", (F.size("__talus_items") > 0).alias("contaminated"), F.col("__talus_items").alias("item_ids"), F.col("__talus_common").alias("common"))

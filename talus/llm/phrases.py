"""Phrase collocations by stripes.

A stripe belongs to one prefix and counts the words that follow it. Tasks build the stripes of their documents, and stripes of equal
prefix are merged elementwise. The merged ones hold each prefix's extensions; the totals of prefixes, as entries of the stripe of the
prefix one word shorter, down to the empty prefix, whose stripe also counts the words that aren't frequent, as its rest, and so all
words; and in the largest entry of a stripe, and among entries of equal rest, what subsumes a phrase from the right and the left.

Which phrases a stripe needs is found first, one length after another: no phrase is more frequent than its parts of one word
less, so only phrases both of whose parts may be frequent are counted, by hashes of 48 bits. Those that reach the threshold make a
Bloom filter of fixed size. These hashes and filters only let more through: stripes decide, whose entries a task tells apart by 64 bits and
which are merged by their words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, discard, materialize, mix64, retire, ship, spread
from .lines import SEGMENT, _put, _slots  # the Bloom filter of line deduplication

#: Filters have 16 bits a phrase, no fewer than 2**16 bits and no more than 2**27: 16 MB, however many phrases there are.
MIN_BITS, MAX_BITS = 16, 27
#: Stripes of prefixes with this share of all words are dealt to so many slices by the word that follows, so that no task merges all that
#: follows a usual word; there are no more than 1 / HOT such prefixes of one length. The empty prefix, which every word follows, has more.
HOT, SLICES, FIRST_SLICES = 1 / 1024, 64, 1024
#: Bytes of text looked at together, cut where a piece ends; stripe entries and hashes that a task holds before it sends them on.
WINDOW, HELD, HASHES_HELD = 1 << 20, 1 << 19, 1 << 22
#: Bits of a phrase's hash while lengths are counted.
HASH_BITS = 48
BREAK = 255  # no byte of UTF-8
_TABLE = bytes(BREAK if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT[0])
_BASE, _INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """1, base, base**2 and so on; kept by the process, as windows have the same size but for a longer piece."""
    key = str(base)
    if len(_powers.get(key, ())) < n + 1:
        _powers[key] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, WINDOW) + 1, base, dtype=np.uint64), dtype=np.uint64)])
    return _powers[key]


class Words:
    """The words of a window: where they are, the piece that each is in, and sums that hash phrases."""

    def __init__(self, raw: bytes, lang: bytes):
        from xxhash import xxh3_64_intdigest

        self.raw = raw
        data = np.frombuffer(raw, dtype=np.uint8)
        ends = data == BREAK
        inside = np.concatenate([[False], ~(ends | (data == 32)), [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.stops = edges[::2], edges[1::2]
        self.piece = np.cumsum(ends, dtype=np.int32)[self.starts] if len(edges) else np.zeros(0, np.int32)
        n = len(data)
        upto = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * _powers_of(_BASE, n)[:n], dtype=np.uint64)])
        h = mix64((upto[self.stops] - upto[self.starts]) * _powers_of(_INVERSE, n)[self.starts] + (self.stops - self.starts).astype(np.uint64))
        self.lang = np.uint64(xxh3_64_intdigest(lang, 7))
        self.h = h

    def __len__(self) -> int:
        return len(self.starts)

    def whole(self, k: int) -> np.ndarray:
        """Places where a phrase of k words begins."""
        n = len(self) - k + 1
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def hashes(self, k: int, at: np.ndarray) -> np.ndarray:
        return self.digests(k, at) >> np.uint64(64 - HASH_BITS)

    def digests(self, k: int, at: np.ndarray) -> np.ndarray:
        total = np.zeros(len(at), dtype=np.uint64)
        for j in range(k):
            total += mix64(self.h[at + j] + np.uint64(j)) * _MULT[j % len(_MULT)] + np.uint64(j // len(_MULT))
        return mix64(total ^ self.lang + np.uint64(k))

    def phrase(self, at: int, k: int) -> bytes:
        if k == 1:
            return self.raw[self.starts[at] : self.stops[at]]
        return b" ".join(self.raw[self.starts[i] : self.stops[i]] for i in range(at, at + k))


def _may_hold(filt: tuple[np.ndarray, int], hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter holds, one of its hashes after another on what is left."""
    bits = filt[1]
    left = np.arange(len(hashes))
    low = mix64(hashes)
    for i, slot in enumerate(_slots(low, mix64(low + _MULT[1]), bits)):
        slot = slot[left] if i else slot
        left = left[(filt[0][slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
    return left


def _windows(batches):
    """(lang, translated text) of the rows of each language, cut where pieces end."""
    for batch in batches:
        held: dict[bytes, list[bytes]] = {}
        size = 0
        for lang, text in zip(bytes_of(batch.column(0)), bytes_of(batch.column(1)), strict=True):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= WINDOW:
                yield from _cut(held)
                held, size = {}, 0
        yield from _cut(held)


def _cut(held: dict[bytes, list[bytes]]):
    for lang, texts in held.items():
        raw = b"\n".join(texts).translate(_TABLE)
        at = 0
        while at < len(raw):
            to = len(raw) if len(raw) - at <= 2 * WINDOW else raw.rfind(b"\xff", at, at + WINDOW) + 1 or raw.find(b"\xff", at + WINDOW) + 1 or len(raw)
            yield lang, raw[at:to]
            at = to


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, how often each occurs, and the place where it occurs first."""
    import pandas as pd

    codes, distinct = pd.factorize(values)
    first = np.empty(len(distinct), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(values) - 1, -1, -1)
    return distinct, np.bincount(codes, minlength=len(distinct)), first


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and the sums of their counts."""
    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c[order], first) if len(first) else c


def _live(words: Words, k: int, filters: list) -> np.ndarray:
    """Places of phrases of k words both of whose parts of k - 1 words may be frequent."""
    at = words.whole(k)
    if k == 1 or not len(at):
        return at
    before = words.whole(k - 1)
    may = np.zeros(len(words) + 1, dtype=bool)
    may[before[_may_hold(filters[k - 2], words.hashes(k - 1, before))]] = True
    return at[may[at] & may[at + 1]]


def _count(k: int, shared: list, buckets: int):
    """(lang, text) to the hashes of phrases of k words: a row for each bucket, hashes in 6 bytes, counts in 4."""

    def run(batches):
        import pyarrow as pa

        filters = [x.value for x in shared]
        shift = np.uint64(HASH_BITS - buckets.bit_length() + 1)

        def sent(h, c):
            c = np.minimum(c, 2**32 - 1).astype(np.uint32)
            cut = np.searchsorted(h >> shift, np.arange(buckets + 1))
            live = np.flatnonzero(np.diff(cut))
            blob = lambda x: pa.array([x[cut[b] : cut[b + 1]].tobytes() for b in live], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), blob(np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6])), blob(c)], names=["bucket", "hashes", "counts"])

        hashes, counts, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for lang, raw in _windows(batches):
            words = Words(raw, lang)
            at = _live(words, k, filters)
            if not len(at):
                continue
            h, c, _ = _counted(words.hashes(k, at))
            hashes.append(h)
            counts.append(c)
            size += len(h)
            if size > HASHES_HELD // 4:
                h, c = _summed(hashes, counts)
                hashes, counts, size = [h], [c], 0
                if len(h) > HASHES_HELD // 2:
                    yield sent(h, c)
                    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        h, c = _summed(hashes, counts)
        if len(h):
            yield sent(h, c)

    return run


def _reached(least: int):
    """Rows sorted by bucket to the hashes whose counts reach `least`, and the counts."""

    def run(batches):
        import pyarrow as pa

        bucket, hashes, counts = None, [], []

        def done():
            h, c = _summed(hashes, counts)
            yes = c >= least
            return pa.RecordBatch.from_arrays([pa.array(h[yes].view(np.int64), pa.int64()), pa.array(c[yes], pa.int64())], names=["hash", "n"])

        for batch in batches:
            for b, h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if b != bucket:
                    if bucket is not None:
                        yield done()
                    bucket, hashes, counts = b, [], []
                wide = np.zeros((len(h) // 6, 8), dtype=np.uint8)
                wide[:, :6] = np.frombuffer(h, dtype=np.uint8).reshape(-1, 6)
                hashes.append(wide.view(np.uint64).ravel())
                counts.append(np.frombuffer(c, dtype=np.uint32).astype(np.int64))
        if bucket is not None:
            yield done()

    return run


def frequent(docs: DataFrame, k: int, least: int, shared: list, buckets: int) -> tuple[DataFrame, str]:
    """docs: lang, text. Hashes, and counts, of phrases of k words that occur `least` times or more, and of a few others at worst."""
    rows = docs.mapInArrow(_count(k, shared, buckets), "bucket int, hashes binary, counts binary")
    return materialize(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_reached(least), "hash long, n long"), f"phrases-{k}")


def _bits_of(bits: int):
    """Hashes to the segments of a Bloom filter."""

    def run(batches):
        import pyarrow as pa

        filt = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            low = mix64(batch.column(0).to_numpy().view(np.uint64))
            _put(filt, low, mix64(low + _MULT[1]), bits)
        parts = filt.reshape(-1, min(SEGMENT, len(filt)))
        live = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([parts[i].tobytes() for i in live], pa.binary())], names=["segment", "bits"])

    return run


def _either(batches):
    """Segments sorted by number, merged by or."""
    import pyarrow as pa

    segment, held = None, None
    for batch in batches:
        for s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(raw, np.uint8)
            if s != segment:
                if segment is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["segment", "bits"])
                segment, held = s, x.copy()
            else:
                held |= x
    if segment is not None:
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["segment", "bits"])


def hash_filter(hashes: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of n hashes: 2**bits bits, bounded whatever n is."""
    bits = int(np.clip(np.ceil(np.log2(max(1, n) * 16)), MIN_BITS, MAX_BITS))
    parts = hashes.select("hash").mapInArrow(_bits_of(bits), "segment int, bits binary")
    merged, at = materialize(parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_either, "segment int, bits binary"), "phrases-filter")
    filt = np.zeros(1 << (bits - 3), np.uint8)
    step = min(SEGMENT, len(filt))
    for row in merged.toLocalIterator():
        filt[row.segment * step : row.segment * step + step] = np.frombuffer(row.bits, np.uint8)
    discard(hashes.sparkSession, at)
    return filt, bits


class _Tally:
    """Counts of (lang, prefix, slices, word) by 64-bit digest, word None for the rest: texts are made when a digest is new."""

    def __init__(self):
        self.digests, self.counts, self.order, self.keys = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def add(self, digests: np.ndarray, counts: np.ndarray, keys) -> None:
        """Distinct digests; keys(i) is the key of the i-th."""
        at = np.searchsorted(self.digests, digests)
        known = np.zeros(len(digests), dtype=bool)
        inside = at < len(self.digests)
        known[inside] = self.digests[at[inside]] == digests[inside]
        self.counts[at[known]] += counts[known]
        new = np.flatnonzero(~known)
        if len(new):
            order = np.concatenate([self.order, np.arange(len(self.keys), len(self.keys) + len(new))])
            self.keys += [keys(i) for i in new.tolist()]
            self.digests, self.counts = np.concatenate([self.digests, digests[new]]), np.concatenate([self.counts, counts[new]])
            sort = np.argsort(self.digests, kind="stable")
            self.digests, self.counts, self.order = self.digests[sort], self.counts[sort], order[sort]

    def stripes(self):
        """Batches of stripes of all that was counted; empty afterwards."""
        from xxhash import xxh3_64_intdigest

        held: dict[tuple[bytes, bytes, int], list] = {}
        for i, n in zip(self.order.tolist(), self.counts.tolist(), strict=True):
            lang, prefix, slices, word = self.keys[i]
            slot = 0 if word is None or slices == 1 else xxh3_64_intdigest(word, 5) % slices
            one = held.setdefault((lang, prefix, slot), [0, {}])
            if word is None:
                one[0] += n
            else:
                one[1][word] = one[1].get(word, 0) + n
        self.__init__()
        yield from _sent(held)


def _sent(held: dict[tuple[bytes, bytes, int], list]):
    """Stripes (lang, prefix, slice) -> [rest, {word: count}] as batches."""
    import pyarrow as pa

    items = list(held.items())
    text = lambda values: pa.array(values, pa.binary()).cast(pa.string())
    for at in range(0, len(items), 4096):
        part = items[at : at + 4096]
        offsets = pa.array(np.cumsum([0, *(len(c) for _, (_, c) in part)]), pa.int32())
        words = pa.ListArray.from_arrays(offsets, text([w for _, (_, c) in part for w in c]))
        counts = pa.ListArray.from_arrays(offsets, pa.array([n for _, (_, c) in part for n in c.values()], pa.int64()))
        yield pa.RecordBatch.from_arrays([text([k[0] for k, _ in part]), text([k[1] for k, _ in part]), pa.array([k[2] for k, _ in part], pa.int32()), pa.array([r for _, (r, _) in part], pa.int64()), words, counts], names=["lang", "prefix", "slot", "rest", "words", "counts"])


STRIPES = "lang string, prefix string, slot int, rest long, words array<string>, counts array<long>"


def add_stripes(words: Words, lang: bytes, filters: list, hot: list[np.ndarray], out: _Tally) -> None:
    """Count the entries of all frequent prefixes, from the empty one on, for as many lengths as there are filters; hot[k]: sorted
    hashes of the hot prefixes of k words."""
    prefixes = np.arange(len(words))  # where a frequent phrase of k - 1 words begins
    for k, filt in enumerate(filters, 1):
        fits = np.zeros(len(words), dtype=bool)
        fits[words.whole(k)] = True
        at = prefixes[fits[prefixes]]
        going = at[_may_hold(filt, words.hashes(k, at))]
        digests, counts, first = _counted(words.digests(k, going))
        place = going[first]
        if k == 1:
            out.add(digests, counts, lambda i, place=place: (lang, b"", FIRST_SLICES, words.phrase(place[i], 1)))
            out.add(np.array([words.lang]), np.array([len(words) - len(going)]), lambda i: (lang, b"", FIRST_SLICES, None))
        else:
            usual = np.isin(words.hashes(k - 1, place), hot[k - 1])
            out.add(digests, counts, lambda i, k=k, place=place, usual=usual: (lang, words.phrase(place[i], k - 1), SLICES if usual[i] else 1, words.phrase(place[i] + k - 1, 1)))
        prefixes = going


def _build(shared: list, hot: list[np.ndarray]):
    def run(batches):
        filters, out = [x.value for x in shared], _Tally()
        for lang, raw in _windows(batches):
            add_stripes(Words(raw, lang), lang, filters, hot, out)
            if len(out.keys) > HELD:
                yield from out.stripes()
        yield from out.stripes()

    return run


def _merge(least: int):
    """Stripes sorted by lang, prefix and slice, merged elementwise; entries below `least` go to rest."""

    def run(batches):
        held, size, key, rest, counts = {}, 0, None, 0, {}

        def done() -> int:
            kept = {word: n for word, n in counts.items() if n >= least}
            held[key] = [rest + sum(counts.values()) - sum(kept.values()), kept]
            return len(kept) + 1

        for batch in batches:
            columns = [bytes_of(batch.column(i)) if i < 2 else batch.column(i).to_pylist() for i in range(6)]
            for lang, prefix, slot, more, words, numbers in zip(*columns, strict=True):
                if (lang, prefix, slot) != key:
                    if key is not None:
                        size += done()
                        if size > 4096:
                            yield from _sent(held)
                            held, size = {}, 0
                    key, rest, counts = (lang, prefix, slot), 0, {}
                rest += more
                for word, n in zip(words, numbers, strict=True):
                    word = word.encode()
                    counts[word] = counts.get(word, 0) + n
        if key is not None:
            done()
        yield from _sent(held)

    return run


def stripes(docs: DataFrame, least: int, shared: list, hot: list[np.ndarray]) -> tuple[DataFrame, str]:
    """docs: lang, text. Merged stripes with the entries of `least` or more, written and read again."""
    built = docs.mapInArrow(_build(shared, hot), STRIPES)
    return materialize(built.repartition("lang", "prefix", "slot").sortWithinPartitions("lang", "prefix", "slot").mapInArrow(_merge(least), STRIPES), "phrases-stripes")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, max_words: int = 5, subsumed_percent: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to max_words words.

    A-Z are lower-cased, texts split at .,;:!? and line ends into pieces, and those at blanks and tabs into words; phrases are contiguous
    in a piece. n counts the language's words, a the phrase. Of the cuts of a phrase into a first part and a rest (l and r, their counts)
    the one of least score counts, the shortest first part among equals; score is floor(1000 * a * n / (l * r)), exactly. Phrases of a >=
    least are candidates; one inside a longer candidate of at least subsumed_percent of its count goes. Order: score and a descending, phrase
    ascending by bytes. Null languages are `und`; null and empty texts have no words; repeated rows and null ids count as rows; other
    columns are ignored; an empty table gives an empty result."""
    spark = docs.sparkSession
    ship(spark)
    base = spread(docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))).where("text <> ''")
    buckets = int(np.clip(1 << (2 * base.rdd.getNumPartitions() - 1).bit_length(), 64, 1 << 16))
    paths, shared, hot, words = [], [], [np.zeros(0, np.uint64)], 0
    for k in range(1, max_words + 1):
        hashes, at = frequent(base, k, least, shared, buckets)
        paths.append(at)
        n, occurrences = hashes.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n:
            break
        words = words or occurrences
        top_hashes = hashes.where(F.col("n") >= HOT * words).orderBy(F.desc("n")).limit(4096).collect()
        hot.append(np.sort(np.array([r.hash for r in top_hashes], dtype=np.int64).view(np.uint64)))
        shared.append(spark.sparkContext.broadcast(hash_filter(hashes, n)))
    table, at = stripes(base, least, shared, hot) if shared else (spark.createDataFrame([], STRIPES), None)
    out, done = materialize(_ranked(table, subsumed_percent, top), "phrases-out")
    discard(spark, *paths, *([at] if at else []))
    retire(spark, done)
    return out


def _ranked(table: DataFrame, subsumed_percent: int, top: int) -> DataFrame:
    """From the merged stripes to each language's first phrases."""
    total = F.col("rest") + F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    totals = table.where("prefix = ''").groupBy("lang").agg(F.sum(total).alias("n"))
    entries = table.select("lang", "prefix", F.explode(F.arrays_zip("words", "counts")).alias("e"))
    phrase = F.when(F.col("prefix") == "", F.col("e.words")).otherwise(F.concat_ws(" ", "prefix", "e.words"))
    known = entries.select("lang", phrase.alias("phrase"), F.col("e.counts").alias("f")).withColumn("words", F.size(F.split("phrase", " ")))
    cands = known.where("words >= 2")
    # What subsumes a phrase does so through a neighbour of one word more, for no phrase is more frequent than its parts: the largest
    # entry of the phrase's stripe is its extension to the right, the largest among entries of equal rest that to the left.
    right = table.where((F.size("counts") > 0) & F.col("prefix").contains(" ")).groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max(F.array_max("counts")).alias("most"))
    left = cands.where("words >= 3").select("lang", F.substring_index("phrase", " ", 1).alias("head"), "phrase", "f").groupBy("lang", F.expr("substring(phrase, length(head) + 2)").alias("phrase")).agg(F.max("f").alias("most"))
    longer = right.union(left).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    cands = cands.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < subsumed_percent * F.col("f"))).drop("most")
    words = F.split("phrase", " ")
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda i: F.struct(i.alias("k"), F.array_join(F.slice(words, F.lit(1), i), " ").alias("first"), F.array_join(F.slice(words, i + 1, F.col("words") - i), " ").alias("rest")))).alias("c")
    cuts = cands.select("lang", "phrase", F.col("f").alias("a"), cut).select("lang", "phrase", "a", "c.*")
    part = known.select("lang", "phrase", "f")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within slices of a language, so that no task sorts all of a language's phrases.
    slot = F.pmod(F.xxhash64("phrase"), F.lit(32))
    near = best.withColumn("slot", slot).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slot").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "slot")
    final = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return final.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split(translate(translate(coalesce(text, ''), '.,;:!?' || chr(11) || chr(12) || chr(13), repeat(chr(10), 9)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9), 'abcdefghijklmnopqrstuvwxyz '), chr(10))) AS p FROM documents),
worded AS (SELECT lang, list_filter(string_split(p, ' '), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM worded GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM worded, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
f AS MATERIALIZED (SELECT lang, k, g, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL),
c AS MATERIALIZED (SELECT * FROM f WHERE k >= 2 AND f >= 100),
inner_ AS MATERIALIZED (SELECT q.lang, array_to_string(string_split(q.g, ' ')[i:j], ' ') AS g, max(q.f) AS most FROM c q, unnest([1, 2, 3, 4]) AS a(i), unnest([2, 3, 4, 5]) AS b(j) WHERE j > i AND j <= q.k AND j - i + 1 < q.k GROUP BY ALL),
stay AS MATERIALIZED (SELECT c.* FROM c LEFT JOIN inner_ x ON x.lang = c.lang AND x.g = c.g WHERE x.g IS NULL OR 100 * x.most < 100 * c.f),
parts AS MATERIALIZED (SELECT s.lang, s.g, s.f AS a, i, array_to_string(string_split(s.g, ' ')[1:i], ' ') AS p, array_to_string(string_split(s.g, ' ')[i + 1:s.k], ' ') AS q FROM stay s, unnest([1, 2, 3, 4]) AS t(i) WHERE i < s.k),
cuts AS (SELECT s.lang, s.g, s.a, s.i, l.f AS l, r.f AS r, n.n, (1000 * s.a * n.n) // (l.f * r.f) AS score FROM parts s JOIN sizes n ON n.lang = s.lang JOIN f l ON l.lang = s.lang AND l.g = s.p JOIN f r ON r.lang = s.lang AND r.g = s.q),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, i) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= 2000
"""

"""Token ids in binary shards.

Documents are range-sorted by id; each task tokenizes its range and writes shards in which ids are replaced by
their rank of frequency and coded in one to four bytes each, the lengths apart in control bytes of two bits a
value. Reading looks lengths up in a table of 256 control bytes and gathers values with numpy.

Shard layout, little-endian: magic; n_docs, n_ranks uint32; n_tokens, n_data uint64; ids by rank uint32[n_ranks];
doc ids int64[n_docs]; null ids uint8[n_docs]; lengths uint64[n_docs]; control uint8[ceil(n_tokens / 4)]; data."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HELD, bytes_of, discard, fresh_path, lean, materialize, retire, ship

MAGIC = b"TALUSVB1"
#: A shard is closed at the end of the document that reaches this many tokens.
SHARD_TOKENS = 1 << 20
_STEP = 1 << 20
#: Texts are encoded in one call until they reach so many bytes.
TOGETHER = 1 << 20
#: Distinct words that a worker remembers the ids of.
REMEMBERED = 300_000
_TABLE = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + np.uint8(1)


def encode_values(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of uint32 values."""
    control, data = [], []
    for at in range(0, len(ranks), _STEP):
        r = ranks[at : at + _STEP]
        size = 1 + (r > 0xFF).astype(np.int64) + (r > 0xFFFF) + (r > 0xFFFFFF)
        end = np.cumsum(size)
        off = end - size
        out = np.empty(int(end[-1]), dtype=np.uint8)
        out[off] = r & np.uint32(0xFF)
        for j in (1, 2, 3):
            m = np.flatnonzero(size > j)
            if not len(m):
                break
            out[off[m] + j] = (r[m] >> np.uint32(8 * j)) & np.uint32(0xFF)
        code = np.zeros(-(-len(r) // 4) * 4, dtype=np.uint8)
        code[: len(r)] = size - 1
        code = code.reshape(-1, 4)
        control.append((code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6).astype(np.uint8).tobytes())
        data.append(out.tobytes())
    return b"".join(control), b"".join(data)


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint32)
    start = 0
    for at in range(0, n, _STEP):
        k = min(_STEP, n - at)
        size = _TABLE[control[at // 4 : (at + k + 3) // 4]].reshape(-1)[:k]
        end = np.cumsum(size, dtype=np.int64)
        off = end - size + start
        v = data[off].astype(np.uint32)
        for j in (1, 2, 3):
            m = np.flatnonzero(size > j)
            if not len(m):
                break
            v[m] |= data[off[m] + j].astype(np.uint32) << np.uint32(8 * j)
        out[at : at + k] = v
        start += int(end[-1]) if k else 0
    return out


def pack_shard(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    by_rank = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())].astype(np.uint32)
    rank = np.zeros(len(counts), dtype=np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    control, data = encode_values(rank[ids]) if len(ids) else (b"", b"")
    absent = np.array([x is None for x in doc_ids], dtype=np.uint8)
    return b"".join([MAGIC, struct.pack("<IIQQ", len(doc_ids), len(by_rank), len(ids), len(data)), by_rank.tobytes(), np.array([x or 0 for x in doc_ids], dtype=np.int64).tobytes(), absent.tobytes(), lengths.astype(np.uint64).tobytes(), control, data])


def unpack_shard(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Doc ids, lengths and the ids of all documents."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token shard")
    n_docs, n_ranks, n_tokens, n_data = struct.unpack_from("<IIQQ", raw, 8)
    at = 8 + struct.calcsize("<IIQQ")

    def take(kind, n):
        nonlocal at
        x = np.frombuffer(raw, dtype=kind, count=n, offset=at)
        at += x.nbytes
        return x

    by_rank, doc_ids, absent, lengths = take("<u4", n_ranks), take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    control, data = take("u1", -(-n_tokens // 4)), take("u1", n_data)
    ranks = decode_values(control, data, n_tokens)
    return [None if a else int(d) for d, a in zip(doc_ids, absent, strict=True)], lengths.astype(np.int64), by_rank[ranks] if n_tokens else ranks


def _pick(start: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Lists of flat, each from its start on, one after another."""
    end = np.cumsum(size)
    return flat[np.repeat(start - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)]


class _Table:
    """Growing lists of ids, one list after another in one array, and how often each was asked for."""

    def __init__(self):
        self.start, self.size, self.hits = (np.zeros(1 << 14, np.int64) for _ in range(3))
        self.flat = np.zeros(1 << 16, np.uint32)
        self.n = self.used = 0

    def add(self, sizes: np.ndarray, flat: np.ndarray) -> None:
        while self.n + len(sizes) > len(self.start):
            self.start, self.size, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.hits))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.start[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + len(sizes)] = sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.n += len(sizes)
        self.used += len(flat)

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[which]
        return size, _pick(self.start[which], size, self.flat)


def _strings(column) -> list[bytes]:
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


class WordIds:
    """Token ids of texts by their words between ASCII white space.

    The tokenizer drops white space and never joins what it parts, so a text's ids are those of its words in a row.
    It also parts a letter from plain punctuation behind it and lower-cases, so a word is a stem in lower case and its
    tail; a stem of Latin letters goes to the library's model as it is, for normalizing and parting leave it alone. The
    words asked for most are remembered, stems and tails among them, and of the texts of one call each distinct word is
    looked up once. Whether all that holds for a vocabulary is tried on probes first; stems go through the whole
    tokenizer, or texts as they are, where it doesn't."""

    TAIL = b".,;:!?#$%&*"
    PROBES = (
        "It's ΩΜΈΓΑΣ. don't, (a). x). 12.5% Å. ÉCOLE, Éa e\u0301. ½. x². 's. #$ ... a.b Hello, WORLD!! no-one re:do $5.00 x\xa0y İ, ẞ. ﬁ. \x1cabc\x1f",
        "Hello, WORLD!! It'S DON'T A.B (X). ÉCOLE, ŒUVRE. AǅB Ǆ. Ēa İX, 12ªB Straße. NO-ONE \x1cABC\x1f",
    )
    LETTERS = [*"abcdefghijklmnopqrstuvwxyzªµºßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "the", "s", "re", "straße", "ungewöhnlich", "señor", "anthropologists", "zzqxj", "élèveª", "ndthwhere"]
    #: What goes to the model as it is: letters of Latin-1 in lower case.
    LATIN = "^[a-zªµºß-öø-ÿ]+$"
    #: All bytes of code points below U+0300: without combining marks A-Z may be lower-cased before composition too.
    PLAIN = bytes(range(0xCC))

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words, self.word_ids = {}, _Table()
        letters = [x.encode() for x in self.LETTERS]
        sizes, flat = self._by_letters(letters)
        whole = self._whole(letters)
        self.by_letters = sizes.tolist() == [len(x) for x in whole] and flat.tolist() == np.concatenate(whole).tolist()
        self.by_word = True
        self.by_word = all(self.encode([x.encode()])[0].tolist() == self._whole([x.encode()])[0].tolist() for x in self.PROBES)

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _by_letters(self, stems: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of stems of letters, many in one call."""
        sizes, flat = [], []
        for at in range(0, len(stems), 512):
            some = stems[at : at + 512]
            e = self.letters.encode(b" ".join(some).decode(), add_special_tokens=False)
            sizes.append(np.bincount(np.array(e.word_ids, dtype=np.int64), minlength=len(some)))
            flat.append(np.array(e.ids, dtype=np.uint32))
        return (np.concatenate(sizes), np.concatenate(flat)) if stems else (np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _parts(self, word: bytes) -> tuple[bytes, bytes]:
        if word.isalpha():
            return word.lower(), b""
        stem = word.rstrip(self.TAIL)
        if stem.isascii():
            if stem and not stem[-1:].isalnum():
                return word, b""
            return stem.lower(), word[len(stem) :]
        text = stem.decode()
        # Beyond Latin-1, lower case or composition may end a letter in a mark that punctuation would join.
        if not text[-1].isalpha() or text[-1] > "\xff":
            return word, b""
        return (text.lower().encode() if max(text) < "\u0100" else stem), word[len(stem) :]

    def _remember(self, words: list[bytes], sizes: np.ndarray, flat: np.ndarray) -> None:
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words)), strict=True))
        self.word_ids.add(sizes, flat)

    def _places(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words; -1 where one isn't remembered."""
        return np.fromiter(map(self.words.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def _learn(self, new: list[bytes]) -> None:
        """Stems and tails are words too: those already remembered don't go to the library again, whatever tail they had."""
        import pyarrow as pa
        import pyarrow.compute as pc

        coded = pa.array(list(chain.from_iterable(map(self._parts, new))), pa.large_string()).dictionary_encode()
        pieces = _strings(coded.dictionary)
        lacking = self._places(pieces) < 0
        plain = pc.match_substring_regex(coded.dictionary, self.LATIN).to_numpy(zero_copy_only=False) & self.by_letters
        some = [pieces[i] for i in np.flatnonzero(lacking & plain)]
        self._remember(some, *self._by_letters(some))
        some = [pieces[i] for i in np.flatnonzero(lacking & ~plain)]
        whole = self._whole(some)
        self._remember(some, np.fromiter(map(len, whole), dtype=np.int64, count=len(whole)), np.concatenate([np.zeros(0, np.uint32), *whole]))
        pairs = self._places(pieces)[coded.indices.to_numpy()].reshape(-1, 2)
        n = self.word_ids.n
        self.word_ids.hits[:n] += np.bincount(pairs.reshape(-1), minlength=n)
        made = np.flatnonzero(self._places(new) < 0)
        sizes, flat = self.word_ids.gather(pairs[made].reshape(-1))
        self._remember([new[i] for i in made], sizes.reshape(-1, 2).sum(axis=1), flat)

    def _forget(self) -> None:
        """Keep the words asked for most, half as many as may be remembered; their counts are halved."""
        hits = self.word_ids.hits[: self.word_ids.n]
        at = len(hits) - 1 - REMEMBERED // 2
        kept = np.flatnonzero(hits > max(1, int(np.partition(hits, at)[at])))
        keys, old = list(self.words), self.word_ids
        self.words, self.word_ids = {keys[k]: i for i, k in enumerate(kept)}, _Table()
        self.word_ids.add(*old.gather(kept))
        self.word_ids.hits[: len(kept)] = hits[kept] // 2

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.by_word:
            return self._whole(texts)
        if len(self.words) > REMEMBERED:
            self._forget()
        split = pc.ascii_split_whitespace(pa.array([t if t.translate(None, self.PLAIN) else t.lower() for t in texts], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = _strings(coded.dictionary)
        at = self._places(words)
        lacking = np.flatnonzero(at < 0)
        if len(lacking):
            new = [words[i] for i in lacking]
            self._learn(new)
            at[lacking] = self._places(new)
        place = at[coded.indices.to_numpy()]
        n = self.word_ids.n
        self.word_ids.hits[:n] += np.bincount(place, minlength=n)
        sizes, flat = self.word_ids.gather(place)
        upto = np.concatenate([[0], np.cumsum(sizes)])[split.offsets.to_numpy()]
        return [flat[upto[i] : upto[i + 1]] for i in range(len(texts))]


def _words(path: str) -> WordIds:
    """The worker's encoder, for the next tasks of this operator too."""
    key = (__name__, path)
    if key not in HELD:
        HELD.clear()
        HELD[key] = WordIds(path)
    return HELD[key]


def _runs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """From where to where texts are encoded in one call: as many as reach TOGETHER bytes."""
    at = held = 0
    for i, t in enumerate(texts, 1):
        held += len(t)
        if held >= TOGETHER or i == len(texts):
            yield at, i
            at, held = i, 0


def shard_name(partition: int, k: int) -> str:
    """Names sort by partition and, within it, by turn: both have at most nine digits."""
    return f"shard-{partition:09d}-{k:09d}.svb"


def _write(out: str, vocabulary: str, end_id: int):
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(out)
        task = TaskContext.get()
        encoder = _words(vocabulary)
        docs, lengths, ids, held, k = [], [], [], 0, 0

        def close():
            nonlocal docs, lengths, ids, held, k
            name = shard_name(task.partitionId(), k)
            raw = pack_shard(docs, np.array(lengths, dtype=np.int64), np.concatenate(ids))
            draft = f"{folder}/.{name}.{task.taskAttemptId()}"
            with store.open_output_stream(draft) as f:
                f.write(raw)
            store.move(draft, f"{folder}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(docs)], pa.int64()), pa.array([held], pa.int64()), pa.array([len(raw)], pa.int64())], names=["shard", "n_docs", "n_tokens", "n_bytes"])
            docs, lengths, ids, held, k = [], [], [], 0, k + 1
            return row

        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), bytes_of(batch.column(1))
            for at, to in _runs(texts):
                for doc, x in zip(names[at:to], encoder.encode(texts[at:to]), strict=True):
                    docs.append(doc)
                    lengths.append(len(x) + 1)
                    ids += [x, end]
                    held += len(x) + 1
                    if held >= SHARD_TOKENS:
                        yield close()
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, vocabulary: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Tokenize every row and write shards under the shared folder `out`; returns shard, n_docs, n_tokens, n_bytes.

    Shard names sort as doc ids do; null ids come first. A null text is empty and has only the end id. Repeated rows
    are all written. Other columns are ignored. Shards are written under a draft name and moved, so a lost task leaves
    no half of one and its rerun writes the same bytes."""
    spark = docs.sparkSession
    ship(spark)
    from_uri_safe = out if "://" in out else f"file://{out}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(from_uri_safe)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest, at = materialize(ordered.mapInArrow(lean(_write(from_uri_safe, vocabulary, end_id), __name__), "shard string, n_docs long, n_tokens long, n_bytes long"), "token-manifest")
    retire(spark, at)
    return manifest


def _read(out: str):
    def run(batches):
        import zlib

        import pyarrow as pa
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(out)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = path.rsplit("/", 1)[1]
                with store.open_input_stream(f"{folder}/{name}") as f:
                    doc_ids, lengths, ids = unpack_shard(f.read())
                ids = ids.astype("<u4", copy=False)
                end = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(end, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(doc_ids), pa.string()), pa.array(doc_ids, pa.int64()), pa.array(end - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["shard", "doc_id", "within", "n_tokens", "ids_crc32"])

    return run


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """Digest of each document from the shards: doc_id, start, n_tokens, ids_crc32, shard.

    Spark lists the shards and deals them to tasks; a task opens one after the other, so it holds one at a time."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.svb").load(out).select("path")
    rows, at = materialize(files.mapInArrow(lean(_read(out if "://" in out else f"file://{out}")), "shard string, doc_id long, within long, n_tokens long, ids_crc32 long"), "token-digest")
    retire(spark, at)
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(shards, "shard").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "shard")


def token_output(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, out: str | None = None) -> DataFrame:
    """Write all documents as token shards (in `out`, else in a new folder of the shared one) and read them back."""
    spark = docs.sparkSession
    own = out or fresh_path(spark, "tokens")
    write_tokens(docs, vocabulary, own, id_col, text_col, end_id)
    result = read_tokens(spark, own)
    if out is None:
        result, at = materialize(result, "token-result")
        discard(spark, own)
        retire(spark, at)
    return result

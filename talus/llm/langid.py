"""Language identification by string kernels.

A text's feature set are its letter n-grams of one to three characters (a blended spectrum, presence only). The
kernel of two texts is the size of the intersection of their sets over the root of the product of their sizes.
Landmark texts give a Nystroem map, and one-versus-rest kernel ridge regression is fitted on it. As the kernel to
the landmarks is linear in the presence vector, landmarks, Nystroem map and ridge weights fold into one matrix, and
a batch of texts is scored by one product."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, ship, spread

#: n-grams are hashed to this many slots.
SLOT_BITS = 16
#: The classifier is fitted on at most so many labelled texts a language and in all.
PER_LANGUAGE, IN_ALL = 400, 4000
LANDMARKS, RIDGE = 512, 1e-2
UNKNOWN = "und"
_SALTS = 32
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Lower-cased letter of each code point, 0 for what is no letter."""
    global _letters
    if _letters is None:
        t = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                t[c] = ord(s.lower()[0])
        _letters = t
    return _letters


def present(text: str, buffer: np.ndarray) -> bool:
    """Mark the slots of the n-grams in the zeroed buffer; False if the text has no letter."""
    codes = letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    if not codes.any():
        return False
    gap = codes == 0
    codes = codes[~(gap & np.concatenate([[True], gap[:-1]]))]
    codes = np.concatenate([np.zeros(1, np.uint32), codes, np.zeros(1, np.uint32)])
    shift = np.uint32(32 - SLOT_BITS)
    a = codes * np.uint32(0x9E3779B1)
    buffer[a >> shift] = 1
    b = (a[:-1] ^ (codes[1:] + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
    buffer[b >> shift] = 1
    c = (b[:-1] ^ (codes[2:] + np.uint32(0x1B873593))) * np.uint32(0xC2B2AE35)
    buffer[c >> shift] = 1
    return True


def _pack(batches):
    """(id, label, text) to (id, label, bits) of texts with a letter."""
    import pyarrow as pa

    buffer = np.zeros(1 << SLOT_BITS, dtype=np.uint8)
    for batch in batches:
        kept, bits = [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            buffer[:] = 0
            if text and present(text, buffer):
                kept.append(i)
                bits.append(np.packbits(buffer).tobytes())
        at = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(bits, pa.binary())], names=["id", "label", "bits"])


@dataclass
class Model:
    languages: list[str]
    slots: np.ndarray
    weights: np.ndarray

    def scores(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (rows @ self.weights) / np.sqrt(np.maximum(sizes, 1))[:, None]


def fit(rows: list[bytes], labels: list[str]) -> Model | None:
    """rows: presence of all slots in packed bits; they are unpacked a few at a time."""
    if not rows:
        return None
    languages = sorted(set(labels))
    at = {x: i for i, x in enumerate(languages)}
    y = np.full((len(rows), len(languages)), -1.0)
    y[np.arange(len(rows)), [at[x] for x in labels]] = 1
    # Landmarks: the first texts of each language in turn.
    seen: dict[str, int] = {}
    turn = []
    for i, x in enumerate(labels):
        turn.append((seen.get(x, 0), i))
        seen[x] = seen.get(x, 0) + 1
    marks = np.array([i for _, i in sorted(turn)[:LANDMARKS]])
    packed = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)
    slots = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(packed[marks], axis=0)))
    size = np.sqrt(np.bitwise_count(packed).sum(axis=1, dtype=np.float64))
    scaled = np.unpackbits(packed[marks], axis=1)[:, slots].astype(np.float32) / size[marks][:, None]
    parts = [np.unpackbits(packed[i : i + 256], axis=1)[:, slots].astype(np.float32) @ scaled.T for i in range(0, len(rows), 256)]
    k_all = np.concatenate(parts) / size[:, None]
    k_mm = k_all[marks].astype(np.float64)
    value, vector = np.linalg.eigh((k_mm + k_mm.T) / 2)
    good = value > max(value[-1] * 1e-6, 1e-10)
    nystroem = vector[:, good] / np.sqrt(value[good])
    phi = k_all @ nystroem
    # Languages weigh alike however many texts they have.
    weight = np.array([1.0 / seen[x] for x in labels]) * (len(rows) / len(languages))
    gram = (phi * weight[:, None]).T @ phi + RIDGE * len(rows) / 100 * np.eye(phi.shape[1])
    ridge = np.linalg.solve(gram, (phi * weight[:, None]).T @ y)
    return Model(languages, slots, (scaled.T.astype(np.float64) @ (nystroem @ ridge)).astype(np.float32))


def train(docs: DataFrame, text_col: str, label_col: str, id_col: str, usable) -> Model | None:
    """Fit on a bounded sample: of each language the usable rows whose id hash comes first, and one row of every language
    before a second of any.

    The ids are chosen without their texts: a partial row number in each of 32 salts of a language, so that a
    language with most of the rows never meets in one task. Rows that repeat an id and label
    are one text."""
    ship(docs.sparkSession)
    rows = docs.where(usable & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    key = rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.xxhash64(F.col(id_col).cast("string")).alias("h")).distinct().withColumn("salt", F.pmod("h", F.lit(_SALTS)))
    few = key.withColumn("n", F.row_number().over(Window.partitionBy("label", "salt").orderBy("h", "id"))).where(F.col("n") <= -(-PER_LANGUAGE // _SALTS))
    # At most PER_LANGUAGE rows and a few for each language are left here.
    ranked = few.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("h", "id"))).orderBy("n", "h", "label").limit(IN_ALL)
    chosen, at = materialize(ranked.select("id").distinct(), "langid-sample")
    # At most IN_ALL ids; only their texts leave the scan.
    texts = rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    bits = texts.mapInArrow(_pack, texts.select("id", "label", F.lit(b"").alias("bits")).schema)
    got = sorted((r.label, bytes(r.bits)) for r in bits.groupBy("id", "label").agg(F.min("bits").alias("bits")).collect())
    discard(docs.sparkSession, at)
    return fit([x for _, x in got], [label for label, _ in got])


def _predict(shared):
    def run(batches):
        import pyarrow as pa

        model = shared.value
        buffer = np.zeros(1 << SLOT_BITS, dtype=np.uint8)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for at in range(0, len(texts), 128):
                part = texts[at : at + 128]
                label, score = [UNKNOWN] * len(part), [0.0] * len(part)
                rows, sizes, which = [], [], []
                for i, text in enumerate(part):
                    buffer[:] = 0
                    if text and model is not None and present(text, buffer):
                        rows.append(buffer[model.slots].astype(np.float32))
                        sizes.append(int(np.count_nonzero(buffer)))
                        which.append(i)
                if rows:
                    f = model.scores(np.stack(rows), np.array(sizes))
                    best = f.argmax(axis=1)
                    for i, b, v in zip(which, best, f.max(axis=1), strict=True):
                        label[i], score[i] = model.languages[b], float(np.clip((1 + v) / 2, 0, 1))
                n = len(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(label, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row from its whole text alone.

    Null texts, empty ones and those without a letter are `und` with score 0, and so is everything without a model
    (no labelled row). Ties go to the label that sorts first. Repeated rows and null ids are rows like others; other
    columns are ignored."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    rows = spread(rows)
    schema = rows.select("doc_id", "held_out", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(_predict(spark.sparkContext.broadcast(model)), schema)

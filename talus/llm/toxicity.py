"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic texts are the positives; all other training texts, whatever their label, count as unlabelled. A
linear model over hashed words and word stems minimises the risk that the class prior corrects, and whose negative
part is held at zero or above. Training is numpy on a bounded sample; every text is scored in map tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, materialize, ship, spread

SLOT_BITS = 20
#: The classifier is fitted on at most so many positive and unlabelled texts, those whose id hash comes first.
POSITIVES, UNLABELLED = 2500, 10_000
#: Words of the same first letters share a stem feature.
STEM = 5
EDGES = ".,;:!?\"'()[]{}<>#$%&*|+-=/\\_~^`"
REMEMBERED = 300_000


class Features:
    """Slots of a text's distinct words and stems; the slots of words are remembered."""

    def __init__(self):
        self.slots: dict[str, tuple[int, int]] = {}

    def of(self, text: str | None) -> np.ndarray:
        from zlib import crc32

        if not text:
            return np.zeros(0, np.int32)
        if len(self.slots) > REMEMBERED:
            self.slots.clear()
        known, out = self.slots, set()
        for w in set(text.split()):
            pair = known.get(w)
            if pair is None:
                x = w.lower().strip(EDGES)
                if x:
                    low = (1 << SLOT_BITS) - 1
                    pair = (crc32(x.encode("utf-8", "replace")) & low, crc32(b"stem:" + x[:STEM].encode("utf-8", "replace")) & low if len(x) >= STEM else -1)
                else:
                    pair = (-1, -1)
                known[w] = pair
            out.update(pair)
        out.discard(-1)
        return np.fromiter(out, dtype=np.int32, count=len(out))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, slots: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[slots].sum(dtype=np.float64) + self.bias, -60, 60))))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 150, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Full-batch Adam on pi R_p(+) + max(0, R_u(-) - pi R_p(-)) with the logistic loss.

    Slots that fewer than 3 positives hold, or whose share among positives isn't twice that among the unlabelled and
    four standard errors above it, get no weight: they can't tell the classes apart."""
    size = 1 << SLOT_BITS
    empty = Model(np.zeros(size, np.float32), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    if not positive or not unlabelled:
        return empty
    df_p = np.bincount(np.concatenate(positive), minlength=size) if positive else np.zeros(size)
    df_u = np.bincount(np.concatenate(unlabelled), minlength=size) if unlabelled else np.zeros(size)
    usual = (df_u + 0.5) / (len(unlabelled) + 1)
    surplus = (df_p / len(positive) - usual) / np.sqrt(usual * (1 - usual) / len(positive))
    good = np.flatnonzero((df_p >= 3) & (df_p / len(positive) >= 2 * usual) & (surplus >= 4))
    if not len(good):
        return empty
    place = np.full(size, -1, dtype=np.int64)
    place[good] = np.arange(len(good))

    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = place[np.concatenate(rows)]
        return row[col >= 0], col[col >= 0]

    (row_p, col_p), (row_u, col_u) = flat(positive), flat(unlabelled)
    n_p, n_u, d = len(positive), len(unlabelled), len(good)
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    w[d] = -2.0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for step in range(1, steps + 1):
        z_p = np.bincount(row_p, weights=w[col_p], minlength=n_p) + w[d]
        z_u = np.bincount(row_u, weights=w[col_u], minlength=n_u) + w[d]
        negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        if negative >= 0:
            g_p, g_u = (-prior * (1 - sigmoid(z_p)) - prior * sigmoid(z_p)) / n_p, sigmoid(z_u) / n_u
        else:  # the negative risk overfits: step back along it
            g_p, g_u = prior * sigmoid(z_p) / n_p, -sigmoid(z_u) / n_u
        g = np.append(np.bincount(col_p, weights=g_p[row_p], minlength=d) + np.bincount(col_u, weights=g_u[row_u], minlength=d), g_p.sum() + g_u.sum())
        g[:d] += decay * w[:d]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(size, dtype=np.float32)
    weights[good] = w[:d]
    return Model(weights, float(w[d]))


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic") -> Model:
    """Fit on the usable ids, each once however often it is repeated; the prior is the share of toxic ones
    among usable labels, of which repeats count once."""
    ship(docs.sparkSession)
    known = labels.select(F.col(label_id).alias(id_col), F.col(label_col).alias("toxic")).where(usable & F.col("toxic").isNotNull()).distinct()
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    order = F.xxhash64(F.col("id").cast("string"))
    positive = known.where("toxic = 1").select(F.col(id_col).alias("id")).distinct().orderBy(order, "id").limit(POSITIVES).withColumn("p", F.lit(True))
    other = docs.where(usable).select(F.col(id_col).alias("id")).distinct().orderBy(order, "id").limit(UNLABELLED).withColumn("u", F.lit(True))
    # At most POSITIVES + UNLABELLED ids; only their texts leave the scan. Slots are counted in the tasks first, so that
    # of long texts no more than the slots that can get a weight come to the driver.
    sample, at = materialize(positive.join(other, "id", "full"), "toxicity-sample")
    yes = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))).join(F.broadcast(sample), "id").select("id", yes("p"), yes("u"), "text")
    counts = rows.select("p", "u", "text").mapInArrow(lean(_counts), "slot int, p long, u long").groupBy("slot").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    counts = {r.slot: (r.p, r.u) for r in counts.where("p >= 3 or slot < 0").collect()}  # a row a slot at most
    n_p, n_u = counts.pop(-1, (0, 0))
    good = np.array(sorted(s for s, (p, u) in counts.items() if p * (n_u + 1) >= 2 * n_p * (u + 0.5)), dtype=np.int32)
    picked = rows.mapInArrow(lean(_picked(docs.sparkSession.sparkContext.broadcast(good))), rows.select("id", "p", "u", F.lit(None).cast("array<int>").alias("slots")).schema)
    got = sorted(picked.collect(), key=lambda r: (str(r.id), r.slots))
    discard(docs.sparkSession, at)
    as_array = lambda r: np.array(r.slots, dtype=np.int32)
    return fit([as_array(r) for r in got if r.p], [as_array(r) for r in got if r.u], float(share or 0.0))


def _counts(batches):
    """How many positive and unlabelled texts hold each slot; slot -1 counts the texts."""
    import pyarrow as pa

    features, n = Features(), np.zeros((2, (1 << SLOT_BITS) + 1), np.int64)
    for batch in batches:
        for p, u, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            slots = features.of(t)
            for k in [k for k, yes in enumerate((p, u)) if yes]:
                n[k, slots] += 1
                n[k, -1] += 1
    live = np.flatnonzero(n.any(axis=0))
    slot = np.where(live == 1 << SLOT_BITS, -1, live)
    yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(n[0, live], pa.int64()), pa.array(n[1, live], pa.int64())], names=["slot", "p", "u"])


def _picked(shared):
    """Of each text the slots among the given ones."""

    def run(batches):
        import pyarrow as pa

        features, good = Features(), shared.value
        for batch in batches:
            rows = [x[np.isin(x, good)] for x in (features.of(t) for t in batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.list_(pa.int32()))], names=["id", "p", "u", "slots"])

    return run


def _score(shared, text_at: int):
    def run(batches):
        import pyarrow as pa

        model, features = shared.value, Features()
        for batch in batches:
            score = [model.score(features.of(t)) for t in batch.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "__talus_toxicity"])

    return run


def score_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of docs and __talus_toxicity, the score of the row's whole text; a null text scores as an empty one."""
    spark = docs.sparkSession
    ship(spark)
    schema = docs.select("*", F.lit(0.0).alias("__talus_toxicity")).schema
    return spread(docs).mapInArrow(lean(_score(spark.sparkContext.broadcast(model), docs.columns.index(text_col))), schema)


def toxicity(docs: DataFrame, labels: DataFrame, usable: Column, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Labels of null ids or null value teach nothing. Without a positive the score is the prior for every text. Ties
    don't arise: each row is scored alone. Repeated rows score alike; other columns are ignored; an empty table
    gives an empty result."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    scored = score_rows(rows, train(docs, labels, usable, id_col, text_col))
    return scored.select("doc_id", "held_out", F.col("__talus_toxicity").alias("score"), (F.col("__talus_toxicity") >= 0.5).cast("int").alias("predicted"))

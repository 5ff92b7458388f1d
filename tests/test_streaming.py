import os
import random

import pytest
from pyspark.sql import functions as F

from talus.operators import state, threads
from talus.streaming import incremental as inc, keyed


def test_ingest_is_idempotent(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    schema = "conv_id long, seq long, content string"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], schema).write.parquet(f"{src}/x")
    stream = lambda: inc.file_stream(spark, f"{src}/*", spark.createDataFrame([], schema).schema)
    inc.ingest_messages(stream(), out, f"{tmp_path}/cp", ["conv_id", "seq"]).awaitTermination()
    spark.createDataFrame([(1, 2, "changed"), (1, 3, "c")], schema).write.parquet(f"{src}/y")
    for _ in range(2):
        inc.ingest_messages(stream(), out, f"{tmp_path}/cp", ["conv_id", "seq"]).awaitTermination()
    got = {(r.conv_id, r.seq): r.content for r in inc.ingested(spark, out).collect()}
    assert got == {(1, 1): "a", (1, 2): "b", (1, 3): "c"}


def test_ingest_compacts_and_goes_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inc, "COMPACT", 3)
    src, out, kind = tmp_path / "in", f"file://{tmp_path}/out", "k long, v string"
    want = {}
    for n in range(7):
        rows = [(n, f"new{n}"), (n + 1, f"new{n}"), (n + 1, f"also{n}"), (None, f"n{n}")]
        for k, v in sorted(rows, key=str):
            want.setdefault(k, v)
        spark.createDataFrame(rows, kind).write.parquet(f"{src}/{n}")
        inc.ingest_messages(inc.file_stream(spark, f"{src}/*", spark.createDataFrame([], kind).schema), out, f"{tmp_path}/cp", ["k"]).awaitTermination()
    base, there = inc.folders_of(spark, out)
    assert base is not None and len(there) <= 4
    got = [(r.k, r.v) for r in inc.ingested(spark, out).collect() if r.k is not None]
    assert dict(got) == {k: v for k, v in want.items() if k is not None} and len(got) == len(set(got)) == 8


def events(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return inc.file_stream(spark, sf, e.schema, glob="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_tumbling_equals_batch_for_closed_windows(spark, sf, tmp_path):
    got = inc.run_to_end(inc.tumbling(events(spark, sf), "ts", ["event_type"]), str(tmp_path / "o"), str(tmp_path / "c"))
    batch = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("m"))
    both = got.join(batch, (F.col("start") == F.col("w.start")) & (got.event_type == batch.event_type))
    assert got.count() > 0 and both.where("n <> m").count() == 0 and both.count() == got.count()


def test_dedupe_and_sessions(spark, sf, tmp_path):
    d = inc.run_to_end(inc.dedupe(events(spark, sf), ["event_id"], "ts"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert d.count() == d.select("event_id").distinct().count() > 0
    s = inc.run_to_end(inc.sessions(events(spark, sf), "ts", ["user_id"]), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert s.count() > 0


def budget_brute(calls, window, most):
    held, out = {}, {}
    for u, s, i in sorted(calls, key=lambda c: (c[1], c[2])):
        mine = held[u] = [h for h in held.get(u, []) if h >= s - window]
        out[i] = len(mine) < most
        if out[i]:
            mine.append(s)
    return out


def test_read_budget_over_several_frames(spark, tmp_path):
    """Calls of a user in several Arrow frames, out of order; a null user is a user; a second trigger goes on where the first ended."""
    r = random.Random(2)
    calls = [(u, r.randrange(900), i) for i, u in enumerate(["u", "v", None] * 30)]
    later = [(u, 900 + r.randrange(300), 1000 + i) for i, u in enumerate(["u", None] * 10)]
    src, kind = str(tmp_path / "calls"), "user string, at long, call long"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for n, part in enumerate((calls, later)):
            spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{src}/{n}")
            stream = inc.file_stream(spark, f"{src}/*", spark.createDataFrame([], kind).schema)
            got = inc.run_to_end(keyed.read_budget(stream, "user", "at", 300, 5), str(tmp_path / "o"), str(tmp_path / "c"))
        assert {x.call: x.allowed for x in got.collect()} == budget_brute(calls + later, 300, 5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


@pytest.mark.parametrize("size", ["2", "10000"])
def test_rolling_budget_of_null_users(spark, size):
    r = random.Random(3)
    calls = [(u, r.randrange(600), i) for i, u in enumerate(["u", None, "v"] * 25)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = threads.rolling_budget(spark.createDataFrame(calls, "user string, at long, call long"), "user", "at", "call", 100, 3).collect()
        assert {x.call: x.allowed for x in got} == budget_brute(calls, 100, 3)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_silent_sources_are_told_without_an_event(spark, tmp_path):
    parts = [[("a", "00:00:00"), ("b", "00:00:10"), ("b", None)], [("a", "00:02:00"), (None, "00:02:00")], [("a", "00:09:00")], [("b", "00:10:00"), ("a", "00:10:00")]]
    src, kind = tmp_path / "beats", "src string, t timestamp"
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, "src string, t string").selectExpr("src", "to_timestamp('2024-01-01 ' || t) AS t").coalesce(1).write.parquet(f"{src}/{n}")
        for p in (src / str(n)).glob("*.parquet"):
            os.utime(p, (1e9 + n, 1e9 + n))
    stream = inc.file_stream(spark, f"{src}/*", spark.createDataFrame([], kind).schema, per_trigger=1)
    got = inc.run_to_end(keyed.silent_sources(stream, "src", "t", 180), str(tmp_path / "o"), str(tmp_path / "c")).collect()
    assert [(x.src, str(x.last_seen), str(x.stale_at)) for x in got] == [(None, "2024-01-01 00:02:00", "2024-01-01 00:05:00")]


def test_insert_ignore_keeps_the_first_row(spark):
    old, kind = [(1, 0, "old")], "k long, seq long, v string"
    new = [(1, 1, "x"), (2, 5, "late"), (2, 3, "b"), (2, 3, "a"), (None, 1, "n")]
    got = state.insert_ignore(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), ["k"], ["seq"]).collect()
    assert sorted(map(tuple, got), key=repr) == [(1, 0, "old"), (2, 3, "a"), (None, 1, "n")]


def test_upsert_and_purge_guards(spark):
    old = spark.createDataFrame([(1, 5, None), (2, 6, "s")], "k long, n int, slug string")
    new = spark.createDataFrame([(1, 9, "new"), (2, 9, "t"), (3, 1, None)], "k long, n int, slug string")
    assert sorted(map(tuple, state.upsert(old, new, "k", ["n"], ["slug"]).collect())) == [(1, 9, "new"), (2, 9, "s"), (3, 1, None)]
    for slug, reason in (("__x__", "r"), ("p", " "), (None, "r")):
        with pytest.raises(ValueError):
            state.purge_counts(slug, reason, old, old, old)


def test_backfill_goes_on_where_it_ended(spark, tmp_path):
    rows, out, seen = spark.range(0, 100).withColumnRenamed("id", "k"), f"file://{tmp_path}/fill", []
    double = lambda df: (seen.append(1), df.withColumn("v", F.col("k") * 2))[1]
    _, beats = state.backfill(rows, double, "k", out, 4, stop_after=3)
    got, rest = state.backfill(rows, double, "k", out, 4)
    assert len(beats) == 3 and len(rest) == 1 and len(seen) == 4
    assert {(r.k, r.v) for r in got.collect()} == {(k, 2 * k) for k in range(100)}
    assert state.residual(got, F.col("v").isNull()).first().residual == 0


def test_ingest_replays_a_batch(spark, tmp_path):
    """A batch that is written again leaves the table as it was."""
    src, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    df.write.parquet(src)
    for n in range(2):  # a lost checkpoint replays batch 0
        inc.ingest_messages(inc.file_stream(spark, src, df.schema), out, f"{tmp_path}/cp{n}", ["k"]).awaitTermination()
    assert sorted(map(tuple, inc.ingested(spark, out).collect())) == [(1, "a"), (2, "b")]


def test_chunks_carry_vectors_of_equal_content(spark):
    kind = "path string, seq int, symbol string, content_sha string, start_line int, end_line int"
    old = [("same", 0, "f", "x", 1, 4, [1.0]), ("same", 1, "g", "y", 5, 9, None), ("moved", 0, "f", "p", 1, 4, [2.0]), ("moved", 1, "g", "q", 5, 9, [3.0]), ("gone", 0, "f", "z", 1, 4, [4.0]), ("twin", 0, "f", "p", 1, 4, [5.0])]
    new = [("same", 0, "f", "x", 11, 14), ("same", 1, "g", "y", 15, 19), ("moved", 0, "g", "q", 1, 4), ("moved", 1, "f", "p", 5, 9), ("moved", 2, "h", "none", 10, 14), ("fresh", 0, "f", "z", 1, 4), (None, 0, "f", "z", 1, 4)]
    got = state.replace_chunks(spark.createDataFrame(old, kind + ", dense array<double>"), spark.createDataFrame(new, kind)).collect()
    assert {(r.path, r.seq): (r.status, r.dense, r.start_line) for r in got} == {
        ("same", 0): ("metadata-only", [1.0], 11), ("same", 1): ("metadata-only", None, 15), ("moved", 0): ("replaced", [3.0], 1), ("moved", 1): ("replaced", [2.0], 5),
        ("moved", 2): ("replaced", None, 10), ("fresh", 0): ("new", [4.0], 1),
    }

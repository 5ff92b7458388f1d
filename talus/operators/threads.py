"""Conversations and their messages: recency, excerpts, sampling, segments and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions import text as tx


def recent(threads: DataFrame, messages: DataFrame, as_of: Column, days: int, limit: int, where: Column | None = None) -> DataFrame:
    """Threads whose last activity is within the window, latest first, with their first message."""
    if where is not None:
        threads = threads.where(where)
    own = messages.groupBy("conv_id").agg(F.max("ts").alias("last_message_at"), F.min_by("content", F.struct("seq", "ts")).alias("first_msg"))
    out = threads.join(own, "conv_id", "left").withColumn("active_at", F.coalesce("ended_at", "last_message_at", "started_at"))
    return out.where(F.col("active_at") >= as_of - F.make_dt_interval(F.lit(days))).orderBy(F.col("active_at").desc_nulls_last(), "conv_id").limit(limit)


def head_tail(messages: DataFrame, half: int) -> DataFrame:
    """The first and the last messages of every thread, each once."""
    up = Window.partitionBy("conv_id").orderBy("seq", "ts")
    down = Window.partitionBy("conv_id").orderBy(F.desc("seq"), F.desc("ts"))
    return messages.withColumn("rn", F.row_number().over(up)).withColumn("rn_back", F.row_number().over(down)).where((F.col("rn") <= half) | (F.col("rn_back") <= half))


def resolve_suffix(threads: DataFrame, bare_id: str) -> DataFrame:
    """The thread whose id is bare_id or ends in ':' and it, if there is exactly one."""
    found = threads.where((F.col("conv_id") == bare_id) | F.col("conv_id").endswith(f":{bare_id}")).limit(2)
    return found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy())).where("n = 1").drop("n")


def prose(messages: DataFrame, min_len: int = 20) -> DataFrame:
    return messages.where(F.col("content").isNotNull() & ~F.col("content").startswith("[tool_result") & (F.length("content") >= min_len))


def sample_uniform(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """Rows at positions floor(i * size / n) of each key; all rows of keys with n or fewer."""
    w = Window.partitionBy(key)
    r = rows.withColumn("pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("size", F.count(F.lit(1)).over(w))
    # Position p is picked if some i < n has floor(i * size / n) = p: the first such i is ceil(p * n / size).
    i = F.ceil(F.col("pos") * F.lit(n) / F.col("size"))
    return r.where((F.col("size") <= n) | ((i < n) & (F.floor(i * F.col("size") / F.lit(n)) == F.col("pos"))))


def segments(messages: DataFrame, size: int = 200) -> DataFrame:
    """Windows of `size` qualifying messages: conv_id, seg_idx, start_seq, end_seq, n."""
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq")) - 1
    return messages.withColumn("seg_idx", F.floor(pos / size).cast("int")).groupBy("conv_id", "seg_idx").agg(F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.count(F.lit(1)).alias("n"))


def transcripts(messages: DataFrame, n: int, max_chars: int, min_len: int = 20) -> DataFrame:
    """Sampled transcript of each thread; the prose is only cut out of sampled messages."""
    picked = sample_uniform(prose(messages, min_len), "conv_id", ["seq"], n)
    line = picked.withColumn("prose", tx.extract_prose(F.col("content"), max_chars)).where(F.length("prose") >= min_len)
    line = line.withColumn("line", tx.transcript_line(F.col("role"), F.col("prose")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"])
    return line.groupBy("conv_id").agg(F.array_join(lines, "\n\n").alias("transcript"), F.count(F.lit(1)).alias("n_lines"))


def pack_windows(messages: DataFrame, budget: int) -> DataFrame:
    """Greedy packing in order into windows of at most `budget` characters; an oversized message has its own.

    The fold is sequential within a thread, over lengths only; texts are not collected."""
    lengths = F.transform(F.array_sort(F.collect_list(F.struct("seq", "chars"))), lambda x: x["chars"])

    def step(acc: Column, n: Column) -> Column:
        new = (acc["held"] > 0) & (acc["held"] + n + 2 > budget)
        window = F.when(new, acc["window"] + 1).otherwise(acc["window"])
        held = F.when(new, n + 2).otherwise(acc["held"] + n + 2)
        return F.struct(window.alias("window"), held.alias("held"), F.concat(acc["out"], F.array(window)).alias("out"))

    start = F.struct(F.lit(0).alias("window"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("out"))
    packed = messages.select("conv_id", "seq", F.length("line").alias("chars")).groupBy("conv_id").agg(F.aggregate(lengths, start, step, lambda a: a["out"]).alias("windows"), F.transform(F.array_sort(F.collect_list("seq")), lambda x: x).alias("seqs"))
    return packed.select("conv_id", F.explode(F.arrays_zip("seqs", "windows")).alias("z")).select("conv_id", F.col("z.seqs").alias("seq"), F.col("z.windows").alias("window"))


def coalesce_runs(parts: DataFrame, session: str, order: str, key: list[str], text: str) -> DataFrame:
    """Neighbouring rows of one key become one row, their texts joined by line breaks."""
    w = Window.partitionBy(session).orderBy(order)
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(w))
    marked = parts.withColumn("__new", F.when(F.lag(order).over(w).isNull() | ~same, 1).otherwise(0)).withColumn("island", F.sum("__new").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text)))), lambda x: x[text]), "\n")
    return marked.groupBy(session, "island", *key).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n_parts"), joined.alias("content"))


def interpolated_times(messages: DataFrame, session: str, order: str, start: str, end: str) -> DataFrame:
    """Evenly spaced times from start to end over a session's slots."""
    w = Window.partitionBy(session)
    slot = (F.row_number().over(w.orderBy(order)) - 1).cast("double")
    last = F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1)).cast("double")
    span = F.unix_micros(F.col(end)) - F.unix_micros(F.col(start))
    return messages.withColumn("ts", F.timestamp_micros((F.unix_micros(F.col(start)) + F.floor(span * slot / last)).cast("long")))


def rolling_budget(calls: DataFrame, user: str, seconds: str, order: str, window_s: int, most: int) -> DataFrame:
    """(order, n_before, allowed): whether each call has a place in its user's budget. Only allowed calls take places, so a
    user's calls are gone through in order; of them no more than `most` times are held."""
    kind = calls.schema

    def run(batches):
        from collections import deque

        import pyarrow as pa

        who, held = (), deque()  # no user, not even a null one
        for batch in batches:
            n, ok = [], []
            for u, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if u != who:
                    who, held = u, deque()
                while held and held[0] < s - window_s:
                    held.popleft()
                n.append(len(held))
                ok.append(len(held) < most)
                if ok[-1]:
                    held.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(n, pa.int64()), pa.array(ok, pa.bool_())], names=[order, "n_before", "allowed"])

    rows = calls.select(F.col(user), F.col(seconds).cast("long").alias(seconds), F.col(order))
    ordered = rows.repartition(user).sortWithinPartitions(user, seconds, order)
    return ordered.mapInArrow(run, f"{order} {kind[order].dataType.simpleString()}, n_before long, allowed boolean")


def day_budget(counts: DataFrame, order: list[Column], budget: int) -> DataFrame:
    """Lines that each conversation of a day may give: what is left of the budget when its turn comes."""
    before = F.coalesce(F.sum("n_lines").over(Window.partitionBy("day").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("taken", F.greatest(F.lit(0).cast("long"), F.least(F.col("n_lines"), F.lit(budget) - before)))


def segment_transcripts(messages: DataFrame, size: int = 200, n: int = 20, max_chars: int = 300, min_len: int = 20) -> DataFrame:
    """A sampled transcript of each window of `size` qualifying messages, for threads that have more than `size` messages."""
    longer = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > size).select("conv_id")
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq")) - 1
    rows = prose(messages, min_len).join(longer, "conv_id", "left_semi").withColumn("seg_idx", F.floor(pos / size).cast("int"))
    span = rows.groupBy("conv_id", "seg_idx").agg(F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"))
    picked = sample_uniform(rows.withColumn("__key", F.struct("conv_id", "seg_idx")), "__key", ["seq"], n)
    line = picked.withColumn("prose", tx.extract_prose(F.col("content"), max_chars)).where(F.length("prose") >= min_len)
    line = line.withColumn("line", tx.transcript_line(F.col("role"), F.col("prose")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"])
    return line.groupBy("conv_id", "seg_idx").agg(F.array_join(lines, "\n\n").alias("transcript")).join(span, ["conv_id", "seg_idx"])


def day_transcripts(messages: DataFrame, threads: DataFrame, budget: int = 140, most: int = 60, max_chars: int = 600, min_len: int = 20) -> DataFrame:
    """(day, transcript, n_lines): the day's conversations in order, each under its heading.

    threads: day, conv_id, title, provenance, started_at. Of a day with n conversations each gives at most
    max(8, min(most, budget / n + 8)) sampled lines, and all of them the budget. A day is at most `budget` lines."""
    n = F.count(F.lit(1)).over(Window.partitionBy("day"))
    t = threads.withColumn("cap", F.greatest(F.lit(8), F.least(F.lit(most), F.floor(F.lit(budget) / n) + 8)))
    w = Window.partitionBy("conv_id")
    rows = prose(messages, min_len).join(t, "conv_id").withColumn("pos", F.row_number().over(w.orderBy("seq")) - 1).withColumn("size", F.count(F.lit(1)).over(w))
    i = F.ceil(F.col("pos") * F.col("cap") / F.col("size"))
    rows = rows.where((F.col("size") <= F.col("cap")) | ((i < F.col("cap")) & (F.floor(i * F.col("size") / F.col("cap")) == F.col("pos"))))
    rows = rows.withColumn("prose", tx.extract_prose(F.col("content"), max_chars, True)).where(F.length("prose") >= min_len)
    order = Window.partitionBy("day").orderBy(F.col("started_at").asc_nulls_last(), "conv_id", "seq")
    rows = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= budget)
    head = F.concat(F.lit("## "), F.coalesce(F.nullif("title", F.lit("")), F.lit("conversation")), F.when(F.col("provenance") != "", F.concat(F.lit(" ["), F.col("provenance"), F.lit("]"))).otherwise(""), F.lit("\n"))
    first = F.row_number().over(Window.partitionBy("day", "conv_id").orderBy("k")) == 1
    rows = rows.withColumn("line", F.concat(F.when(first, head).otherwise(""), tx.transcript_line(F.col("role"), F.col("prose"), "CLAUDE")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"])
    return rows.groupBy("day").agg(F.array_join(lines, "\n\n").alias("transcript"), F.count(F.lit(1)).alias("n_lines"))

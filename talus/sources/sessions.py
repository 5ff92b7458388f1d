"""Session logs as (conversations, messages).

Logs are read as lines with their position in the file; JSON is parsed tolerantly to variants, so a malformed line is
only a line without fields. Each reader returns two DataFrames; texts are scrubbed as they are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.functions import text as tx
from talus.functions.times import from_epoch, parse_iso
from talus.operators.threads import coalesce_runs

Pair = tuple[DataFrame, DataFrame]


def lines(spark: SparkSession, path: str, glob: str = "*.jsonl", skip_blank_in_count: bool = False) -> DataFrame:
    """path, seq (0-based line number), value of every line that isn't blank; files under `subagents` are left out."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    raw = raw.where(~F.col("path").contains("/subagents/")).select("path", F.posexplode(F.split("value", "\n")).alias("seq", "value")).withColumn("value", tx.strip(F.col("value")))
    rows = raw.where("value <> ''")
    if skip_blank_in_count:
        rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("path").orderBy("seq")) - 1)
    return rows


def field(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def content_text(v: Column, path: str, tool_mark: str | None = "[tool_result:", joiner: str = "\n") -> Column:
    """A string, or the text blocks of a list; tool results leave a mark."""
    blocks = F.try_variant_get(v, path, "array<variant>")

    def part(b: Column) -> Column:
        kind = field(b, "$.type")
        out = F.when(kind == "text", field(b, "$.text"))
        if tool_mark is not None:
            out = out.when(kind == "tool_result", F.concat(F.lit(tool_mark), F.coalesce(field(b, "$.tool_use_id"), F.lit("")), F.lit("]")))
        return out.when(F.schema_of_variant(b) == "STRING", b.cast("string"))

    joined = F.array_join(F.filter(F.transform(blocks, part), lambda x: x.isNotNull() & (x != "")), joiner)
    return F.nullif(tx.strip(F.when(blocks.isNotNull(), joined).otherwise(field(v, path))), F.lit(""))


def _threads(messages: DataFrame, platform: str, title: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """First and last known time in the order of the file."""
    timed = F.when(F.col("ts").isNotNull(), F.col("seq"))
    out = messages.groupBy("conv_id").agg(F.min_by("ts", timed).alias("started_at"), F.max_by("ts", timed).alias("ended_at"), F.count(F.lit(1)).cast("int").alias("msg_count"), title.alias("title"), *[c.alias(n) for n, c in (extra or {}).items()])
    return out.withColumn("platform", F.lit(platform))


def _messages(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("content", tx.scrub(F.col("content"))).where("content is not null and content <> ''")
    return rows.select("conv_id", F.concat_ws(":", F.element_at(F.split("conv_id", ":", 2), -1), F.col("seq").cast("string")).alias("msg_id"), "role", "content", "ts", F.col("seq").cast("int").alias("seq"), *[c for c in rows.columns if c.startswith("x_")])


def session_jsonl(spark: SparkSession, path: str) -> Pair:
    """One file a conversation; user and assistant lines; seq is the line number."""
    v = F.col("v")
    rows = lines(spark, path).withColumn("v", F.try_parse_json("value")).withColumn("role", field(v, "$.type")).where(F.col("role").isin("user", "assistant"))
    stem = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    project = F.regexp_extract("path", r"/projects/([^/]+)/", 1)
    name = F.ltrim(project, F.lit("-"))
    two = F.regexp_replace(F.regexp_replace(name, "^([^-]*)-", "$1/"), "^([^-]*)-", "$1/")
    m = _messages(rows.select(F.concat(F.lit("claude_code:"), stem).alias("conv_id"), "seq", "role", content_text(v, "$.message.content").alias("content"), parse_iso(field(v, "$.timestamp")).alias("ts"), F.coalesce(F.nullif(two, F.lit("")), stem).alias("x_title")))
    return _threads(m, "claude_code", F.first("x_title")), m.drop("x_title")


def header_cwd(spark: SparkSession, path: str, max_lines: int = 50, max_bytes: int = 256 * 1024) -> DataFrame:
    """path, cwd: the first working folder in the head of each file."""
    rows = lines(spark, path)
    before = F.sum(F.octet_length("value")).over(Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.where(F.col("seq") < max_lines).withColumn("upto", before).where(F.col("upto") <= max_bytes)
    cwd = F.nullif(tx.strip(tx.strip_controls(field(F.try_parse_json("value"), "$.cwd"))), F.lit(""))
    return rows.withColumn("cwd", cwd).where("cwd is not null").groupBy("path").agg(F.min_by("cwd", "seq").alias("cwd"))


def history_jsonl(spark: SparkSession, path: str) -> Pair:
    """Rows of (session_id, ts, text): numbered per session by time and text before empty and exit rows go."""
    v = F.try_parse_json("value")
    rows = lines(spark, path, "history*.jsonl").select(tx.strip(field(v, "$.session_id")).alias("sid"), field(v, "$.ts", "double").alias("epoch"), F.when(F.schema_of_variant(F.try_variant_get(v, "$.text", "variant")) == "STRING", field(v, "$.text")).alias("raw"))
    rows = rows.where("sid <> '' and raw is not null")
    seq = F.row_number().over(Window.partitionBy("sid").orderBy(F.coalesce("epoch", F.lit(0.0)), "raw")) - 1
    text = tx.strip(F.col("raw"))
    rows = rows.withColumn("seq", seq).withColumn("content", text).withColumn("ts", from_epoch(F.col("epoch"))).withColumn("conv_id", F.concat(F.lit("codex:"), F.col("sid"))).withColumn("role", F.lit("user"))
    kept = rows.where(~F.col("content").isin("", "exit", "quit"))
    title = F.coalesce(F.min_by(F.substring(F.replace("content", F.lit("\n"), F.lit(" ")), 1, 80), "seq"), F.lit("Codex history"))
    span = rows.groupBy("conv_id").agg(F.min_by("ts", "seq").alias("started_at"), F.max_by("ts", "seq").alias("ended_at"))
    m = _messages(kept)
    c = kept.groupBy("conv_id").agg(title.alias("title"), F.count(F.lit(1)).cast("int").alias("msg_count")).join(span, "conv_id").withColumn("platform", F.lit("codex"))
    return c, m


def rollout_cwd(spark: SparkSession, path: str) -> DataFrame:
    """session_id, cwd from the first line of each rollout file."""
    v = F.try_parse_json("value")
    rows = lines(spark, path, "rollout-*.jsonl").groupBy("path").agg(F.min_by("value", "seq").alias("value"))
    rows = rows.where(field(v, "$.type") == "session_meta").select(field(v, "$.payload.id").alias("session_id"), field(v, "$.payload.cwd").alias("cwd"), "path")
    return rows.where("session_id is not null and cwd is not null").groupBy("session_id").agg(F.max_by("cwd", "path").alias("cwd"))


def transcript_jsonl(spark: SparkSession, path: str, inner: str = "*/.system_generated/logs") -> Pair:
    """User inputs (unwrapped) and planner responses. Logs lie in a hidden folder, which listings leave out, so it is named."""
    v = F.col("v")
    rows = lines(spark, f"{path}/{inner}", "transcript.jsonl").withColumn("v", F.try_parse_json("value")).withColumn("kind", field(v, "$.type")).where(F.col("kind").isin("USER_INPUT", "PLANNER_RESPONSE"))
    user = F.col("kind") == "USER_INPUT"
    raw = content_text(v, "$.content")
    inner = F.regexp_extract(raw, r"(?s)<USER_REQUEST>\n?(.*?)\n?</USER_REQUEST>", 1)
    wrapped = raw.rlike(r"(?s)<USER_REQUEST>.*?</USER_REQUEST>")
    content = F.nullif(F.when(user & wrapped, tx.strip(inner)).otherwise(raw), F.lit(""))
    sid = F.element_at(F.split("path", "/"), -4)
    m = _messages(rows.select(F.concat(F.lit("antigravity:"), sid).alias("conv_id"), "seq", F.when(user, "user").otherwise("assistant").alias("role"), content.alias("content"), parse_iso(field(v, "$.created_at")).alias("ts"), sid.alias("x_title")))
    return _threads(m, "antigravity", F.first("x_title")), m.drop("x_title")


def event_stream_jsonl(spark: SparkSession, path: str, base_times: DataFrame) -> Pair:
    """Streamed parts of one (turn, step) in a row are one message; times are offsets from the stream's anchor.

    base_times: session_id, base_time (timestamp)."""
    v = F.col("v")
    rows = lines(spark, path, "wire.jsonl").withColumn("v", F.try_parse_json("value")).withColumn("kind", field(v, "$.type"))
    rows = rows.withColumn("session_id", F.element_at(F.split("path", "/"), -2))
    anchor = rows.where("kind = 'metadata'").groupBy("session_id").agg(F.max_by(field(v, "$.created_at", "bigint"), "seq").alias("anchor"))
    user = F.when((F.col("kind") == "context.append_message") & (field(v, "$.message.role") == "user"), content_text(v, "$.message.content", None))
    part = F.when((F.col("kind") == "context.append_loop_event") & (field(v, "$.event.type") == "content.part") & (field(v, "$.event.part.type") == "text"), F.nullif(tx.strip(field(v, "$.event.part.text")), F.lit("")))
    rows = rows.withColumn("user", user).withColumn("part", part).where("user is not null or part is not null")
    rows = rows.join(anchor, "session_id", "left").join(base_times, "session_id", "left")
    offset = F.coalesce(field(v, "$.time", "bigint") - F.col("anchor"), F.lit(0))
    ts = F.timestamp_micros(F.unix_micros("base_time") + offset * 1000)
    # A user message is a run of its own.
    rows = rows.select("session_id", "seq", F.coalesce("user", "part").alias("text"), ts.alias("ts"), F.when(F.col("user").isNotNull(), "user").otherwise("assistant").alias("role"), F.when(F.col("user").isNotNull(), F.col("seq").cast("string")).otherwise(field(v, "$.event.turnId")).alias("turn"), field(v, "$.event.stepUuid").alias("step"))
    runs = coalesce_runs(rows, "session_id", "seq", ["role", "turn", "step"], "text").withColumnRenamed("first", "seq").join(rows.select("session_id", "seq", "ts"), ["session_id", "seq"])
    m = _messages(runs.select(F.concat(F.lit("kimi:"), F.col("session_id")).alias("conv_id"), "seq", "role", tx.strip(F.col("content")).alias("content"), "ts"))
    return _threads(m, "kimi", F.first(F.element_at(F.split("conv_id", ":", 2), -1))), m


def summary_sessions(spark: SparkSession, path: str) -> Pair:
    """Folders of summary.json and chat_history.jsonl; times are spread evenly between creation and update."""
    s = spark.read.text(path, wholetext=True, pathGlobFilter="summary.json", recursiveFileLookup=True).select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("dir"), F.try_parse_json("value").alias("s"))
    g = F.col("s")
    s = s.where("s is not null").select("dir", F.coalesce(field(g, "$.info.id"), F.element_at(F.split("dir", "/"), -1)).alias("sid"), parse_iso(field(g, "$.created_at")).alias("a"), parse_iso(F.coalesce(field(g, "$.updated_at"), field(g, "$.last_active_at"))).alias("z"), F.coalesce(F.nullif(field(g, "$.generated_title"), F.lit("")), F.nullif(field(g, "$.session_summary"), F.lit(""))).alias("title"), field(g, "$.current_model_id").alias("summary_model"))
    v = F.col("v")
    rows = lines(spark, path, "chat_history.jsonl", skip_blank_in_count=True).withColumn("v", F.try_parse_json("value")).withColumn("dir", F.regexp_replace("path", "/[^/]*$", "")).withColumn("kind", field(v, "$.type"))
    user = F.when(F.col("kind") == "user", F.nullif(tx.strip(F.regexp_extract(content_text(v, "$.content", None), r"(?s)<user_query>(.*?)</user_query>", 1)), F.lit("")))
    bot = F.when(F.col("kind") == "assistant", F.nullif(tx.strip(field(v, "$.content")), F.lit("")))
    rows = rows.withColumn("user", user).withColumn("bot", bot).where("user is not null or bot is not null").join(s, "dir")
    w = Window.partitionBy("sid")
    slot, n = F.row_number().over(w.orderBy("seq")) - 1, F.count(F.lit(1)).over(w)
    span = F.unix_micros("z") - F.unix_micros("a")
    ts = F.when((n > 1) & (span > 0), F.timestamp_micros((F.unix_micros("a") + F.floor(span * slot / (n - 1))).cast("long"))).otherwise(F.col("a"))
    rows = rows.withColumn("ts", ts)
    m = _messages(rows.select(F.concat(F.lit("grok:"), F.col("sid")).alias("conv_id"), "seq", F.when(F.col("user").isNotNull(), "user").otherwise("assistant").alias("role"), F.coalesce("user", "bot").alias("content"), "ts", F.substring(F.coalesce("title", "sid"), 1, 500).alias("x_title"), F.coalesce(field(v, "$.model_id"), "summary_model").alias("x_model")))
    return _threads(m, "grok", F.first("x_title"), {"model": F.max_by("x_model", F.when(F.col("x_model").isNotNull(), F.col("seq")))}), m.drop("x_title", "x_model")


def zip_entries(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, entry, n, value: each conversation in the matching JSON entries of ZIP files as its JSON.

    ZIP can't be split, so a file is one row; its entries leave the task one conversation at a time."""

    def run(batches):
        import io
        import json
        import re
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for entry in sorted(n for n in z.namelist() if re.fullmatch(pattern, n)):
                        for n, c in enumerate(json.loads(z.read(entry))):
                            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([entry]), pa.array([n], pa.int64()), pa.array([json.dumps(c)])], names=["path", "entry", "n", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, entry string, n long, value string")


def sharded_export(spark: SparkSession, path: str) -> Pair:
    """conversations-NNN.json shards in a ZIP: a mapping of nodes in order; times are epochs."""
    v = F.col("v")
    c = zip_entries(spark, path, r"conversations-\d+\.json").withColumn("v", F.parse_json("value"))
    c = c.withColumn("conv_id", F.coalesce(F.nullif(field(v, "$.conversation_id"), F.lit("")), field(v, "$.id"), F.lit("")))
    # The order of the mapping is that of its text, which a map type keeps.
    nodes = F.from_json(F.get_json_object("value", "$.mapping"), "map<string,string>")
    rows = c.select("conv_id", F.posexplode(F.map_entries(nodes)).alias("seq", "e")).withColumn("m", F.try_parse_json("e.value"))
    m = F.col("m")
    kind = F.coalesce(field(m, "$.message.content.content_type"), F.lit("text"))
    parts = F.filter(F.try_variant_get(m, "$.message.content.parts", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    content = F.when(kind == "text", F.array_join(F.transform(parts, lambda x: x.cast("string")), " ")).when(kind.isin("code", "tether_quote"), field(m, "$.message.content.text"))
    rows = rows.select("conv_id", "seq", field(m, "$.message.author.role").alias("role"), F.nullif(tx.strip(content), F.lit("")).alias("content"), from_epoch(field(m, "$.message.create_time", "double")).alias("ts"), F.coalesce(field(m, "$.message.id"), F.col("e.key")).alias("x_id")).where(F.col("role").isin("user", "assistant", "system", "tool"))
    msgs = _messages(rows).withColumn("msg_id", F.col("x_id")).drop("x_id")
    n = msgs.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("msg_count"))
    conv = c.select("conv_id", F.lit("chatgpt").alias("platform"), F.substring(F.coalesce(field(v, "$.title"), F.lit("")), 1, 500).alias("title"), from_epoch(field(v, "$.create_time", "double")).alias("started_at"), from_epoch(field(v, "$.update_time", "double")).alias("ended_at"), F.substring(F.coalesce(field(v, "$.default_model_slug"), F.lit("")), 1, 100).alias("model"))
    return conv.join(n, "conv_id", "left").fillna(0, ["msg_count"]), msgs


def web_export(spark: SparkSession, path: str) -> Pair:
    """conversations.json in a ZIP; the text of a message, or else its blocks."""
    v = F.col("v")
    c = zip_entries(spark, path, r"conversations\.json").withColumn("v", F.parse_json("value")).withColumn("conv_id", F.concat(F.lit("claude_ai:"), F.coalesce(field(v, "$.uuid"), F.lit(""))))
    rows = c.select("conv_id", F.posexplode(F.try_variant_get(v, "$.chat_messages", "array<variant>")).alias("seq", "m"))
    m = F.col("m")

    def block(b: Column) -> Column:
        kind = field(b, "$.type")
        return F.when(kind == "text", field(b, "$.text")).when(kind == "tool_use", F.concat(F.lit("[tool_use:"), F.coalesce(field(b, "$.name"), F.lit("")), F.lit("]"))).when(kind == "tool_result", F.lit("[tool_result]"))

    blocks = F.array_join(F.filter(F.transform(F.try_variant_get(m, "$.content", "array<variant>"), block), lambda x: x.isNotNull() & (x != "")), "\n")
    content = F.coalesce(F.nullif(tx.strip(field(m, "$.text")), F.lit("")), F.nullif(tx.strip(blocks), F.lit("")))
    role = F.when(field(m, "$.sender") == "human", "user").when(field(m, "$.sender") == "assistant", "assistant")
    rows = rows.select("conv_id", "seq", role.alias("role"), content.alias("content"), parse_iso(field(m, "$.created_at")).alias("ts"), field(m, "$.uuid").alias("x_id")).where("role is not null")
    msgs = _messages(rows)
    msgs = msgs.withColumn("msg_id", F.coalesce("x_id", F.concat_ws(":", "conv_id", F.col("seq").cast("string")))).drop("x_id")
    n = msgs.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("msg_count"))
    conv = c.select("conv_id", F.lit("claude_ai").alias("platform"), F.substring(F.coalesce(field(v, "$.name"), F.lit("")), 1, 500).alias("title"), parse_iso(field(v, "$.created_at")).alias("started_at"), parse_iso(field(v, "$.updated_at")).alias("ended_at"))
    return conv.join(n, "conv_id", "left").fillna(0, ["msg_count"]), msgs


#: Readers by platform; others may be added.
REGISTRY: dict[str, Callable[..., Pair]] = {"claude-code": session_jsonl, "chatgpt": sharded_export, "claude-ai": web_export, "codex": history_jsonl, "antigravity": transcript_jsonl, "kimi": event_stream_jsonl, "grok": summary_sessions}


def register(name: str, reader: Callable[..., Pair]) -> None:
    REGISTRY[name] = reader

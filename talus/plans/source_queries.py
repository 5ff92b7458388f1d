"""Readers and sinks over files that Spark writes from the given tables: session logs, exports, vaults, logs, source trees, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import text as tx
from talus.operators import chunks, fusion
from talus.scratch import fresh, retire
from talus.sources import files, growing, sessions
from talus.streaming import incremental as inc, keyed

from . import bindings as b
from .registry import query
from .text_queries import _PATHS, _scrub_sql

_TEXT = _scrub_sql(r"regexp_replace(text, '^\s+|\s+$', '', 'g')")
_TURNS = f"turns AS MATERIALIZED (SELECT conv_id, turn, role, {_TEXT} AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line FROM conversations WHERE text IS NOT NULL AND role IN ('user', 'assistant'))"


def _turns(spark, d):
    return b.read(spark, d, "conversations").where("text is not null and role in ('user', 'assistant')")


def _put(spark, rows, what):
    """Files of (path, content) in a new scratch folder, which goes when scratch is swept."""
    base = fresh(spark, what)
    files.write_files(rows, base)
    retire(spark, base)
    return base


def _lines(rows, path, line, order=("turn",), head=None):
    """One file for each path with its lines in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"])
    body = F.array_join(listed, "\n")
    return rows.groupBy(path.alias("path")).agg((body if head is None else F.concat(head, F.lit("\n"), body)).alias("content"))


def _sid(n="conv_id"):
    return F.col(n).cast("string")


def _iso():
    return F.date_format(F.timestamp_seconds(F.lit(1_767_225_600) + F.col("conv_id") * 3600 + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _shown(messages):
    return messages.select("conv_id", F.col("seq").cast("long").alias("seq"), "role", F.md5(F.col("content").cast("binary")).alias("digest"))


def _session_logs(spark, d):
    line = F.to_json(F.struct(F.col("role").alias("type"), _iso().alias("timestamp"), F.concat(F.lit("/w/p"), (F.col("conv_id") % 5).cast("string")).alias("cwd"), F.struct(F.col("text").alias("content")).alias("message")))
    return _put(spark, _lines(_turns(spark, d), F.concat(F.lit("projects/-home-me-p/"), _sid(), F.lit(".jsonl")), line), "session-logs")


@query(f"WITH {_TURNS} SELECT 'claude_code:' || conv_id AS conv_id, line AS seq, role, md5(content) AS digest FROM turns WHERE content <> ''")
def session_log_messages(spark, d):
    return _shown(sessions.REGISTRY["claude-code"](spark, _session_logs(spark, d))[1])


@query(f"WITH {_TURNS} SELECT 'claude_code:' || conv_id AS conv_id, 'home/me/p' AS title, CAST(count(*) AS INT) AS msg_count, 1767225600 + conv_id * 3600 + min(turn) * 60 AS started FROM turns WHERE content <> '' GROUP BY conv_id")
def session_log_threads(spark, d):
    return sessions.session_jsonl(spark, _session_logs(spark, d))[0].select("conv_id", "title", "msg_count", F.unix_seconds("started_at").alias("started"))


@query("SELECT DISTINCT CAST(conv_id AS VARCHAR) AS conv_id, '/w/p' || (conv_id % 5) AS cwd FROM conversations WHERE text IS NOT NULL AND role IN ('user', 'assistant')")
def session_log_folders(spark, d):
    """The working folder in the head of each log; its first line here."""
    found = sessions.header_cwd(spark, _session_logs(spark, d))
    return found.select(F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("conv_id"), "cwd")


@query("""WITH r AS (SELECT conv_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2, text) - 1 AS seq FROM conversations WHERE text IS NOT NULL AND role IN ('user', 'assistant'))
SELECT 'codex:' || conv_id AS conv_id, seq, 'user' AS role, md5({x}) AS digest FROM r WHERE x NOT IN ('', 'exit', 'quit')""".replace("\\\\", "\\").replace("{x}", _scrub_sql("x")))
def history_log_messages(spark, d):
    """Flat histories whose rows are put in order by time and text."""
    line = F.to_json(F.struct(_sid().alias("session_id"), F.expr("turn div 2").alias("ts"), "text"))
    rows = _turns(spark, d)
    return _shown(sessions.history_jsonl(spark, _put(spark, _lines(rows, F.concat(F.lit("history-"), (F.col("conv_id") % 4).cast("string"), F.lit(".jsonl")), line, ("conv_id", "turn")), "history-logs"))[1])


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, '/w/' || (conv_id % 9) AS cwd FROM (SELECT DISTINCT conv_id FROM conversations)")
def rollout_folders(spark, d):
    first = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(_sid().alias("id"), F.concat(F.lit("/w/"), (F.col("conv_id") % 9).cast("string")).alias("cwd")).alias("payload")))
    rows = b.read(spark, d, "conversations").select("conv_id").distinct().select(F.concat(F.lit("rollout-"), _sid(), F.lit(".jsonl")).alias("path"), F.concat(first, F.lit('\n{"type":"session_meta","payload":{"id":"other","cwd":"/no"}}\n')).alias("content"))
    return sessions.rollout_cwd(spark, _put(spark, rows, "rollouts"))


@query(f"WITH {_TURNS} SELECT 'antigravity:' || conv_id AS conv_id, line AS seq, role, md5(content) AS digest FROM turns WHERE content <> ''")
def transcript_log_messages(spark, d):
    user = F.col("role") == "user"
    content = F.when(user, F.concat(F.lit("<USER_REQUEST>\n"), "text", F.lit("\n</USER_REQUEST> and so on"))).otherwise(F.col("text"))
    line = F.to_json(F.struct(F.when(user, "USER_INPUT").otherwise("PLANNER_RESPONSE").alias("type"), _iso().alias("created_at"), content.alias("content")))
    return _shown(sessions.transcript_jsonl(spark, _put(spark, _lines(_turns(spark, d), F.concat(_sid(), F.lit("/.system_generated/logs/transcript.jsonl")), line), "transcripts"))[1])


@query(rf"""WITH parts AS (SELECT conv_id, turn, role, unnest(l) AS x, unnest(range(0, len(l))) AS n FROM (SELECT *, CASE WHEN role = 'user' THEN [text] ELSE string_split(text, chr(10)) END AS l FROM conversations WHERE text IS NOT NULL AND role IN ('user', 'assistant'))),
m AS (SELECT conv_id, turn, role, regexp_replace(string_agg(regexp_replace(x, '^\s+|\s+$', '', 'g'), chr(10) ORDER BY n) FILTER (WHERE regexp_replace(x, '^\s+|\s+$', '', 'g') <> ''), '^\s+|\s+$', '', 'g') AS content FROM parts GROUP BY ALL)
SELECT 'kimi:' || conv_id AS conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, role, md5({_scrub_sql('content')}) AS digest FROM m WHERE content <> ''""")
def event_stream_messages(spark, d):
    """Streams whose answers come line by line and are put together again."""
    user = F.col("role") == "user"
    t = _turns(spark, d).select("conv_id", "turn", "role", F.posexplode(F.when(user, F.array("text")).otherwise(F.split("text", "\n"))).alias("n", "x"))
    time = F.lit(1000) + F.col("turn") * 1000 + F.col("n")
    asked = F.to_json(F.struct(F.lit("context.append_message").alias("type"), time.alias("time"), F.struct("role", F.col("x").alias("content")).alias("message")))
    told = F.to_json(F.struct(F.lit("context.append_loop_event").alias("type"), time.alias("time"), F.struct(F.lit("content.part").alias("type"), F.col("turn").cast("string").alias("turnId"), F.lit("s").alias("stepUuid"), F.struct(F.lit("text").alias("type"), F.col("x").alias("text")).alias("part")).alias("event")))
    rows = _lines(t, F.concat(_sid(), F.lit("/wire.jsonl")), F.when(user, asked).otherwise(told), ("turn", "n"), F.lit('{"type":"metadata","created_at":1000}'))
    start = b.read(spark, d, "conversations").select(_sid().alias("session_id"), F.timestamp_seconds(F.lit(1_767_225_600)).alias("base_time")).distinct()
    m = sessions.event_stream_jsonl(spark, _put(spark, rows, "streams"), start)[1]
    from pyspark.sql import Window

    return m.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("seq")).cast("long").alias("place"), "role", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(f"""WITH {_TURNS}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY line) - 1 AS slot, count(*) OVER (PARTITION BY conv_id) AS n FROM turns WHERE content <> '')
SELECT 'grok:' || conv_id AS conv_id, line AS seq, role, md5(content) AS digest, 1767225600 + CASE WHEN n > 1 THEN CAST(floor(3600000000 * slot / (n - 1)) AS BIGINT) // 1000000 ELSE 0 END AS at FROM k""")
def summary_log_messages(spark, d):
    """Folders with a summary; times are spread over the hour between creation and update."""
    user = F.col("role") == "user"
    line = F.to_json(F.struct(F.col("role").alias("type"), F.when(user, F.concat(F.lit("<user_query>"), "text", F.lit("</user_query>"))).otherwise(F.col("text")).alias("content")))
    t = _turns(spark, d)
    logs = _lines(t, F.concat(_sid(), F.lit("/chat_history.jsonl")), line)
    info = F.to_json(F.struct(F.struct(_sid().alias("id")).alias("info"), F.lit("2026-01-01T00:00:00Z").alias("created_at"), F.lit("2026-01-01T01:00:00Z").alias("updated_at"), F.lit("T").alias("generated_title")))
    rows = logs.union(t.select("conv_id").distinct().select(F.concat(_sid(), F.lit("/summary.json")).alias("path"), info.alias("content")))
    m = sessions.summary_sessions(spark, _put(spark, rows, "summaries"))[1]
    return _shown(m).join(m.select("conv_id", F.col("seq").cast("long").alias("seq"), F.unix_seconds("ts").alias("at")), ["conv_id", "seq"])


def _zipped(rows, entry):
    """(path, items array of JSON) to (path, content): a ZIP with one JSON entry, made in the task."""

    def run(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            out = []
            for items in batch.column(1).to_pylist():
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(entry, "[" + ",".join(items) + "]")
                out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    return rows.select("path", "items").mapInArrow(run, "path string, content binary")


@query(f"WITH {_TURNS} SELECT CAST(conv_id AS VARCHAR) AS conv_id, line AS seq, role, md5(content) AS digest FROM turns WHERE content <> ''")
def sharded_export_messages(spark, d):
    node = F.struct(F.lpad(F.col("turn").cast("string"), 6, "0").alias("k"), F.struct(F.struct(F.struct("role").alias("author"), F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts")).alias("content"), F.concat_ws("-", _sid(), F.col("turn").cast("string")).alias("id")).alias("message")).alias("v"))
    c = _turns(spark, d).groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(node))).alias("mapping"))
    one = F.to_json(F.struct(_sid().alias("conversation_id"), F.lit("T").alias("title"), "mapping"))
    z = c.groupBy((F.col("conv_id") % 7).alias("shard")).agg(F.collect_list(one).alias("items")).withColumn("path", F.concat(F.lit("export-"), F.col("shard").cast("string"), F.lit(".zip")))
    return _shown(sessions.sharded_export(spark, _put(spark, _zipped(z, "conversations-001.json"), "sharded-exports"))[1])


@query(f"WITH {_TURNS} SELECT 'claude_ai:' || conv_id AS conv_id, line AS seq, role, md5(content) AS digest FROM turns WHERE content <> ''")
def web_export_messages(spark, d):
    m = F.struct("turn", F.struct(F.when(F.col("role") == "user", "human").otherwise("assistant").alias("sender"), "text", F.concat_ws("-", _sid(), F.col("turn").cast("string")).alias("uuid")).alias("m"))
    c = _turns(spark, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(m)), lambda x: x["m"]).alias("chat_messages"))
    one = F.to_json(F.struct(_sid().alias("uuid"), F.lit("N").alias("name"), "chat_messages"))
    z = c.groupBy((F.col("conv_id") % 7).alias("shard")).agg(F.collect_list(one).alias("items")).withColumn("path", F.concat(F.lit("web-"), F.col("shard").cast("string"), F.lit(".zip")))
    return _shown(sessions.web_export(spark, _put(spark, _zipped(z, "conversations.json"), "web-exports"))[1])


@query(r"""SELECT 'note' || doc_id AS stem, lang, 'N ' || doc_id AS name, md5(text) AS digest, 's' || source AS inner, CAST(doc_id % 3 AS INT) AS n_tags, replace(coalesce(n.line, ''), chr(9), ' ') AS summary
FROM documents, LATERAL (SELECT trim(split_part(text, chr(10), 1)) AS line) n WHERE text IS NOT NULL AND lang IS NOT NULL""")
def vault_notes(spark, d):
    """Notes with nested front matter: quoted and repeated keys, maps, lists and a block of the text's first line."""
    x = b.read(spark, d, "documents").where("text is not null and lang is not null")
    line = F.replace(F.trim(F.split_part("text", F.lit("\n"), F.lit(1))), F.lit("\t"), F.lit(" "))
    tags = F.when(F.col("doc_id") % 3 == 0, "tags: []\n").when(F.col("doc_id") % 3 == 1, "tags: [one]\n").otherwise("tags:\n- one\n- 'two # x'\n")
    head = F.concat(F.lit("---\nlang: "), "lang", F.lit("\nname: 'N "), _sid("doc_id"), F.lit("'\nlang: zz\nmeta:\n  deep:\n    inner: s"), "source", F.lit("\n"), tags, F.lit("summary: |-\n  "), line, F.lit("\n---\n"))
    rows = x.select(F.concat(F.lit("vault/"), (F.col("doc_id") % 20).cast("string"), F.lit("/note"), _sid("doc_id"), F.lit(".md")).alias("path"), F.concat(head, "text").alias("content"))
    v = files.vault(spark, _put(spark, rows, "vault"))
    tags = F.size(F.from_json(F.get_json_object("front_json", "$.tags"), "array<string>"))
    return v.select("stem", F.col("front")["lang"].alias("lang"), F.col("front")["name"].alias("name"), F.md5(F.col("body").cast("binary")).alias("digest"), F.get_json_object("front_json", "$.meta.deep.inner").alias("inner"), tags.alias("n_tags"), F.coalesce(F.col("front")["summary"], F.lit("")).alias("summary"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_id % 4 <> 3 GROUP BY event_type")
def rotated_log_totals(spark, d):
    """A log in three generations with broken lines; a fourth is out of reach."""
    e = b.read(spark, d, "events")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    name = F.concat(F.lit("calls.jsonl"), F.element_at(F.array(F.lit(""), F.lit(".1"), F.lit(".2"), F.lit(".7")), (F.col("event_id") % 4 + 1).cast("int")))
    rows = _lines(e, name, F.when(F.col("event_id") % 50 == 0, F.concat(line, F.lit('\n{"event_id": broken'))).otherwise(line), ("event_id",))
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    log = files.rotated_log(spark, _put(spark, rows, "rotated"), "calls.jsonl", schema)
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


_TREE = "SELECT page_id, replace([" + ", ".join(f"'{x}'" for x in _PATHS) + f"][page_id % {len(_PATHS)} + 1], '{{0}}', CAST(page_id AS VARCHAR)) AS path FROM pages WHERE page_id % {len(_PATHS)} <> 9"


@query(rf"SELECT path, CAST(4 AS BIGINT) AS n_lines FROM ({_TREE}) WHERE page_id % 10 IN (0, 4) AND page_id % 7 <> 0")
def source_tree_files(spark, d):
    """Source files that the index takes: by path, and without secrets in them."""
    r = F.col("page_id")
    x = b.read(spark, d, "pages").where(r % len(_PATHS) != 9)
    path = F.replace(F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (r % len(_PATHS) + 1).cast("int")), F.lit("{0}"), r.cast("string"))
    body = F.concat(F.lit("def f():\n    a = 1\n    return a\n"), F.when(r % 7 == 0, F.lit("k = 'AKIA" + "A1B2C3D4E5F6G7H8'")).otherwise("# end"))
    found = files.source_files(spark, _put(spark, x.select(path.alias("path"), body.alias("content")), "tree"))
    return found.where(~files.is_secret(F.col("content"))).select("path", F.size(F.split("content", "\n")).cast("long").alias("n_lines"))


@query("""SELECT source AS repo, 'src/' || CASE WHEN doc_id % 5 = 0 THEN 'données/' ELSE '' END || 'a' || doc_id || '.py' AS path, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size
FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND source IS NOT NULL""")
def tracked_files(spark, d):
    """The tracked files of one repository a source: links, submodules and paths that lead out of it aren't among them."""
    r = F.col("doc_id")
    name = F.concat(F.lit("src/"), F.when(r % 5 == 0, "données/").otherwise(""), F.lit("a"), r.cast("string"), F.lit(".py"))
    path = F.when(r % 11 == 0, F.concat(F.lit("src/../../b"), r.cast("string"))).otherwise(name).cast("binary")
    mode = F.when(r % 7 == 0, "A000").when(r % 13 == 0, "E000").otherwise("81A4")
    x = b.read(spark, d, "documents").where("source is not null").select("source", path.alias("path"), mode.alias("mode"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    zeros = lambda n: F.lit("00" * n)
    length = F.octet_length("path")
    fixed = F.concat(zeros(26), "mode", zeros(8), F.lpad(F.hex("size"), 8, "0"), zeros(20), F.lpad(F.hex(F.least(length, F.lit(4095))), 4, "0"))
    entry = F.concat(fixed, F.hex("path"), F.repeat(F.lit("00"), 8 - (62 + length) % 8))
    index = x.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", entry.alias("e")))), lambda y: y["e"]), "").alias("body"))
    content = F.unhex(F.concat(F.hex(F.lit("DIRC")), F.lit("00000002"), F.lpad(F.hex("n"), 8, "0"), "body"))
    at = _put(spark, index.select(F.concat("source", F.lit("/.git/index")).alias("path"), content.alias("content")), "repositories")
    out = files.tracked_files(spark, f"{at}/*")
    return out.select(F.regexp_extract("root", "([^/]+)$", 1).alias("repo"), "path", "size")


def _sources(spark, d):
    """(path, content): each document as a page with a script, a shell script and a Python file that hold its text."""
    r, t = F.col("doc_id").cast("string"), F.regexp_replace(F.coalesce("text", F.lit("")), "[`'\"\\\\\r]", "_")
    js = F.concat(F.lit("<p>"), t, F.lit("</p>\n<script>\nfunction outer"), r, F.lit("(a) {\n  // "), F.regexp_replace(t, "\n", "\n  // "), F.lit("\n  const inner = (x) => {\n    `"), t, F.lit("{`;\n    return '}'\n  }\n}\n</script>\n"))
    sh = F.concat(F.lit("# {\nf"), r, F.lit("() {\n  cat <<'EOF'\n"), t, F.lit('\nEOF\n  echo "}" ${x}\n}\n'))
    py = F.concat(F.lit('class K:\n    """'), t, F.lit('"""\n    x = 1\n\n    def m'), r, F.lit("(self):\n        s = '''"), t, F.lit("'''\n        return s\n\n\ndef g():\n    return 1\n"))
    docs = b.read(spark, d, "documents")
    one = lambda ext, code: docs.select(F.concat(F.lit("src/"), r, F.lit(f".{ext}")).alias("path"), code.alias("content"))
    return one("html", js).union(one("sh", sh)).union(one("py", py))


@query(r"""WITH t AS (SELECT doc_id, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS INT) AS n FROM documents)
SELECT 'src/' || doc_id || '.html' AS path, 'outer' || doc_id AS symbol, 'script_fn' AS kind, n + 3 AS start_line, 3 * n + 9 AS end_line FROM t
UNION ALL SELECT 'src/' || doc_id || '.html', 'outer' || doc_id || '.inner', 'script_fn', 2 * n + 5, 3 * n + 8 FROM t
UNION ALL SELECT 'src/' || doc_id || '.sh', 'f' || doc_id, 'function', 2, n + 7 FROM t UNION ALL SELECT 'src/' || doc_id || '.py', 'K', 'class', 1, n + 2 FROM t
UNION ALL SELECT 'src/' || doc_id || '.py', 'K.m' || doc_id, 'method', n + 5, 2 * n + 7 FROM t WHERE n > 0""")
def source_code_chunks(spark, d):
    """Functions of four lines or more, and heads of classes, of scripts within pages, shell scripts and Python files."""
    return chunks.chunks(_sources(spark, d), files.MIN_LINES, files.MAX_CHARS).select("path", "symbol", "kind", "start_line", "end_line")


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[`''"\\\r]', '_', 'g') AS x FROM documents)
SELECT doc_id, md5('f' || doc_id || '() {' || chr(10) || '  cat <<''EOF''' || chr(10) || x || chr(10) || 'EOF' || chr(10) || '  echo "}" ${x}' || chr(10) || '}') AS body FROM t""")
def symbol_bodies(spark, d):
    """The body of a function that is asked for by its last name."""
    shell = _sources(spark, d).where("path like '%.sh'")
    r = F.col("doc_id").cast("string")
    wanted = b.read(spark, d, "documents").select(F.concat(F.lit("src/"), r, F.lit(".sh")).alias("path"), F.concat(F.lit("lib.f"), r).alias("wanted"))
    out = chunks.symbol_bodies(shell, wanted)
    return out.select(F.regexp_extract("path", r"(\d+)\.sh$", 1).cast("long").alias("doc_id"), F.md5(F.col("content").cast("binary")).alias("body"))


@query("SELECT CASE WHEN event_id % 13 = 0 THEN 'none' ELSE strftime(ts, '%Y-%m') END AS ym, count(*) AS n FROM events GROUP BY ALL")
def monthly_log(spark, d):
    """A log in month folders, appended in two steps, with a folder for rows without a time."""
    e = b.read(spark, d, "events").withColumn("at", F.when(F.col("event_id") % 13 != 0, F.col("ts")))
    out = fresh(spark, "monthly")
    retire(spark, out)
    for half in (0, 1):
        files.write_monthly(e.where(F.col("event_id") % 2 == half), "at", out)
    return spark.read.parquet(out).groupBy(F.col("ym").cast("string").alias("ym")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def appended_log(spark, d):
    e = b.read(spark, d, "events").select("event_id", "event_type")
    out = fresh(spark, "appended")
    retire(spark, out)
    for half in (0, 1):
        files.append_jsonl(e.where(F.col("event_id") % 2 == half), out)
    return spark.read.schema(e.schema).json(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT conv_id, turn, role || ' ' || replace(replace(coalesce(text, ''), chr(10), ' '), chr(13), ' ') AS line FROM conversations)
SELECT conv_id, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, md5(line) AS digest FROM l""")
def appended_lines(spark, d):
    """A stream over logs that grow: it reads their first half, up to the last whole line, and then only what was appended."""
    line = F.concat("role", F.lit(" "), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\n\r]", " "), F.lit("\n"))
    rows = b.read(spark, d, "conversations").select("conv_id", "turn", line.alias("line")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "").alias("content"))
    path = F.concat(F.col("conv_id").cast("string"), F.lit(".jsonl"))
    src, out, cp = (fresh(spark, x) for x in ("growing-in", "growing-out", "growing-checkpoint"))
    retire(spark, src, out, cp)
    growing.register(spark)
    stream = spark.readStream.format("talus_lines").load(src)
    for content in (F.substring("content", F.lit(1), (F.length("content") / 2).cast("int")), F.col("content")):
        files.write_files(rows.select(path.alias("path"), content.alias("content")), src)
        got = inc.run_to_end(stream, out, cp)
    return got.select(F.regexp_extract("path", r"(\d+)\.jsonl$", 1).cast("long").alias("conv_id"), "start", F.md5(F.col("value").cast("binary")).alias("digest"))


@query("SELECT conv_id, turn, role, 'first' AS origin FROM conversations WHERE turn < 4 UNION ALL SELECT conv_id, turn, role, 'second' FROM conversations WHERE turn >= 4")
def ingested_messages(spark, d):
    """A stream of two files, the second of which repeats the first: every key is inserted once, by the batch that brings it first."""
    m = b.read(spark, d, "conversations").select("conv_id", "turn", "role")
    src, out, cp = (fresh(spark, x) for x in ("ingest-in", "ingest-out", "ingest-checkpoint"))
    retire(spark, src, out, cp)
    first, second = m.where("turn < 4").withColumn("origin", F.lit("first")), m.withColumn("origin", F.lit("second"))
    for n, part in enumerate((first, second)):
        part.coalesce(1).write.parquet(f"{src}/{n}")
        inc.ingest_messages(inc.file_stream(spark, f"{src}/*", part.schema), out, cp, ["conv_id", "turn"]).awaitTermination()
    return inc.ingested(spark, out)


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS rn FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)),
f AS (SELECT user_id, event_id, rn, true AS allowed, [s] AS held FROM e WHERE rn = 1 UNION ALL
SELECT user_id, event_id, rn, len(now) < 3, CASE WHEN len(now) < 3 THEN list_append(now, s) ELSE now END FROM (SELECT e.*, list_filter(f.held, lambda h: h >= e.s - 86400) AS now FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
SELECT user_id, event_id AS call, allowed FROM f""")
def streamed_budget(spark, d):
    """The read budget as a stream with state."""
    e = b.read(spark, d, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long").alias("at"), F.col("event_id").alias("call"))
    src, out, cp = (fresh(spark, x) for x in ("budget-in", "budget-out", "budget-checkpoint"))
    retire(spark, src, out, cp)
    e.write.parquet(src)
    return inc.run_to_end(keyed.read_budget(inc.file_stream(spark, src, e.schema), "user_id", "at", 86400, 3), out, cp)


@query("""SELECT user_id, date_trunc('millisecond', last) AS last_seen, date_trunc('millisecond', last) + INTERVAL 6 HOUR AS stale_at FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id)
WHERE date_trunc('millisecond', last) + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events)""")
def streamed_silence(spark, d):
    """Users whose last event the stream has passed by six hours, told by timers."""
    e = b.read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    src, out, cp = (fresh(spark, x) for x in ("silence-in", "silence-out", "silence-checkpoint"))
    retire(spark, src, out, cp)
    e.write.parquet(src)
    return inc.run_to_end(keyed.silent_sources(inc.file_stream(spark, src, e.schema), "user_id", "ts", 6 * 3600), out, cp)


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events")
def streamed_dedupe(spark, d):
    """A stream that brings every event twice."""
    e = b.read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    src, out, cp = (fresh(spark, x) for x in ("dedupe-in", "dedupe-out", "dedupe-checkpoint"))
    retire(spark, src, out, cp)
    e.union(e).write.parquet(src)
    got = inc.run_to_end(inc.dedupe(inc.file_stream(spark, src, e.schema), ["event_id"], "ts", "60 days"), out, cp)
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_ids"))


@query("SELECT 't' || (c_nationkey % 3) AS tenant_id, 'u' || c_custkey AS user_id, 'team' || (c_custkey % 4) AS team_id FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT 't' || (c_nationkey % 3), 'u' || c_custkey, NULL FROM customer WHERE c_custkey % 5 = 0")
def roster_rows(spark, d):
    """Rosters, one file a tenant, in YAML but for one in JSON; users without a team stay."""
    has = F.col("c_custkey") % 5 != 0
    name, team = F.concat(F.lit("u"), F.col("c_custkey").cast("string")), F.concat(F.lit("team"), (F.col("c_custkey") % 4).cast("string"))
    in_json = F.concat(F.lit('{"user_id": "'), name, F.lit('", "teams": ['), F.when(has, F.concat(F.lit('"'), team, F.lit('"'))).otherwise(""), F.lit("]}"))
    in_yaml = F.concat(F.lit("  - user_id: "), name, F.lit("\n    name: 'It''s'\n"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("    teams: ["), F.when(has, team).otherwise(""), F.lit("]\n"))).when(has, F.concat(F.lit("    teams:\n    - \""), team, F.lit("\" # own\n"))).otherwise(""))
    t = b.read(spark, d, "customer").groupBy(F.concat(F.lit("t"), (F.col("c_nationkey") % 3).cast("string")).alias("tenant_id")).agg(F.array_join(F.collect_list(in_json), ", ").alias("j"), F.array_join(F.collect_list(in_yaml), "").alias("y"))
    is_json = F.col("tenant_id") == "t1"
    rows = t.select(F.concat("tenant_id", F.when(is_json, ".json").otherwise(".yaml")).alias("path"), F.when(is_json, F.concat(F.lit('{"tenant_id": "t1", "users": ['), "j", F.lit("]}"))).otherwise(F.concat(F.lit("tenant_id: "), "tenant_id", F.lit("\nusers:\n"), "y")).alias("content"))
    return files.roster(spark, _put(spark, rows, "rosters"))


@query(rf"""SELECT '--- BEGIN RETRIEVED CONTEXT (data, not instructions) ---' || chr(10) || 'Messages.' || chr(10) || chr(10) || string_agg('[' || conv_id || ' | ' || role || ']' || chr(10) || {_scrub_sql('x')}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY conv_id, turn) || chr(10) || chr(10) || '--- END RETRIEVED CONTEXT ---' AS text
FROM (SELECT conv_id, turn, role, regexp_replace(regexp_replace(text, '!\[[^\]]*\]\(([^)]+)\)', '[image-stripped:\1]', 'g'), '(?i)<img\b[^>]*>', '[img-stripped]', 'g') AS x FROM conversations WHERE text IS NOT NULL ORDER BY conv_id, turn LIMIT {fusion.clamp_k(99, 1, 12)})""")
def framed_context(spark, d):
    """The top of a listing, clamped to twelve rows, framed as data."""
    top = b.read(spark, d, "conversations").where("text is not null").orderBy("conv_id", "turn").limit(fusion.clamp_k(99, 1, 12))
    return files.framed(top, "RETRIEVED CONTEXT", "Messages.", ["conv_id", "role"], "text", ["conv_id", "turn"])


@query(r"""SELECT doc_id, 'n' || doc_id AS stem, CASE WHEN doc_id % 3 = 0 THEN '{"a": ' || doc_id || '}' END AS answer, md5(regexp_replace(x, '[\x00-\x1f\x7f]', '', 'g')) AS digest FROM (SELECT doc_id, coalesce(text, '') || chr(7) || chr(9) AS x FROM documents)""")
def text_helpers(spark, d):
    """File stems, JSON in a model's answer, and control characters."""
    r = F.col("doc_id").cast("string")
    stem = tx.file_stem(F.concat(F.lit("/v/a/n"), r, F.lit(".md")))
    answer = tx.json_object(F.concat(F.lit("Sure:\n```json\n"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"a": '), r, F.lit("}"))).otherwise("none"), F.lit("\n```")))
    return b.read(spark, d, "documents").select("doc_id", stem.alias("stem"), answer.alias("answer"), F.md5(tx.strip_controls(F.concat(F.coalesce("text", F.lit("")), F.lit("\x07\t"))).cast("binary")).alias("digest"))

"""Threads: recency, excerpts, sampling, segments, transcripts, sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talus.functions import text as tx
from talus.functions.times import local_day
from talus.operators import access, threads as th

from . import bindings as b
from .registry import query
from .search_queries import ACL, ME

_ACTIVE = "coalesce(t.ended_at, m.last, t.started_at)"
_RECENT = f"""WITH m AS (SELECT conv_id, max(ts) AS last, arg_min(content, (seq, ts)) AS first_msg FROM messages GROUP BY conv_id)
SELECT t.conv_id, t.title, CAST({_ACTIVE} AS VARCHAR) AS active_at, left(m.first_msg, 60) AS first_msg FROM threads t LEFT JOIN m USING (conv_id) WHERE {{0}} {_ACTIVE} >= {{1}} ORDER BY {_ACTIVE} DESC, conv_id LIMIT {{2}}"""


def _recent(spark, d, days, limit, where=None):
    out = th.recent(b.threads(spark, d), b.messages(spark, d), F.lit("2024-01-04 00:00:00").cast("timestamp_ntz"), days, limit, where)
    return out.select("conv_id", "title", F.col("active_at").cast("string").alias("active_at"), F.substring("first_msg", 1, 60).alias("first_msg"))


@query(b.sql(_RECENT.format("", "TIMESTAMP '2024-01-02 00:00:00'", 30), "threads"))
def recent_conversations(spark, d):
    return _recent(spark, d, 2, 30)


@query(b.sql(_RECENT.format("t.platform = 'chatgpt' AND t.title ILIKE '%th%' AND", "TIMESTAMP '2023-12-21 00:00:00'", 50), "threads"))
def project_conversations(spark, d):
    return _recent(spark, d, 14, 50, (F.col("platform") == "chatgpt") & F.col("title").ilike("%th%"))


@query(b.sql("SELECT seq, role, content FROM messages WHERE conv_id = 3 ORDER BY seq, ts", "messages"))
def thread_full(spark, d):
    return b.messages(spark, d).where("conv_id = 3").orderBy("seq", "ts").select("seq", "role", "content")


@query(b.sql("""SELECT conv_id, seq, role, rn <= 2 AS head FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq, ts) AS rn, row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC, ts DESC) AS rb FROM messages) WHERE rn <= 2 OR rb <= 2""", "messages"))
def thread_head_tail(spark, d):
    return th.head_tail(b.messages(spark, d), 2).select("conv_id", "seq", "role", (F.col("rn") <= 2).alias("head"))


@query(b.sql("SELECT platform || ':' || conv_id AS conv_id, title FROM threads WHERE (platform || ':' || conv_id) LIKE '%:7'", "threads"))
def resolve_bare_id(spark, d):
    t = b.threads(spark, d).withColumn("conv_id", F.concat_ws(":", "platform", F.col("conv_id").cast("string")))
    return th.resolve_suffix(t, "7").select("conv_id", "title")


@query(b.sql("SELECT conv_id, title, shared FROM (SELECT conv_id, title, visibility AS shared, started_at FROM threads WHERE tenant_id = 't1' AND owner_user_id = 'u1' AND visibility <> 'private') ORDER BY started_at DESC NULLS LAST, conv_id LIMIT 40", "threads"))
def shared_list(spark, d):
    t = b.threads(spark, d).where(access.owns(ME) & (F.col("visibility") != "private"))
    return t.orderBy(F.col("started_at").desc_nulls_last(), "conv_id").limit(40).select("conv_id", "title", F.col("visibility").alias("shared"))


@query(b.sql(f"SELECT conv_id FROM threads c WHERE {ACL}", "threads"))
def readable_threads(spark, d):
    return b.threads(spark, d).where(access.can_read(ME)).select("conv_id")


@query(b.sql("""SELECT conv_id, CAST(CAST(coalesce(ended_at, started_at) + to_hours(9) AS DATE) AS VARCHAR) AS day FROM threads WHERE msg_count > 1 AND platform IN ('claude_code', 'codex') AND CAST(coalesce(ended_at, started_at) + to_hours(9) AS DATE) = DATE '2024-01-02'""", "threads"))
def day_conversations_tz(spark, d):
    t = b.threads(spark, d).where("msg_count > 1").where(F.col("platform").isin("claude_code", "codex")).withColumn("day", local_day(F.coalesce("ended_at", "started_at")))
    return t.where(F.col("day") == F.lit("2024-01-02").cast("date")).select("conv_id", F.col("day").cast("string").alias("day"))


_PROSE = "content IS NOT NULL AND NOT starts_with(content, '[tool_result') AND length(content) >= 20"
_SAMPLED = f"""p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM messages WHERE {_PROSE}),
s AS (SELECT * FROM p WHERE n <= 3 OR pos IN (0, CAST(floor(n / 3.0) AS BIGINT), CAST(floor(2 * n / 3.0) AS BIGINT)))"""


@query(b.sql(f"WITH {_SAMPLED} SELECT conv_id, seq FROM s", "messages"))
def uniform_sample(spark, d):
    return th.sample_uniform(th.prose(b.messages(spark, d)), "conv_id", ["seq"], 3).select("conv_id", "seq")


@query(b.sql(f"WITH {_SAMPLED} SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '[USER] ' ELSE '[AI] ' END || x, chr(10) || chr(10) ORDER BY seq) AS transcript, count(*) AS n_lines FROM (SELECT *, substr(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), 1, 120) AS x FROM s) WHERE length(x) >= 20 GROUP BY conv_id", "messages"))
def sampled_transcript(spark, d):
    return th.transcripts(b.messages(spark, d), 3, 120)


@query(b.sql(f"SELECT conv_id, seg_idx, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS n FROM (SELECT conv_id, seq, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY seq) - 1) // 5 AS INT) AS seg_idx FROM messages WHERE {_PROSE}) GROUP BY ALL", "messages"))
def segment_windows(spark, d):
    return th.segments(th.prose(b.messages(spark, d)), 5)


@query(b.sql("SELECT conv_id, msg_count FROM threads t WHERE msg_count > 5 AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = t.conv_id AND e.label < 5)", "threads"))
def pending_rollup(spark, d):
    """Long threads without a segment (here: without a vector of a low label)."""
    done = b.read(spark, d, "embeddings").where("label < 5").select(F.col("vec_id").alias("conv_id"))
    return b.threads(spark, d).where("msg_count > 5").join(done, "conv_id", "left_anti").select("conv_id", "msg_count")


@query(b.sql("SELECT conv_id FROM threads t WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.conv_id)", "threads"))
def pending_facts(spark, d):
    return b.threads(spark, d).join(b.read(spark, d, "labels").select(F.col("doc_id").alias("conv_id")), "conv_id", "left_anti").select("conv_id")


@query(b.sql("""WITH l AS (SELECT conv_id, seq, length(content) + 2 AS c, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS rn FROM messages WHERE content IS NOT NULL),
w AS (SELECT conv_id, seq, rn, c AS held, 0 AS win FROM l WHERE rn = 1 UNION ALL
SELECT l.conv_id, l.seq, l.rn, CASE WHEN w.held + l.c > 600 THEN l.c ELSE w.held + l.c END, CASE WHEN w.held + l.c > 600 THEN w.win + 1 ELSE w.win END FROM w JOIN l ON l.conv_id = w.conv_id AND l.rn = w.rn + 1)
SELECT conv_id, seq, win AS window_no FROM w""", "messages", recursive=True))
def pack_windows(spark, d):
    m = b.messages(spark, d).where("content is not null").withColumnRenamed("content", "line")
    return th.pack_windows(m, 600).withColumnRenamed("window", "window_no")


@query(b.sql("""WITH c AS (SELECT CAST(started_at + to_hours(9) AS DATE) AS day, conv_id, msg_count AS n_lines FROM threads),
r AS (SELECT *, coalesce(sum(n_lines) OVER (PARTITION BY day ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM c)
SELECT CAST(day AS VARCHAR) AS day, conv_id, CAST(greatest(0, least(n_lines, 140 - before_)) AS BIGINT) AS taken FROM r""", "threads"))
def day_budget_transcript(spark, d):
    c = b.threads(spark, d).select(local_day(F.col("started_at")).alias("day"), "conv_id", F.col("msg_count").alias("n_lines"))
    return th.day_budget(c, [F.col("conv_id")], 140).select(F.col("day").cast("string").alias("day"), "conv_id", "taken")


@query(b.sql("""WITH x AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY seq) IS NOT DISTINCT FROM role AND lag(seq) OVER (PARTITION BY conv_id ORDER BY seq) IS NOT NULL THEN 0 ELSE 1 END AS n FROM messages),
y AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM x)
SELECT conv_id, role, min(seq) AS first, count(*) AS n_parts, string_agg(content, chr(10) ORDER BY seq) AS content FROM y GROUP BY conv_id, island, role""", "messages"))
def coalesce_stream_parts(spark, d):
    return th.coalesce_runs(b.messages(spark, d), "conv_id", "seq", ["role"], "content").select("conv_id", "role", "first", "n_parts", "content")


@query(b.sql("""WITH x AS (SELECT m.conv_id, m.seq, t.started_at AS a, t.started_at + to_hours(2) AS z, row_number() OVER (PARTITION BY m.conv_id ORDER BY m.seq) - 1 AS slot, greatest(count(*) OVER (PARTITION BY m.conv_id) - 1, 1) AS n FROM messages m JOIN threads t USING (conv_id))
SELECT conv_id, seq, epoch_us(a) + CAST(floor((epoch_us(z) - epoch_us(a)) * slot::DOUBLE / n::DOUBLE) AS BIGINT) AS ts_us FROM x""", "threads"))
def interpolate_ts(spark, d):
    m = b.messages(spark, d).drop("ts").join(b.threads(spark, d).select("conv_id", F.col("started_at").cast("timestamp").alias("a")), "conv_id").withColumn("z", F.expr("a + interval 2 hours"))
    return th.interpolated_times(m, "conv_id", "seq", "a", "z").select("conv_id", "seq", F.unix_micros("ts").alias("ts_us"))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS rn FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)),
f AS (SELECT user_id, event_id, rn, 0 AS n_before, true AS allowed, [s] AS held FROM e WHERE rn = 1 UNION ALL
SELECT user_id, event_id, rn, len(now), len(now) < 3, CASE WHEN len(now) < 3 THEN list_append(now, s) ELSE now END
FROM (SELECT e.*, list_filter(f.held, lambda h: h >= e.s - 86400) AS now FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
SELECT event_id, CAST(n_before AS BIGINT) AS n_before, allowed FROM f""")
def rolling_budget(spark, d):
    """Three reads a day; refused ones take no place."""
    e = b.read(spark, d, "events").select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long").alias("s"))
    return th.rolling_budget(e, "user_id", "s", "event_id", 86400, 3)


@query(b.sql("SELECT conv_id, lag(conv_id) OVER w AS prev_id, lead(conv_id) OVER w AS next_id FROM threads WINDOW w AS (PARTITION BY project_slug ORDER BY title NULLS LAST, conv_id)", "threads"))
def prev_next(spark, d):
    w = Window.partitionBy("project_slug").orderBy(F.col("title").asc_nulls_last(), "conv_id")
    return b.threads(spark, d).select("conv_id", F.lag("conv_id").over(w).alias("prev_id"), F.lead("conv_id").over(w).alias("next_id"))


@query(b.sql("SELECT project_slug, count(*) AS n, count(*) FILTER (WHERE dominant_topic <> '') AS with_topic, count(*) FILTER (WHERE title IS NULL) AS untitled, count(ended_at) AS ended FROM threads GROUP BY project_slug", "threads"))
def coverage_counts(spark, d):
    return b.threads(spark, d).groupBy("project_slug").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dominant_topic") != "").alias("with_topic"), F.count_if(F.col("title").isNull()).alias("untitled"), F.count("ended_at").alias("ended"))


@query(b.sql("SELECT conv_id, platform, count(*) OVER (PARTITION BY platform) AS n FROM threads WHERE project_slug NOT IN ('__no_project__', '__excluded__')", "threads"))
def members_by_platform(spark, d):
    """Members with the size of their group, which a partial count gives; no group is gathered."""
    t = b.threads(spark, d).where(~F.col("project_slug").isin("__no_project__", "__excluded__"))
    return t.join(t.groupBy("platform").agg(F.count(F.lit(1)).alias("n")), "platform").select("conv_id", "platform", "n")


@query(b.sql("SELECT conv_id, project_slug, regexp_replace(substr(x, 1, 120), '[A-Za-z0-9._+/=@$-]{20,}', '[REDACTED]', 'g') AS brief FROM (SELECT t.conv_id, t.project_slug, m.content AS x FROM threads t JOIN messages m ON m.conv_id = t.conv_id AND m.seq = 1) WHERE project_slug NOT IN ('__no_project__', '__unresolved__', '__excluded__') AND x IS NOT NULL", "threads"))
def redacted_brief(spark, d):
    first = b.messages(spark, d).where("seq = 1 and content is not null").select("conv_id", "content")
    t = b.threads(spark, d).where(~F.col("project_slug").isin("__no_project__", "__unresolved__", "__excluded__")).join(first, "conv_id")
    return t.select("conv_id", "project_slug", tx.redacted_brief(F.col("content")).alias("brief"))

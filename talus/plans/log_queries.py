"""Measurement, drift, streams in batch form, and state transitions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talus.functions import text as tx
from talus.functions.stats import wilson
from talus.operators import access, measure as ms, memories as mem, state as st

from . import bindings as b
from .registry import query
from .search_queries import ME


@query(b.sql("""SELECT source, count(*) AS invocations, count(*) FILTER (WHERE fired_count > 0) AS fired_invocations, count(*) FILTER (WHERE eligible_chunks = 0) AS zero_eligible,
count(*) FILTER (WHERE timed_out) AS timed_out, count(*) FILTER (WHERE outcome_reason = 'unparseable') AS unparseable, count(*) FILTER (WHERE outcome_reason = 'embed_error') AS search_unavailable FROM completions GROUP BY source""", "completions"))
def log_rollup(spark, d):
    return ms.rollup(b.completions(spark, d))


@query(b.sql("SELECT source, outcome_reason AS outcome, count(*) FILTER (WHERE fired_count > 0) AS fired, count(*) FILTER (WHERE fired_count = 0) AS not_fired FROM completions GROUP BY ALL", "completions"))
def outcome_crosstab(spark, d):
    return ms.crosstab(b.completions(spark, d))


_LATENCY = """lat AS (SELECT source, count(*) AS n, min(elapsed_ms) AS min_ms, list_sort(list(elapsed_ms))[CAST(least(count(*) - 1, floor(count(*) * 0.5)) AS BIGINT) + 1] AS p50_ms,
list_sort(list(elapsed_ms))[CAST(least(count(*) - 1, floor(count(*) * 0.95)) AS BIGINT) + 1] AS p95_ms, max(elapsed_ms) AS max_ms FROM completions WHERE elapsed_ms IS NOT NULL GROUP BY source)"""


@query(b.sql(f"WITH {_LATENCY} SELECT * FROM lat", "completions"))
def nearest_rank_percentiles(spark, d):
    out = ms.latency(b.completions(spark, d))
    return out.select("source", F.col("n").cast("long").alias("n"), "min_ms", "p50_ms", "p95_ms", "max_ms")


@query(b.sql("""WITH a AS (SELECT *, coalesce(contains(new_path, 'live_probe.js'), false) AS probe FROM advisories)
SELECT source, count(*) FILTER (WHERE fired) AS fired, count(*) FILTER (WHERE NOT fired) AS near, count(*) FILTER (WHERE fired AND probe) AS probe_fired, count(*) FILTER (WHERE fired AND NOT probe) AS organic_fired,
count(DISTINCT CASE WHEN fired AND NOT probe THEN cwd_repo || '/' || new_symbol || '/' || hit_chunk_id END) AS organic_distinct FROM a GROUP BY source""", "advisories"))
def advisory_rollup(spark, d):
    return ms.advisories(b.advisories(spark, d))


@query(b.sql("SELECT count(*) AS n, round(min(sim), 4) AS min, round(list_sort(list(sim))[count(*) // 2 + 1], 4) AS p50, round(max(sim), 4) AS max FROM advisories WHERE sim IS NOT NULL", "advisories"))
def similarity_summary(spark, d):
    return ms.similarity_summary(b.advisories(spark, d)).select(F.col("n").cast("long").alias("n"), "min", "p50", "max")


_WILSON = """CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE k::DOUBLE / n END AS p,
CASE WHEN n = 0 THEN 0.0 ELSE greatest(0.0, ((k::DOUBLE / n) + 3.8416 / (2 * n)) / (1 + 3.8416 / n::DOUBLE) - 1.96::DOUBLE * sqrt((k::DOUBLE / n) * (1 - k::DOUBLE / n) / n + 3.8416::DOUBLE / (4.0 * n * n)) / (1 + 3.8416 / n::DOUBLE)) END AS lo,
CASE WHEN n = 0 THEN 0.0 ELSE least(1.0, ((k::DOUBLE / n) + 3.8416 / (2 * n)) / (1 + 3.8416 / n::DOUBLE) + 1.96::DOUBLE * sqrt((k::DOUBLE / n) * (1 - k::DOUBLE / n) / n + 3.8416::DOUBLE / (4.0 * n * n)) / (1 + 3.8416 / n::DOUBLE)) END AS hi"""


@query(b.sql(f"SELECT source, k, n, round(p, 6) AS p, round(lo, 6) AS low, round(hi, 6) AS high FROM (SELECT source, k, n, {_WILSON} FROM (SELECT source, count(*) FILTER (WHERE fired) AS k, count(*) AS n FROM advisories GROUP BY source))", "advisories"))
def wilson_rates(spark, d):
    g = b.advisories(spark, d).groupBy("source").agg(F.count_if("fired").alias("k"), F.count(F.lit(1)).alias("n"))
    p, low, high = wilson(F.col("k"), F.col("n"))
    return g.select("source", "k", "n", F.round(p, 6).alias("p"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(b.sql(f"""WITH {_LATENCY}, c AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE eligible_chunks = 0) AS z, count(*) FILTER (WHERE timed_out) AS t, count(*) FILTER (WHERE outcome_reason = 'unparseable') AS u, count(*) FILTER (WHERE outcome_reason = 'embed_error') AS e FROM completions GROUP BY source),
s AS (SELECT source, c.n AS invocations, CASE WHEN c.n < 20 THEN 'insufficient_data' WHEN z::DOUBLE / c.n > 0.95 THEN 'warn' ELSE 'ok' END AS zero_eligible_status,
CASE WHEN c.n < 20 THEN 'insufficient_data' WHEN t::DOUBLE / c.n > 0.02 THEN 'crit' WHEN p95_ms > 8000 THEN 'warn' ELSE 'ok' END AS timeout_status,
CASE WHEN c.n < 20 THEN 'insufficient_data' WHEN u::DOUBLE / c.n > 0.5 THEN 'warn' ELSE 'ok' END AS unparseable_status, CASE WHEN c.n < 20 THEN 'insufficient_data' WHEN e > 0 THEN 'warn' ELSE 'ok' END AS search_status FROM c JOIN lat USING (source))
SELECT *, ['ok', 'insufficient_data', 'warn', 'crit'][greatest(list_position(['ok', 'insufficient_data', 'warn', 'crit'], zero_eligible_status), list_position(['ok', 'insufficient_data', 'warn', 'crit'], timeout_status), list_position(['ok', 'insufficient_data', 'warn', 'crit'], unparseable_status), list_position(['ok', 'insufficient_data', 'warn', 'crit'], search_status))] AS overall FROM s""", "completions"))
def canary_status(spark, d):
    log = b.completions(spark, d)
    return ms.canaries(ms.rollup(log).join(ms.latency(log).select("source", "p95_ms"), "source"))


_ADOPT = """cls AS (SELECT event_id, CASE WHEN coalesce(contains(new_path, 'live_probe.js'), false) THEN 'excluded' WHEN coalesce(new_path, '') = '' THEN 'cant_tell' WHEN event_id % 10 = 0 THEN 'cant_tell'
WHEN event_id % 3 = 0 AND event_id % 2 = 0 AND event_id % 7 <> 0 THEN 'adopted' WHEN event_id % 3 = 0 THEN 'cant_tell' WHEN event_id % 5 = 0 THEN 'cant_tell' WHEN event_id % 11 = 0 THEN 'not_adopted' ELSE 'cant_tell' END AS label,
CASE WHEN coalesce(contains(new_path, 'live_probe.js'), false) THEN 'E0' WHEN coalesce(new_path, '') = '' THEN 'E5' WHEN event_id % 10 = 0 THEN 'E5'
WHEN event_id % 3 = 0 AND event_id % 2 = 0 AND event_id % 7 <> 0 THEN 'E1' WHEN event_id % 3 = 0 THEN 'E4' WHEN event_id % 5 = 0 THEN 'E3' WHEN event_id % 11 = 0 THEN 'E2' ELSE 'E4' END AS evidence_code, source, new_symbol FROM advisories WHERE fired)"""


def _classified(spark, d):
    r = F.col("event_id")
    a = b.advisories(spark, d).where("fired").withColumns({"is_probe": F.coalesce(F.col("new_path").contains("live_probe.js"), F.lit(False)), "files_found": r % 10 != 0, "reference_now": r % 3 == 0, "snapshot_known": r % 2 == 0, "reference_before": r % 7 == 0, "symbol_found": r % 5 != 0, "sha_unchanged": r % 11 == 0})
    return ms.adoption_class(a)


@query(b.sql(f"WITH {_ADOPT} SELECT event_id, label, evidence_code FROM cls", "advisories"))
def adoption_cascade(spark, d):
    return _classified(spark, d).select("event_id", "label", "evidence_code")


@query(b.sql(f"""WITH {_ADOPT}, g AS (SELECT source, count(*) AS n_total, count(*) FILTER (WHERE label = 'adopted') AS k, count(*) FILTER (WHERE label IN ('adopted', 'not_adopted')) AS n FROM cls WHERE label <> 'excluded' GROUP BY source)
SELECT source, n_total, n AS n_decided, k AS n_adopted, round(p, 4) AS rate, round(lo, 4) AS low, round(hi, 4) AS high, round(n::DOUBLE / n_total, 4) AS coverage FROM (SELECT *, {_WILSON} FROM g)""", "advisories"))
def adoption_rates(spark, d):
    return ms.rates(_classified(spark, d).where("label <> 'excluded'"), "source").select("source", "n_total", "n_decided", "n_adopted", "rate", "low", "high", "coverage")


_MARKS = "marks AS (SELECT new_symbol AS record_id, arg_max(CASE WHEN event_id % 3 = 0 THEN 'accepted' WHEN event_id % 3 = 1 THEN 'ignored' ELSE 'na' END, (ts, event_id)) AS mark FROM advisories GROUP BY new_symbol)"


def _marks(spark, d):
    r = F.col("event_id")
    return ms.latest_marks(b.advisories(spark, d).select(F.col("new_symbol").alias("record_id"), "ts", r.alias("seq"), F.when(r % 3 == 0, "accepted").when(r % 3 == 1, "ignored").otherwise("na").alias("mark")))


@query(b.sql(f"WITH {_MARKS} SELECT * FROM marks", "advisories"))
def latest_marks(spark, d):
    return _marks(spark, d)


@query(b.sql(f"WITH {_ADOPT}, {_MARKS} SELECT count(*) AS agreement_n, round(avg(CASE WHEN (label = 'adopted') = (mark = 'accepted') THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS agreement FROM cls JOIN marks ON record_id = new_symbol WHERE label IN ('adopted', 'not_adopted') AND mark IN ('accepted', 'ignored')", "advisories"))
def mark_agreement(spark, d):
    return ms.agreement(_classified(spark, d).withColumnRenamed("new_symbol", "record_id"), _marks(spark, d))


_DRIFT = "dr AS (SELECT entry_date, 1 - list_cosine_similarity(dense, p) AS x FROM (SELECT entry_date, dense, lag(dense) OVER (ORDER BY entry_date) AS p FROM diary WHERE dense IS NOT NULL) WHERE p IS NOT NULL)"


@query(b.sql(f"WITH {_DRIFT} SELECT CAST(entry_date AS VARCHAR) AS entry_date, round(x, 6) AS distance FROM dr", "diary"))
def drift_lag(spark, d):
    return ms.drift(b.diary(spark, d), "entry_date", "dense").select(F.col("entry_date").cast("string").alias("entry_date"), F.round("distance", 6).alias("distance"))


@query(b.sql(f"WITH {_DRIFT} SELECT CAST(entry_date AS VARCHAR) AS entry_date, x > avg(x) OVER () + 1 * stddev_pop(x) OVER () AS flagged, round(avg(x) OVER (), 6) AS mean, round(stddev_pop(x) OVER (), 6) AS sd FROM dr", "diary"))
def drift_flags(spark, d):
    return ms.drift(b.diary(spark, d), "entry_date", "dense", 1.0).select(F.col("entry_date").cast("string").alias("entry_date"), "flagged", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(b.sql("SELECT CAST(entry_date AS VARCHAR) AS entry_date, conv_count FROM (SELECT * FROM diary ORDER BY entry_date DESC LIMIT 7) ORDER BY entry_date", "diary"))
def diary_latest(spark, d):
    last = b.diary(spark, d).orderBy(F.desc("entry_date")).limit(7)
    return last.orderBy("entry_date").select(F.col("entry_date").cast("string").alias("entry_date"), "conv_count")


@query(b.sql("SELECT CAST(e.entry_date AS VARCHAR) AS entry_date, coalesce(d.conv_count, 0) AS conv_count FROM (SELECT CAST(unnest(generate_series(m - INTERVAL 9 DAY, m, INTERVAL 1 DAY)) AS DATE) AS entry_date FROM (SELECT max(entry_date)::TIMESTAMP AS m FROM diary)) e LEFT JOIN diary d USING (entry_date)", "diary"))
def backfill_days(spark, d):
    """The last ten calendar days up to the newest entry, with those that are missing."""
    e = b.diary(spark, d)
    days = e.agg(F.max("entry_date").alias("m")).select(F.explode(F.sequence(F.date_sub("m", 9), F.col("m"))).alias("entry_date"))
    return days.join(e.select("entry_date", "conv_count"), "entry_date", "left").select(F.col("entry_date").cast("string").alias("entry_date"), F.coalesce("conv_count", F.lit(0).cast("long")).alias("conv_count"))


@query("""SELECT event_type AS source, CAST(max(ts) FILTER (WHERE event_id % 4 <> 3) AS VARCHAR) AS last_ok, round(epoch(TIMESTAMP '2024-09-01 00:00:00') - epoch(max(ts) FILTER (WHERE event_id % 4 <> 3)), 3) AS age_s FROM events GROUP BY event_type""")
def heartbeat_staleness(spark, d):
    r = b.read(spark, d, "events").select(F.col("event_type").alias("source"), "ts", F.when(F.col("event_id") % 4 == 3, "failed").otherwise("ok").alias("status"))
    out = ms.heartbeat(r, F.lit(b.AS_OF).cast("timestamp"))
    return out.select("source", F.col("last_ok").cast("string").alias("last_ok"), F.round("age_s", 3).alias("age_s"))


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_hourly(spark, d):
    g = b.read(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "total")


@query("""WITH x AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800000000 THEN 0 ELSE 1 END AS n FROM events),
y AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM x)
SELECT user_id, count(*) AS n_events, CAST(min(ts) AS VARCHAR) AS first_ts FROM y GROUP BY user_id, session""")
def sessionize(spark, d):
    """Gaps of half an hour part sessions."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = b.read(spark, d, "events").withColumn("new", F.when(us - F.lag(us).over(w) < 1_800_000_000, 0).otherwise(1)).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").cast("string").alias("first_ts")).drop("session")


@query("SELECT strftime(ts, '%Y-%m') AS ym, event_type, count(*) AS n FROM events GROUP BY ALL")
def month_partitions(spark, d):
    return b.read(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("ym"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(b.sql("""SELECT conv_id, CASE WHEN n.conv_id IS NOT NULL THEN n.msg_count ELSE o.msg_count END AS msg_count, coalesce(o.slug, n.slug) AS slug FROM
(SELECT conv_id, msg_count, CASE WHEN conv_id % 4 <> 0 THEN project_slug END AS slug FROM threads WHERE conv_id % 3 <> 0) o FULL JOIN (SELECT conv_id, msg_count + 1 AS msg_count, 'new' AS slug FROM threads WHERE conv_id % 2 = 0) n USING (conv_id)""", "threads"))
def upsert_conversations(spark, d):
    t = b.threads(spark, d)
    old = t.where("conv_id % 3 <> 0").select("conv_id", "msg_count", F.when(F.col("conv_id") % 4 != 0, F.col("project_slug")).alias("slug"))
    new = t.where("conv_id % 2 = 0").select("conv_id", (F.col("msg_count") + 1).alias("msg_count"), F.lit("new").alias("slug"))
    return st.upsert(old, new, "conv_id", ["msg_count"], ["slug"])


@query(b.sql("SELECT conv_id, seq, 'old' AS origin FROM messages WHERE seq <= 3 UNION ALL SELECT conv_id, seq, 'new' FROM messages WHERE seq > 3", "messages"))
def insert_ignore_messages(spark, d):
    m = b.messages(spark, d).select("conv_id", "seq")
    new = m.union(m).withColumn("origin", F.lit("new"))
    return st.insert_ignore(m.where("seq <= 3").withColumn("origin", F.lit("old")), new, ["conv_id", "seq"])


@query(b.sql("""WITH hit AS (SELECT DISTINCT v.id * 3 AS memory_pk FROM visible v WHERE v.id % 2 = 0), ok AS (SELECT memory_pk FROM hit WHERE memory_pk IN (SELECT id FROM visible))
SELECT memory_pk, CAST(coalesce(t.activation_count, 0) + CASE WHEN ok.memory_pk IS NULL THEN 0 ELSE 1 END AS INT) AS activation_count FROM telemetry t FULL JOIN ok USING (memory_pk)""", "visible", "telemetry"))
def activation_bump(spark, d):
    v = access.visible_memories(b.memories(spark, d), b.allowlist(spark, d), "src1", True)
    ids = v.where("id % 2 = 0").select(F.array(F.col("id") * 3, F.col("id") * 3).alias("ids"))
    return st.bump(b.telemetry(spark, d), ids, v, b.as_of()).select("memory_pk", F.col("activation_count").cast("int").alias("activation_count"))


@query(b.sql("""SELECT 'proj3' AS project_slug, '{"conversations":' || (SELECT count(*) FROM threads WHERE project_slug = 'proj3') || ',"messages":' || (SELECT count(*) FROM messages WHERE conv_id IN (SELECT conv_id FROM threads WHERE project_slug = 'proj3'))
|| ',"memories":' || (SELECT count(*) FROM memories WHERE source_project = 'proj3') || '}' AS row_counts, 'asked by [REDACTED]' AS reason""", "threads", "memories"))
def purge_cascade_counts(spark, d):
    return st.purge_counts("proj3", "asked by token_0123456789abcdefghij", b.threads(spark, d), b.messages(spark, d), b.memories(spark, d))


@query(b.sql("SELECT conv_id, visibility AS old_visibility, 'org' AS new_visibility FROM threads WHERE tenant_id = 't1' AND owner_user_id = 'u1' AND visibility <> 'org'", "threads"))
def share_audit(spark, d):
    t = b.threads(spark, d)
    return st.share(t, t.select("conv_id"), "org", None, ME.team_ids, access.owns(ME))[1]


@query(b.sql("""SELECT conv_id, seq, 'identity' AS violation FROM messages WHERE NOT (tenant_id = 't1' AND owner_user_id = 'u1')
UNION ALL SELECT conv_id, seq, 'parent' FROM messages WHERE tenant_id = 't1' AND owner_user_id = 'u1' AND conv_id NOT IN (SELECT conv_id FROM threads WHERE tenant_id = 't1' AND owner_user_id = 'u1' AND msg_count > 3)""", "threads"))
def identity_write_violations(spark, d):
    return access.write_violations(b.messages(spark, d).select("conv_id", "seq", "tenant_id", "owner_user_id"), b.threads(spark, d).where("msg_count > 3").select("conv_id", "tenant_id", "owner_user_id"), ME).select("conv_id", "seq", "violation")


@query(b.sql("""SELECT conv_id, kind FROM (SELECT f.conv_id, CASE WHEN k.last_size IS NULL THEN 'new' WHEN k.last_size = 0 THEN 'legacy' WHEN k.last_size::DOUBLE / greatest(k.msg_count, 1) > 300 THEN 'truncated' WHEN f.size > k.last_size THEN 'grown' END AS kind
FROM (SELECT conv_id, sum(length(content)) AS size FROM messages GROUP BY conv_id) f LEFT JOIN (SELECT conv_id, msg_count, conv_id % 7 * 300 AS last_size FROM threads WHERE conv_id % 5 <> 0) k USING (conv_id)) WHERE kind IS NOT NULL""", "threads"))
def discover_classification(spark, d):
    found = b.messages(spark, d).groupBy("conv_id").agg(F.sum(F.length("content")).alias("size"))
    known = b.threads(spark, d).where("conv_id % 5 <> 0").select("conv_id", "msg_count", (F.col("conv_id") % 7 * 300).alias("last_size"))
    return st.classify_files(found, known, 300).select("conv_id", "kind")


@query(b.sql("""WITH old AS (SELECT source AS path, doc_id AS seq, sha256(text) AS sha FROM documents WHERE doc_id % 50 <> 0 OR source = 'src3'), new AS (SELECT source AS path, doc_id AS seq, sha256(text) AS sha FROM documents),
n AS (SELECT path, list(sha ORDER BY seq, sha) AS now FROM new GROUP BY path), o AS (SELECT path, list(sha ORDER BY seq, sha) AS was FROM old GROUP BY path),
r AS (SELECT path, count(*) AS n_chunks, count(*) FILTER (WHERE sha IN (SELECT sha FROM old)) AS n_reused FROM new GROUP BY path)
SELECT path, CASE WHEN was IS NULL THEN 'new' WHEN was = now THEN 'metadata-only' ELSE 'replaced' END AS status, n_chunks, n_reused FROM n LEFT JOIN o USING (path) JOIN r USING (path)"""))
def chunk_diff(spark, d):
    new = b.read(spark, d, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("seq"), F.sha2(F.col("text").cast("binary"), 256).alias("content_sha"))
    return st.chunk_diff(new.where("seq % 50 <> 0 or path = 'src3'"), new)


@query(b.sql("""WITH old AS MATERIALIZED (SELECT source AS path, doc_id AS seq, sha256(coalesce(text, '')) AS sha, dense FROM corpus WHERE source <> 'src7'),
new AS MATERIALIZED (SELECT source AS path, doc_id AS seq, sha256(coalesce(text, '') || CASE WHEN doc_id % 50 = 0 AND source <> 'src3' THEN '!' ELSE '' END) AS sha FROM corpus WHERE source <> 'src5'),
st AS (SELECT n.path, CASE WHEN NOT bool_or(o.path IS NOT NULL) THEN 'new' WHEN bool_and(o.sha IS NOT DISTINCT FROM n.sha) THEN 'metadata-only' ELSE 'replaced' END AS status FROM new n LEFT JOIN old o USING (path, seq) GROUP BY n.path),
known AS (SELECT sha, first(dense ORDER BY path, seq) AS k FROM old WHERE dense IS NOT NULL GROUP BY sha)
SELECT n.path, n.seq, status, round(list_sum(CASE WHEN status = 'metadata-only' THEN o.dense ELSE k END), 5) AS total FROM new n JOIN st USING (path) LEFT JOIN old o USING (path, seq) LEFT JOIN known ON known.sha = n.sha""", "corpus"))
def chunk_state(spark, d):
    """The next state of an index, whose vectors come from equal content wherever it was."""
    x = b.read(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    e = b.read(spark, d, "embeddings").select(F.col("vec_id").alias("seq"), F.col("embedding").alias("dense"))
    # Texts are hashed before vectors are joined, so no shuffle carries them.
    row = lambda text: [F.col("source").alias("path"), F.col("doc_id").alias("seq"), F.lit("f").alias("symbol"), F.sha2(text.cast("binary"), 256).alias("content_sha"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line")]
    old = x.where("source <> 'src7'").select(*row(F.col("text"))).join(e, "seq", "left")
    new = x.where("source <> 'src5'").select(*row(F.concat("text", F.when((F.col("doc_id") % 50 == 0) & (F.col("source") != "src3"), "!").otherwise("")))).join(e.drop("dense"), "seq", "left")
    total = F.aggregate("dense", F.lit(0.0), lambda x, y: x + y.cast("double"))
    return st.replace_chunks(old, new).select("path", "seq", "status", F.round(total, 5).alias("total"))


@query(b.sql("SELECT m.id, CAST(m.last_dubbed_at AS VARCHAR) AS last_dubbed_at FROM memories m WHERE deleted_at IS NULL AND last_dubbed_at < TIMESTAMP '2024-09-01 00:00:00' - INTERVAL 180 DAY", "memories"))
def stale_memories(spark, d):
    return mem.stale(b.memories(spark, d), b.as_of(), 180).select("id", F.col("last_dubbed_at").cast("string").alias("last_dubbed_at"))


@query(b.sql("SELECT (SELECT count(*) FROM memories WHERE deleted_at IS NULL) AS memories, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges e LEFT JOIN memories t ON t.id = e.target_memory_pk WHERE e.target_memory_pk IS NULL OR t.deleted_at IS NOT NULL) AS dangling", "memories", "edges"))
def curation_digest(spark, d):
    return mem.digest(b.memories(spark, d), b.edges(spark, d))


@query(b.sql("SELECT s.source_project AS proj, s.source_stem AS src, e.target_slug, CASE WHEN e.target_memory_pk IS NULL THEN 'unresolved' ELSE 'deleted-target' END AS kind FROM edges e JOIN memories s ON s.id = e.source_memory_pk LEFT JOIN memories t ON t.id = e.target_memory_pk WHERE e.target_memory_pk IS NULL OR t.deleted_at IS NOT NULL", "memories", "edges"))
def dangling_links(spark, d):
    return mem.dangling(b.edges(spark, d), b.memories(spark, d))


@query(b.sql("""WITH e AS (SELECT target_memory_pk AS id, source_memory_pk AS via, list_position([5, 9, 2, 40, 77, 120, 8], source_memory_pk) AS r FROM edges WHERE source_memory_pk IN (5, 9, 2, 40, 77, 120, 8) AND target_memory_pk IS NOT NULL AND target_memory_pk NOT IN (5, 9, 2, 40, 77, 120, 8) AND source_memory_pk IN (SELECT id FROM memories WHERE deleted_at IS NULL))
SELECT id, CAST(min(r) AS BIGINT) AS src_rank, arg_min(via, r) AS via_source_pk FROM e WHERE id IN (SELECT id FROM visible) GROUP BY id ORDER BY src_rank, id LIMIT 10""", "visible", "edges"))
def neighbor_expand(spark, d):
    out = mem.expand(b.edges(spark, d), b.memories(spark, d), b.allowlist(spark, d), [5, 9, 2, 40, 77, 120, 8], "src1", True, 10)
    return out.select("id", F.col("src_rank").cast("long").alias("src_rank"), "via_source_pk")


@query(b.sql("""WITH m AS (SELECT * FROM memories WHERE deleted_at IS NULL AND dense IS NOT NULL),
p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.dense, b.dense) AS sim, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.dense, b.dense) DESC, b.id) AS rn FROM m a JOIN m b ON a.id <> b.id AND a.chassis_id = b.chassis_id AND a.source_project = b.source_project
WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE (e.source_memory_pk = a.id AND e.target_memory_pk = b.id) OR (e.source_memory_pk = b.id AND e.target_memory_pk = a.id)))
SELECT least(a, b) AS lo, greatest(a, b) AS hi, round(max(sim), 6) AS sim FROM p WHERE rn <= 3 AND sim >= 0.3 GROUP BY ALL ORDER BY max(sim) DESC, lo, hi LIMIT 40""", "memories", "edges"))
def suggested_links(spark, d):
    return mem.suggested_links(b.memories(spark, d), b.edges(spark, d), 0.3, 40).select("lo", "hi", F.round("sim", 6).alias("sim"))


@query(b.sql("SELECT node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT source_memory_pk::VARCHAR AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT coalesce(target_memory_pk::VARCHAR, '?' || target_slug), 0, 1 FROM edges) GROUP BY node", "edges"))
def degree(spark, d):
    return mem.degrees(b.edges(spark, d))


@query(b.sql("SELECT id FROM memories WHERE deleted_at IS NULL AND scope = 'shared' AND id NOT IN (SELECT memory_pk FROM allowlist)", "memories", "allowlist"))
def promotion_candidates(spark, d):
    return mem.promotable(b.memories(spark, d), b.allowlist(spark, d)).select("id")


@query(b.sql("""WITH l AS (SELECT id AS source_memory_pk, chassis_id, source_project, 'M' || ((id * 7 + 3) % 1500) AS target_slug FROM memories WHERE deleted_at IS NULL AND (id * 7 + 3) % 1500 <> id)
SELECT l.source_memory_pk, l.target_slug, 'next' AS link_text, min(t.id) AS target_memory_pk FROM l LEFT JOIN memories t ON t.deleted_at IS NULL AND t.chassis_id = l.chassis_id AND t.source_project = l.source_project AND lower(t.source_stem) = lower(l.target_slug) GROUP BY ALL""", "memories"))
def edge_sync(spark, d):
    """Links of live bodies, resolved within chassis and project; code and the page's own link are no links."""
    m = b.memories(spark, d)
    return mem.resolve_edges(mem.extract_edges(m), m).select("source_memory_pk", "target_slug", "link_text", "target_memory_pk")

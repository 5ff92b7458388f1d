"""Upkeep: provisioning, scores, backfills, provenance, transcripts by budget, reports and page status."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talus.functions import text as tx
from talus.functions.times import local_day
from talus.operators import access, markup, measure as ms, state as st, threads as th, wiki
from talus.scratch import fresh, retire

from . import bindings as b
from .log_queries import _ADOPT, _WILSON, _classified
from .registry import query
from .search_queries import ACL, ME
from .thread_queries import _PROSE

EXCLUDED = ["/srv/private/", "/home/me/proj-3"]


@query("""SELECT page_id, CASE WHEN page_id % 11 = 0 THEN '__unresolved__' WHEN page_id % 9 = 3 OR page_id % 5 = 0 THEN '__excluded__' ELSE 'proj-' || (page_id % 9) END AS slug FROM pages""")
def excluded_projects(spark, d):
    """Folders under an excluded prefix, and rows without a folder, whatever their remote."""
    r = F.col("page_id")
    cwd = F.when(r % 11 == 0, F.lit(None)).when(r % 5 == 0, "/srv/private/x").otherwise(F.concat(F.lit("/home/me/proj-"), (r % 9).cast("string")))
    return b.read(spark, d, "pages").select("page_id", tx.resolved_slug(F.lit(None).cast("string"), cwd, EXCLUDED).alias("slug"))


def _scored(spark, d):
    t = b.threads(spark, d)
    r = F.col("conv_id")
    old = t.select("conv_id", F.when(r % 4 == 0, 5.0).alias("intensity"), "dominant_topic", F.when(r % 4 == 0, F.lit("2024-02-01").cast("timestamp_ntz")).alias("scored_at"))
    new = t.where("conv_id % 3 <> 2").select("conv_id", (r % 3 == 0).alias("scored"), F.when(r % 3 == 0, (r % 10).cast("double")).alias("intensity"), F.when(r % 6 == 0, F.lit("new topic")).alias("topic"))
    return old, new


@query(b.sql("""SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN CAST(conv_id % 10 AS DOUBLE) WHEN conv_id % 4 = 0 THEN 5.0 END AS intensity, CASE WHEN conv_id % 6 = 0 THEN 'new topic' WHEN conv_id % 3 = 0 THEN '' ELSE dominant_topic END AS dominant_topic,
CASE WHEN conv_id % 3 = 0 THEN '2024-09-01' WHEN conv_id % 4 = 0 THEN '2024-02-01' WHEN conv_id % 3 = 1 THEN '2024-09-01' END AS scored_on FROM threads""", "threads"))
def score_writes(spark, d):
    """Scores, and a mark on threads with nothing to score; those that are marked already stay."""
    out = st.write_scores(*_scored(spark, d), b.as_of())
    return out.select("conv_id", "intensity", "dominant_topic", F.to_date("scored_at").cast("string").alias("scored_on"))


def _org(spark, d):
    c = b.read(spark, d, "customer").select(F.concat(F.lit("t"), (F.col("c_nationkey") % 3).cast("string")).alias("tenant_id"), F.col("c_custkey").alias("k"))
    users = c.where("k % 2 = 0").select("tenant_id", F.concat(F.lit("u"), F.col("k").cast("string")).alias("user_id"), F.lit("reader").alias("db_role"), F.when(F.col("k") % 4 == 0, "Old name").alias("display_name"), F.lit("old@x.example").alias("email"), F.when(F.col("k") % 10 == 0, F.lit("2024-01-01").cast("timestamp_ntz")).alias("disabled_at"))
    members = c.where("k % 2 = 0").select("tenant_id", F.lit("team0").alias("team_id"), F.concat(F.lit("u"), F.col("k").cast("string")).alias("user_id"))
    roster = c.where("k % 3 = 0").select("tenant_id", F.concat(F.lit("u"), F.col("k").cast("string")).alias("user_id"), F.lit("writer").alias("db_role"), F.when(F.col("k") % 9 == 0, "New name").alias("display_name"), F.lit(None).cast("string").alias("email"), F.explode(F.array(F.lit("team0"), F.concat(F.lit("team"), (F.col("k") % 5).cast("string")))).alias("team_id"))
    return users, members, roster


_ORG = "org AS (SELECT 't' || (c_nationkey % 3) AS tenant_id, 'u' || c_custkey AS user_id, c_custkey AS k FROM customer)"


@query(f"""WITH {_ORG} SELECT tenant_id, user_id, CASE WHEN k % 3 = 0 THEN 'writer' ELSE 'reader' END AS db_role, CASE WHEN k % 9 = 0 THEN 'New name' WHEN k % 4 = 0 THEN 'Old name' END AS display_name,
CASE WHEN k % 2 = 0 THEN 'old@x.example' END AS email, CASE WHEN k % 10 = 0 THEN '2024-01-01' WHEN k % 7 = 0 THEN '2024-09-01' END AS disabled_on FROM org WHERE k % 2 = 0 OR k % 3 = 0""")
def roster_users(spark, d):
    users, members, roster = _org(spark, d)
    after, _ = st.provision(users, members, roster)
    gone = after.where(F.substring("user_id", 2, 20).cast("long") % 7 == 0).select("tenant_id", "user_id")
    return st.disable(after, gone, b.as_of()).select("tenant_id", "user_id", "db_role", "display_name", "email", F.to_date("disabled_at").cast("string").alias("disabled_on"))


@query(f"""WITH {_ORG}, m AS (SELECT tenant_id, 'team0' AS team_id, user_id FROM org WHERE k % 2 = 0 UNION SELECT tenant_id, 'team0', user_id FROM org WHERE k % 3 = 0 UNION SELECT tenant_id, 'team' || (k % 5), user_id FROM org WHERE k % 3 = 0)
SELECT tenant_id, team_id, count(*) AS n_users FROM m GROUP BY ALL""")
def roster_memberships(spark, d):
    return st.provision(*_org(spark, d))[1].groupBy("tenant_id", "team_id").agg(F.count(F.lit(1)).alias("n_users"))


@query(b.sql("SELECT conv_id, CASE WHEN platform <> 'chatgpt' THEN 'local' ELSE tenant_id END AS tenant_id FROM threads", "threads"))
def resumable_backfill(spark, d):
    """A backfill that is cut off after two of eight buckets and goes on where it ended."""
    t = b.threads(spark, d).select("conv_id", F.when(F.col("platform") == "chatgpt", F.col("tenant_id")).alias("tenant_id"))
    fill = lambda x: x.withColumn("tenant_id", F.coalesce("tenant_id", F.lit("local")))
    out = fresh(spark, "backfill")
    retire(spark, out)
    st.backfill(t, fill, "conv_id", out, 8, stop_after=2)
    return st.backfill(t, fill, "conv_id", out, 8)[0].select("conv_id", "tenant_id")


@query(b.sql("SELECT count(*) AS rows_total, CAST(0 AS BIGINT) AS residual, count(*) FILTER (WHERE platform <> 'chatgpt') AS pending_before FROM threads", "threads"))
def backfill_residual(spark, d):
    """The gate after a backfill: no row is left."""
    t = b.threads(spark, d).select("conv_id", F.when(F.col("platform") == "chatgpt", F.col("tenant_id")).alias("tenant_id"))
    before = st.residual(t, F.col("tenant_id").isNull()).select(F.col("residual").alias("pending_before"))
    after = st.residual(t.withColumn("tenant_id", F.coalesce("tenant_id", F.lit("local"))), F.col("tenant_id").isNull())
    return after.crossJoin(before)  # one row each


@query(b.sql("""WITH x AS (SELECT id, length(body) AS n, body, source_stem FROM memories WHERE deleted_at IS NULL)
SELECT count(*) AS memories, CAST(sum(n) AS BIGINT) AS chars, CAST(sum(CASE WHEN (id * 7 + 3) % 1500 = id THEN 0 ELSE 1 END) AS BIGINT) AS links FROM x""", "memories"))
def link_totals(spark, d):
    """What a dry run reports: memories, their characters and links."""
    m = b.memories(spark, d).where("deleted_at is null")
    return m.agg(F.count(F.lit(1)).alias("memories"), F.sum(F.length("body")).alias("chars"), F.sum(F.size(tx.wikilinks(F.col("body"), F.col("source_stem"))).cast("long")).alias("links"))


@query(b.sql("""SELECT CAST(CAST(started_at + to_hours(9) AS DATE) AS VARCHAR) AS day, '[' || string_agg('{"session_id":' || conv_id || ',"runtime":"' || platform || '","host":"' || CASE WHEN conv_id % 4 = 1 THEN 'unknown' ELSE 'h' || (conv_id % 3) END || '"}', ',' ORDER BY started_at, conv_id) || ']' AS provenance FROM threads GROUP BY ALL""", "threads"))
def day_provenance(spark, d):
    """The sessions of each day in order, as a JSON array."""
    r = F.col("conv_id")
    host = F.when(r % 4 != 1, F.concat(F.lit("h"), (r % 3).cast("string")))
    t = b.threads(spark, d).withColumn("day", local_day(F.col("started_at"))).withColumn("host", F.coalesce(host, F.lit("unknown")))
    held = F.struct("started_at", "conv_id", F.struct(r.alias("session_id"), F.col("platform").alias("runtime"), "host").alias("session"))
    listed = F.transform(F.array_sort(F.collect_list(held)), lambda x: x["session"])
    return t.groupBy("day").agg(F.to_json(listed).alias("provenance")).select(F.col("day").cast("string").alias("day"), "provenance")


@query("SELECT event_id, event_type AS tool_name, substr(sha256(event_type || '|' || coalesce(props, '')), 1, 16) AS arg_digest, CAST(ts AS VARCHAR) AS at FROM events")
def read_audit(spark, d):
    """A log row for each read, with a digest in place of its arguments."""
    digest = tx.arg_digest(F.col("event_type"), F.lit("|"), F.coalesce("props", F.lit("")))
    return b.read(spark, d, "events").select("event_id", F.col("event_type").alias("tool_name"), digest.alias("arg_digest"), F.col("ts").cast("string").alias("at"))


_SEG = f"""q AS (SELECT m.*, row_number() OVER (PARTITION BY conv_id ORDER BY seq) - 1 AS pos FROM messages m WHERE {_PROSE} AND conv_id IN (SELECT conv_id FROM messages GROUP BY conv_id HAVING count(*) > 4)),
s AS (SELECT *, pos // 4 AS seg_idx FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, seg_idx ORDER BY seq) - 1 AS p, count(*) OVER (PARTITION BY conv_id, seg_idx) AS n, min(seq) OVER (PARTITION BY conv_id, seg_idx) AS lo, max(seq) OVER (PARTITION BY conv_id, seg_idx) AS hi FROM s)"""


@query(b.sql(rf"""WITH {_SEG} SELECT conv_id, CAST(seg_idx AS INT) AS seg_idx, lo AS start_seq, hi AS end_seq, string_agg(CASE WHEN role = 'user' THEN '[USER] ' ELSE '[AI] ' END || x, chr(10) || chr(10) ORDER BY seq) AS transcript
FROM (SELECT *, substr(regexp_replace(content, '^\s+|\s+$', '', 'g'), 1, 80) AS x FROM r WHERE n <= 2 OR p IN (0, n // 2)) WHERE length(x) >= 20 GROUP BY ALL""", "messages"))
def segment_transcripts(spark, d):
    """Windows of four messages with a sample of two each."""
    return th.segment_transcripts(b.messages(spark, d), 4, 2, 80)


@query(b.sql(rf"""WITH t AS (SELECT *, CAST(started_at + to_hours(9) AS DATE) AS day, greatest(3, least(5, 20 // count(*) OVER (PARTITION BY CAST(started_at + to_hours(9) AS DATE)) + 8)) AS cap FROM threads),
p AS (SELECT m.*, t.day, t.cap, t.title, t.started_at, row_number() OVER (PARTITION BY conv_id ORDER BY seq) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM messages m JOIN t USING (conv_id) WHERE {_PROSE}),
k AS (SELECT *, regexp_replace(content, '^\s+|\s+$', '', 'g') AS x FROM p WHERE n <= greatest(8, cap) OR pos IN (SELECT CAST(floor(i * n / greatest(8, cap)::DOUBLE) AS BIGINT) FROM range(0, 60) g(i) WHERE i < greatest(8, cap))),
o AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY started_at NULLS LAST, conv_id, seq) AS r FROM (SELECT *, substr(x, 1, 100) AS y FROM k) WHERE length(y) >= 20)
SELECT CAST(day AS VARCHAR) AS day, count(*) AS n_lines, string_agg(CASE WHEN r = first THEN '## ' || coalesce(nullif(title, ''), 'conversation') || ' [' || platform || ']' || chr(10) ELSE '' END || CASE WHEN role = 'user' THEN '[USER] ' ELSE '[CLAUDE] ' END || y, chr(10) || chr(10) ORDER BY r) AS transcript
FROM (SELECT o.*, t.platform, min(r) OVER (PARTITION BY o.day, conv_id) AS first FROM o JOIN (SELECT conv_id, platform FROM threads) t USING (conv_id) WHERE r <= 20) GROUP BY day""", "threads"))
def day_transcript(spark, d):
    """A budget of twenty lines a day, and a cap for each conversation that depends on how many there are."""
    t = b.threads(spark, d).select(local_day(F.col("started_at")).alias("day"), "conv_id", "title", F.col("platform").alias("provenance"), "started_at")
    return th.day_transcripts(b.messages(spark, d), t, 20, 5, 100).select(F.col("day").cast("string").alias("day"), "n_lines", "transcript")


@query(b.sql("""SELECT CAST(entry_date AS VARCHAR) AS entry_date, string_agg('[' || p || ']' || chr(10) || CASE WHEN length(t) > 700 THEN substr(t, 1, 700) || '…' ELSE t END, chr(10) || chr(10) ORDER BY p) AS prior FROM (
SELECT a.entry_date, b.entry_date AS p, regexp_replace(b.body, '^\\s+|\\s+$', '', 'g') AS t, row_number() OVER (PARTITION BY a.entry_date ORDER BY b.entry_date DESC) AS rn FROM diary_entries a JOIN diary_entries b ON b.entry_date < a.entry_date) WHERE rn <= 7 AND t IS NOT NULL GROUP BY entry_date""".replace("\\\\", "\\"), "diary_entries"))
def prior_excerpts(spark, d):
    """What a writer sees of the last seven entries: a bounded frame over one row a day."""
    body = tx.strip(F.col("body"))
    entry = F.concat(F.lit("["), F.col("entry_date").cast("string"), F.lit("]\n"), tx.clipped(body, 700))
    w = Window.orderBy("entry_date").rowsBetween(-7, -1)
    x = b.diary_entries(spark, d).withColumn("p", F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("entry_date", entry.alias("e")))).over(w)))
    return x.where(F.size("p") > 0).select(F.col("entry_date").cast("string").alias("entry_date"), F.array_join(F.transform("p", lambda y: y["e"]), "\n\n").alias("prior"))


_FIRES = "fires AS (SELECT event_id, 'session-' || (event_id % 7) || '-' || hit_chunk_id AS k FROM advisories WHERE fired)"


@query(b.sql(f"""WITH {_FIRES}, sheet AS (SELECT regexp_replace(lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || '-session-' || (doc_id % 7) || '-' || (doc_id % 30), '^[0-9]{{2}}-', '') AS k, max(quality) AS verdict FROM labels GROUP BY 1)
SELECT event_id, f.k AS join_key, verdict FROM fires f LEFT JOIN sheet s USING (k)""", "advisories"))
def worksheet_join(spark, d):
    """Log records with the verdict of a worksheet, on a key that both derive."""
    a = b.advisories(spark, d).where("fired")
    session = F.concat(F.lit("session-"), (F.col("event_id") % 7).cast("string"), F.lit("tail"))
    fires = a.select("event_id", ms.record_key(F.substring(session, 1, 9), F.col("hit_chunk_id"), 9).alias("join_key"))
    item = F.concat(F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit("-session-"), (F.col("doc_id") % 7).cast("string"), F.lit("-"), (F.col("doc_id") % 30).cast("string"))
    sheet = b.read(spark, d, "labels").groupBy(ms.worksheet_key(item).alias("join_key")).agg(F.max("quality").alias("verdict"))
    return fires.join(sheet, "join_key", "left").select("event_id", "join_key", "verdict")


@query(b.sql("""SELECT conv_id, visibility AS old_visibility, 'team' AS new_visibility FROM threads WHERE tenant_id = 't1' AND owner_user_id = 'u1' AND visibility <> 'team'
AND 'team' || (conv_id % 4) IN (SELECT 'team' || (c_custkey % 4) FROM customer WHERE c_custkey % 8 IN (1, 3))""", "threads"))
def team_share(spark, d):
    """Sharing with a team that the owner is a member of; other teams are refused."""
    members = b.read(spark, d, "customer").where("c_custkey % 8 in (1, 3)").select(F.concat(F.lit("team"), (F.col("c_custkey") % 4).cast("string")).alias("to_team"))
    t = b.threads(spark, d).where(access.owns(ME)).withColumn("to_team", F.concat(F.lit("team"), (F.col("conv_id") % 4).cast("string")))
    ok = t.join(members, "to_team", "left_semi").where("visibility <> 'team'")
    return ok.select("conv_id", F.col("visibility").alias("old_visibility"), F.lit("team").alias("new_visibility"))


@query(b.sql("SELECT conv_id, visibility AS old_visibility, 'private' AS new_visibility FROM threads WHERE tenant_id = 't1' AND owner_user_id = 'u1' AND visibility <> 'private'", "threads"))
def unshare_audit(spark, d):
    t = b.threads(spark, d)
    return st.share(t, t.select("conv_id"), "private", None, ME.team_ids, access.owns(ME))[1]


@query(b.sql("SELECT owner_user_id, count(*) AS n, count(*) FILTER (WHERE dense IS NULL) AS missing FROM message_vectors GROUP BY owner_user_id", "message_vectors"))
def missing_vectors(spark, d):
    """The check after an ingest: messages without a vector, by owner."""
    return b.message_vectors(spark, d).groupBy("owner_user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dense").isNull()).alias("missing"))


@query(b.sql("SELECT project_slug, conv_id, row_number() OVER (PARTITION BY project_slug ORDER BY started_at, conv_id) AS place FROM threads WHERE title <> ''", "threads"))
def ordered_members(spark, d):
    """Members of each project with their place, instead of a gathered list."""
    w = Window.partitionBy("project_slug").orderBy("started_at", "conv_id")
    return b.threads(spark, d).where("title <> ''").select("project_slug", "conv_id", F.row_number().over(w).alias("place"))


_SURFACE = "CASE WHEN event_id % 17 = 0 THEN 'probe' WHEN event_id % 4 <> 0 THEN 'edit' ELSE 'none' END"


@query(b.sql(f"""WITH {_ADOPT}, g AS (SELECT source, {_SURFACE} AS anchor, count(*) AS n_total, count(*) FILTER (WHERE label = 'adopted') AS k, count(*) FILTER (WHERE label IN ('adopted', 'not_adopted')) AS n FROM cls WHERE label <> 'excluded' GROUP BY ALL)
SELECT source || '/' || anchor AS surface, n_total, n AS n_decided, k AS n_adopted, CASE WHEN n > 0 THEN round(p, 4) END AS rate, CASE WHEN n > 0 THEN round(lo, 4) END AS low, CASE WHEN n > 0 THEN round(hi, 4) END AS high FROM (SELECT *, {_WILSON} FROM g)""", "advisories"))
def adoption_by_surface(spark, d):
    """Rates by where the advice was shown and what it was anchored to."""
    r = F.col("event_id")
    anchor = F.when(r % 17 == 0, "probe").when(r % 4 != 0, "edit").otherwise("none")
    rows = _classified(spark, d).where("label <> 'excluded'").withColumn("surface", F.concat_ws("/", "source", anchor))
    return ms.rates(rows, "surface").select("surface", "n_total", "n_decided", "n_adopted", "rate", "low", "high")


@query(b.sql("""SELECT source AS repo, count(DISTINCT doc_id % 50) AS files, count(*) AS chunks, count(*) FILTER (WHERE dense IS NULL) AS missing, (SELECT count(*) FROM advisories WHERE fired) AS fired, (SELECT count(*) FROM advisories WHERE NOT fired) AS near FROM corpus GROUP BY source""", "corpus", "advisories"))
def index_stats(spark, d):
    """Files, chunks and chunks without a vector of each repository, with how often advice fired."""
    log = b.advisories(spark, d).agg(F.count_if(F.col("fired")).alias("fired"), F.count_if(~F.col("fired")).alias("near"))
    repos = b.corpus(spark, d).groupBy(F.col("source").alias("repo")).agg(F.count_distinct(F.col("doc_id") % 50).alias("files"), F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("dense").isNull()).alias("missing"))
    return repos.crossJoin(F.broadcast(log))  # one row


def _pages(spark, d):
    r = F.col("doc_id")
    x = b.read(spark, d, "documents").withColumn("slug", F.concat(F.lit("p"), r.cast("string")))
    pages = x.select("slug", F.when(r % 5 != 0, F.col("lang")).alias("domain"), F.concat(F.lit("Title "), (r % 40).cast("string")).alias("title"), F.when(r % 9 == 0, " ").otherwise(F.col("text")).alias("body"), (r % 3 + 1).cast("int").alias("rev"))
    lines = x.select(F.concat(F.lit("p"), (r % 60).cast("string")).alias("slug"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    claims = lines.select("slug", F.when(F.col("n") % 3 == 0, "struck").otherwise("live").alias("status"))
    staged = x.where("doc_id % 2 = 0").select("slug", F.concat(F.lit("m"), r.cast("string")).alias("merge_id"))
    log = x.where("doc_id % 6 = 0").select("slug", F.concat(F.lit("m"), r.cast("string")).alias("merge_id"))
    return pages, claims, staged, log


@query("""WITH c AS (SELECT 'p' || (doc_id % 60) AS slug, count(*) FILTER (WHERE n % 3 <> 0) AS live FROM (SELECT doc_id, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents) GROUP BY 1)
SELECT 'p' || doc_id AS slug, CAST(doc_id % 3 + 1 AS INT) AS rev, coalesce(live, 0) AS live_claims, CAST(CASE WHEN doc_id % 2 = 0 AND doc_id % 6 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS pending, CAST(CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) AS merges FROM documents LEFT JOIN c ON c.slug = 'p' || doc_id""")
def page_status(spark, d):
    return wiki.page_status(*_pages(spark, d)).select("slug", "rev", "live_claims", "pending", "merges")


@query("""SELECT domain, slug, title, row_number() OVER (PARTITION BY domain ORDER BY title, slug) AS place FROM (SELECT 'p' || doc_id AS slug, CASE WHEN doc_id % 5 <> 0 THEN lang END AS domain, 'Title ' || (doc_id % 40) AS title, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE text END AS body FROM documents) WHERE body IS NOT NULL AND trim(body) <> ''""")
def page_index(spark, d):
    return wiki.page_index(_pages(spark, d)[0])


_RAW = ["<pre>\nraw\n</PRE>\nafter", "<script src=x>\nlet a;\n</style>\n</script>\nb", "<style> x </style> c\n<textarea>\nnever closed", "```\n<pre>\n~~~\n```\nd\n~~~\nopen"]


@query(rf"""WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, string_split([{", ".join("replace('" + x.replace(chr(10), '|') + "', '|', chr(10))" for x in _RAW)}][doc_id % 4 + 1] || chr(10) || coalesce(text, ''), chr(10)) AS l FROM documents),
x AS MATERIALIZED (SELECT doc_id, i, l[i] AS line, substr(regexp_extract(l[i], '^\s*(```+|~~~+)', 1), 1, 1) AS mark, lower(regexp_extract(l[i], '(?i)^ {{0,3}}<(script|style|pre|textarea)([\s>]|$)', 1)) AS tag, len(list_filter(l[i + 1:], lambda y: regexp_matches(y, '(?i)</' || lower(regexp_extract(l[i], '(?i)^ {{0,3}}<(script|style|pre|textarea)([\s>]|$)', 1)) || '\s*>'))) > 0 AS below FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)),
y AS MATERIALIZED (SELECT *, tag <> '' AND NOT regexp_matches(line, '(?i)</' || tag || '\s*>') AND below AS raw FROM x),
f AS (SELECT doc_id, 0 AS i, '' AS mode, true AS prose, '' AS line FROM l UNION ALL
SELECT y.doc_id, y.i, CASE WHEN f.mode = '' AND mark <> '' THEN mark WHEN f.mode = '' AND raw THEN tag WHEN f.mode = '' THEN '' WHEN f.mode = mark OR (length(f.mode) > 1 AND regexp_matches(y.line, '(?i)</' || f.mode || '\s*>')) THEN '' ELSE f.mode END, f.mode = '' AND mark = '' AND NOT raw, y.line
FROM f JOIN y ON y.doc_id = f.doc_id AND y.i = f.i + 1)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE prose) AS n_prose, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE prose), '')) AS digest FROM f WHERE i > 0 GROUP BY doc_id""")
def prose_lines(spark, d):
    """Which lines of pages are prose: raw blocks and fences are put before every text."""
    body = F.concat(F.element_at(F.array(*[F.lit(x) for x in _RAW]), (F.col("doc_id") % 4 + 1).cast("int")), F.lit("\n"), F.coalesce("text", F.lit("")))
    x = b.read(spark, d, "documents").select("doc_id", markup.prose_lines(body).alias("l"))
    kept = F.filter("l", lambda y: y["prose"])
    return x.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.size(kept).cast("long").alias("n_prose"), F.md5(F.array_join(F.transform(kept, lambda y: y["line"]), "\n").cast("binary")).alias("digest"))

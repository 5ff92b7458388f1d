"""Pages, claims, diary, facts and index upkeep over derived relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.operators import diffs, markup, wiki

from . import bindings as b
from .registry import query
from .text_queries import claim_hash_sql

@query(b.sql(r"""SELECT conv_id, msg_id, substr(trim(regexp_replace(regexp_replace(content, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), 1, 120) AS snippet FROM (
SELECT conv_id, msg_id, content, row_number() OVER (PARTITION BY conv_id ORDER BY seq, msg_id) AS rn FROM (SELECT conv_id, conv_id || ':' || (seq // 2) AS msg_id, min(seq) AS seq, arg_min(content, seq) AS content FROM messages GROUP BY ALL)) WHERE rn <= 3""", "messages"))
def evidence_index(spark, d):
    m = b.messages(spark, d).withColumn("msg_id", F.concat_ws(":", F.col("conv_id").cast("string"), F.expr("seq div 2").cast("string")))
    return wiki.evidence_index(m, 3)


def _claims(spark, d):
    """Every line of every document as a claim."""
    r = F.col("doc_id")
    x = b.read(spark, d, "documents").select(r, "source", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    x = x.select(F.col("source").alias("page_slug"), F.struct(r, "n").alias("pos"), F.when(r % 3 == 0, " null ").when(r % 3 == 1, F.concat(F.lit(" sec "), "lang")).alias("section"), F.concat(F.when(r % 7 == 0, "AI: ").otherwise(" "), "line").alias("claim_text"), ((r + F.col("n")) % 40).cast("string").alias("source_msg_id"), F.concat(F.lit("c"), r.cast("string")).alias("conv_id"))
    valid = spark.range(0, 20).select(F.col("id").cast("string").alias("msg_id"))
    return wiki.claim_rows(x, valid)


_CLAIMS = rf"""raw AS (SELECT source AS page_slug, doc_id, n, CASE doc_id % 3 WHEN 0 THEN ' null ' WHEN 1 THEN ' sec ' || lang END AS section,
regexp_replace(CASE WHEN doc_id % 7 = 0 THEN 'AI: ' ELSE ' ' END || line, '^\s+|\s+$', '', 'g') AS claim_text, (doc_id + n) % 40 AS m, 'c' || doc_id AS conv_id
FROM (SELECT doc_id, source, lang, unnest(l) AS line, unnest(range(0, len(l))) AS n FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
hashed AS (SELECT *, {claim_hash_sql('claim_text')} AS claim_hash FROM raw WHERE claim_text <> '' AND NOT starts_with(claim_text, 'AI:')),
claims AS (SELECT page_slug, claim_hash, claim_text, CASE WHEN lower(nullif(trim(section), '')) NOT IN ('null', 'none') THEN trim(section) END AS section, CASE WHEN m < 20 THEN conv_id END AS source_conv_id, CASE WHEN m < 20 THEN m::VARCHAR END AS source_msg_id
FROM (SELECT *, row_number() OVER (PARTITION BY page_slug, claim_hash ORDER BY doc_id, n) AS rn FROM hashed) WHERE rn = 1)"""


@query(f"WITH {_CLAIMS} SELECT * FROM claims")
def claim_rows(spark, d):
    return _claims(spark, d)


@query(f"""WITH {_CLAIMS}, o AS (SELECT page_slug, claim_hash FROM claims WHERE section IS NULL), n AS (SELECT page_slug, claim_hash FROM claims WHERE source_msg_id IS NOT NULL)
SELECT page_slug, count(*) FILTER (WHERE o.claim_hash IS NULL) AS added, count(*) FILTER (WHERE n.claim_hash IS NULL) AS struck, count(n.claim_hash) AS n_claims FROM o FULL JOIN n USING (page_slug, claim_hash) GROUP BY page_slug""")
def claim_changes(spark, d):
    c = _claims(spark, d)
    return wiki.claim_changes(c.where("section is null"), c.where("source_msg_id is not null"))


def _wiki(spark, d):
    r = F.col("doc_id")
    x = b.read(spark, d, "documents").select(F.concat(F.lit("p"), r.cast("string")).alias("slug"), r, F.coalesce("text", F.lit("")).alias("body"))
    pages = x.where("doc_id % 4 <> 3").select("slug", (r % 3 + 1).cast("int").alias("rev"), "body")
    log = x.where("doc_id % 10 = 0 and doc_id % 4 <> 3").select(F.concat(F.lit("m"), r.cast("string")).alias("merge_id"), "slug", (r % 3 + 1).cast("int").alias("rev"), F.lit("old").alias("before"))
    staged = x.where("doc_id % 2 = 0 or doc_id % 4 = 3").select(F.concat(F.lit("m"), r.cast("string")).alias("merge_id"), "slug", F.when(r % 4 == 3, 0).otherwise((r % 2 + 1)).cast("int").alias("base_rev"), F.lit("new").alias("body"))
    return pages, log, staged


@query("""SELECT 'p' || doc_id AS slug, CAST(CASE WHEN doc_id % 4 = 3 THEN 1 WHEN hit THEN doc_id % 3 + 2 ELSE doc_id % 3 + 1 END AS INT) AS rev, CASE WHEN doc_id % 4 = 3 OR hit THEN 'new' ELSE coalesce(text, '') END AS body
FROM (SELECT *, doc_id % 2 = 0 AND doc_id % 10 <> 0 AND doc_id % 2 + 1 = doc_id % 3 + 1 AS hit FROM documents)""")
def wiki_apply(spark, d):
    pages, log, staged = _wiki(spark, d)
    return wiki.apply_merges(pages, log, staged)[0].select("slug", F.col("rev").cast("int").alias("rev"), "body")


@query("""SELECT 'p' || doc_id AS slug, CAST(CASE WHEN doc_id % 10 = 0 AND doc_id % 3 = 0 THEN doc_id % 3 + 2 ELSE doc_id % 3 + 1 END AS INT) AS rev, CASE WHEN doc_id % 10 = 0 AND doc_id % 3 = 0 THEN 'old' ELSE coalesce(text, '') END AS body FROM documents WHERE doc_id % 4 <> 3""")
def wiki_rollback(spark, d):
    pages, log, _ = _wiki(spark, d)
    ids = b.read(spark, d, "documents").where("doc_id % 3 = 0").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("merge_id"))
    return wiki.rollback(pages, log, ids).select("slug", F.col("rev").cast("int").alias("rev"), "body")


def _neighbours(spark, d):
    m = b.messages(spark, d)
    nxt = m.select("conv_id", (F.col("seq") - 1).alias("seq"), F.col("content").alias("after"))
    return m.join(nxt, ["conv_id", "seq"])


@query()
def page_diffs(spark, d):
    """Diffs of neighbouring messages; of several least scripts SQL can't name one, so tests apply them as patches."""
    return diffs.unified(_neighbours(spark, d), ["conv_id", "seq"], "content", "after", F.col("conv_id").cast("string"))


_LINES = "list_filter(list_zip(string_split(coalesce({0}, ''), chr(10)), range(1, len(string_split(coalesce({0}, ''), chr(10))) + 1)), lambda z: z[1] <> '' OR z[2] < len(string_split(coalesce({0}, ''), chr(10))))"


@query(b.sql(f"""SELECT * FROM (WITH RECURSIVE p AS MATERIALIZED (SELECT a.conv_id, a.seq, list_transform({_LINES.format('a.content')}, lambda z: z[1]) AS x, list_transform({_LINES.format('b.content')}, lambda z: z[1]) AS y FROM messages a JOIN messages b ON b.conv_id = a.conv_id AND b.seq = a.seq + 1),
r AS (SELECT conv_id, seq, x, y, 0 AS i, list_transform(range(len(y) + 1), lambda j: 0) AS l FROM p UNION ALL
SELECT conv_id, seq, x, y, i + 1, list_prepend(0, list_transform(range(1, len(y) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda t: CASE WHEN y[t] = x[i + 1] THEN l[t] + 1 ELSE l[t + 1] END)))) FROM r WHERE i < len(x))
SELECT conv_id, seq, CAST(len(y) - l[len(y) + 1] AS BIGINT) AS added, CAST(len(x) - l[len(y) + 1] AS BIGINT) AS removed FROM r WHERE i = len(x))""", "messages"))
def line_edits(spark, d):
    """The least numbers of lines to add and to remove between neighbouring messages."""
    return diffs.unified(_neighbours(spark, d), ["conv_id", "seq"], "content", "after", F.lit("x")).select("conv_id", "seq", "added", "removed")


@query(b.sql("""WITH p AS (SELECT a.conv_id, a.seq, a.content AS x, b.content AS y FROM messages a JOIN messages b ON b.conv_id = a.conv_id AND b.seq = a.seq + 1),
l AS (SELECT conv_id, seq, line, sum(o) AS o, sum(n) AS n FROM (SELECT conv_id, seq, unnest(string_split(coalesce(x, ''), chr(10))) AS line, 1 AS o, 0 AS n FROM p UNION ALL SELECT conv_id, seq, unnest(string_split(coalesce(y, ''), chr(10))), 0, 1 FROM p) GROUP BY ALL)
SELECT conv_id, seq, CAST(sum(greatest(n - o, 0)) AS BIGINT) AS added, CAST(sum(greatest(o - n, 0)) AS BIGINT) AS removed FROM l GROUP BY conv_id, seq""", "messages"))
def line_changes(spark, d):
    """How many lines come and go between neighbouring messages, whatever their order."""
    return wiki.line_changes(_neighbours(spark, d), ["conv_id", "seq"], "content", "after")


@query(r"""SELECT doc_id, array_to_string(list_filter(['long-diff', 'thin-evidence'], lambda x: (x = 'long-diff' AND n > 20) OR (x = 'thin-evidence' AND doc_id % 5 > 0 AND (doc_id % 3)::DOUBLE / (doc_id % 5) < 0.5)), ',') AS flags FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL)""")
def review_flags(spark, d):
    r = F.col("doc_id")
    return b.read(spark, d, "documents").where("text is not null").select(r, F.array_join(wiki.review_flags(F.size(F.split("text", "\n")), r % 5, r % 3, 20), ",").alias("flags"))


_CLEAN = r"trim(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(x, '\[\[[^\]|]*\|([^\]]+)\]\]', '\1', 'g'), '\[\[([^\]|#]+)(?:#[^\]|]+)?\]\]', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '**', ''), '__', ''), '`', ''))"
_STRIPPED = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
_MARKED = "(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Head ' || doc_id || ' — tail' ELSE 'Plain ' || doc_id END AS title, CASE WHEN doc_id % 4 = 1 THEN '## x' || chr(10) || '# One - two' || chr(10) ELSE '> no' || chr(10) || '**[See](u)** [[a|b]] ' END || coalesce(text, '') AS body FROM documents)"


@query(rf"""WITH l AS (SELECT doc_id, title, list_transform(string_split(body, chr(10)), lambda x: {_STRIPPED}) AS l FROM {_MARKED}),
p AS (SELECT doc_id, title, coalesce(list_filter(list_transform(list_filter(l, lambda x: x <> '' AND NOT regexp_matches(x, '^[#><\-|!_`]')), lambda x: {_CLEAN}), lambda x: x <> '')[1], '') AS s, trim(substr(coalesce(list_filter(l, lambda x: starts_with(x, '# '))[1], ''), 3)) AS h1 FROM l),
q AS (SELECT *, CASE WHEN instr(s, '。') BETWEEN 1 AND 47 THEN instr(s, '。') WHEN instr(s, '！') BETWEEN 1 AND 47 THEN instr(s, '！') WHEN instr(s, '!') BETWEEN 1 AND 47 THEN instr(s, '!') WHEN instr(s, '. ') BETWEEN 1 AND 47 THEN instr(s, '. ') END AS cut FROM p)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Head ' || doc_id ELSE title END AS short, CASE WHEN doc_id % 4 = 0 THEN 'tail' WHEN h1 = 'One - two' THEN 'two' WHEN cut IS NOT NULL THEN substr(s, 1, cut - 1) WHEN length(s) > 46 THEN substr(s, 1, 46) || '…' ELSE s END AS description FROM q""")
def page_lede(spark, d):
    """Titles with and without a subtitle, headings with one, and prose after markup."""
    r = F.col("doc_id")
    title = F.when(r % 4 == 0, F.concat(F.lit("Head "), r.cast("string"), F.lit(" — tail"))).otherwise(F.concat(F.lit("Plain "), r.cast("string")))
    body = F.concat(F.when(r % 4 == 1, "## x\n# One - two\n").otherwise("> no\n**[See](u)** [[a|b]] "), F.coalesce("text", F.lit("")))
    short, description = wiki.lede(title, body)
    return b.read(spark, d, "documents").select("doc_id", short.alias("short"), description.alias("description"))


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, CASE WHEN day_no % 3 = 0 THEN 'skip-exists' WHEN n % 5 = 0 THEN 'skip-empty' WHEN n % 2 = 0 THEN 'skip-degenerate' ELSE 'written' END AS status FROM (SELECT *, day - DATE '2020-01-01' AS day_no FROM e)""")
def diary_status(spark, d):
    e = b.read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n_convs"))
    days = e.withColumn("transcript", F.when(F.col("n_convs") % 5 != 0, "[USER] x")).withColumn("body", F.when(F.col("n_convs") % 2 == 0, "Human: write").otherwise("A day of many small things, told at some length."))
    there = e.where(F.datediff("day", F.lit("2020-01-01").cast("date")) % 3 == 0)
    return wiki.diary_status(days, there).select(F.col("day").cast("string").alias("day"), "status")


@query(b.sql(r"""WITH p AS (SELECT conv_id, list_filter(list_transform(list(content ORDER BY seq), lambda x: regexp_replace(CASE WHEN length(x) % 3 = 0 THEN 'User: ' || x ELSE x END, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^\s*User:')) AS f FROM messages WHERE content IS NOT NULL GROUP BY conv_id)
SELECT conv_id, unnest(CASE WHEN len(f) > 0 THEN f[1:4] ELSE [''] END) AS fact_text FROM p""", "messages"))
def clean_facts(spark, d):
    m = b.messages(spark, d).where("content is not null").withColumn("content", F.when(F.length("content") % 3 == 0, F.concat(F.lit("User: "), "content")).otherwise(F.col("content")))
    g = m.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]).alias("facts"))
    return wiki.clean_facts(g, 4)


@query("""SELECT source AS repo, doc_id::VARCHAR AS path, CASE WHEN source NOT IN ('src0', 'src1', 'src2') THEN 'delisted' WHEN doc_id % 5 = 0 THEN 'vanished' WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS kind FROM documents WHERE NOT (doc_id % 5 = 0 AND doc_id % 7 = 0)""")
def index_plan(spark, d):
    r = F.col("doc_id")
    x = b.read(spark, d, "documents").select(F.col("source").alias("repo"), r.cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"), r)
    known = x.where("doc_id % 7 <> 0").withColumn("sha", F.when(r % 3 == 0, "old").otherwise(F.col("sha")))
    return wiki.index_plan(x.where("doc_id % 5 <> 0"), known, ["src0", "src1", "src2"])


@query("SELECT min(doc_id) AS first, max(doc_id) AS last, count(*) AS n FROM (SELECT doc_id FROM documents WHERE doc_id % 3 = 1 ORDER BY doc_id LIMIT 50)")
def batch_bounds(spark, d):
    return wiki.batch_bounds(b.read(spark, d, "documents").where("doc_id % 3 = 1"), "doc_id", 50)


@query(b.sql("SELECT tenant_id, team_id, count(DISTINCT owner_user_id) AS n_users, count(*) AS n_threads FROM threads GROUP BY ALL", "threads"))
def team_counts(spark, d):
    return b.threads(spark, d).groupBy("tenant_id", "team_id").agg(F.count_distinct("owner_user_id").alias("n_users"), F.count(F.lit(1)).alias("n_threads"))


@query(b.sql("SELECT CAST(entry_date AS VARCHAR) AS entry_date, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS window_days FROM (SELECT a.entry_date, b.entry_date AS p, row_number() OVER (PARTITION BY a.entry_date ORDER BY b.entry_date DESC) AS rn FROM diary a JOIN diary b ON b.entry_date < a.entry_date) WHERE rn <= 3 GROUP BY entry_date", "diary"))
def prior_window(spark, d):
    """The last three entries before each: a bounded frame, so no self join."""
    from pyspark.sql import Window

    w = Window.orderBy("entry_date").rowsBetween(-3, -1)
    x = b.diary(spark, d).withColumn("p", F.collect_list("entry_date").over(w)).where(F.size("p") > 0)
    return x.select(F.col("entry_date").cast("string").alias("entry_date"), F.array_join(F.transform(F.array_sort("p"), lambda t: t.cast("string")), ",").alias("window_days"))


@query("SELECT doc_id, sha256('t' || (doc_id % 2) || chr(0) || source || chr(0) || lang || chr(0) || doc_id) AS identity FROM documents")
def sql_functions(spark, d):
    """The registered SQL function gives what the column function gives."""
    wiki.register_sql_functions(spark)
    return b.read(spark, d, "documents").select("doc_id", F.expr("source_identity(concat('t', doc_id % 2), source, lang, cast(doc_id as string))").alias("identity"))




@query("""SELECT 'p' || doc_id AS slug, coalesce(text, '') || chr(10) || 'see ' || CASE WHEN doc_id * 3 % 700 IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) THEN '[T' || (doc_id * 3 % 700) || '](/p' || (doc_id * 3 % 700) || ')' ELSE 'p' || (doc_id * 3 % 700) END || ' and ' ||
CASE WHEN doc_id % 2 = 0 THEN '[here](/p' || doc_id || '#top)' ELSE 'here' END || ' `[[p1]]`' || chr(10) || '```' || chr(10) || '[[p2]]' || chr(10) || '```' || chr(10) || 'none [x]' AS body FROM documents""")
def page_links(spark, d):
    """Links become titled links where there is a page; code keeps its brackets."""
    s = b.read(spark, d, "documents").select(F.col("doc_id").alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    text = F.concat("t", F.lit("\nsee [[p"), (F.col("i") * 3 % 700).cast("string"), F.lit("]] and [[p"), F.col("i").cast("string"), F.lit("#top|here]] `[[p1]]`\n```\n[[p2]]\n```\n[[none]] [x]"))
    slug = F.concat(F.lit("p"), F.col("i").cast("string"))
    return markup.link_pages(s.select(slug.alias("slug"), text.alias("body")), s.where("i % 2 = 0").select(slug.alias("slug"), F.concat(F.lit("T"), F.col("i").cast("string")).alias("title")))


@query(r"SELECT page_id, length(x) AS n, md5(x) AS digest FROM (SELECT page_id, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->', '', 'g') AS x FROM pages)")
def claims_input(spark, d):
    """Pages without scripts, styles and comments."""
    x = b.read(spark, d, "pages").select("page_id", markup.without_code(F.col("html")).alias("x"))
    return x.select("page_id", F.length("x").cast("long").alias("n"), F.md5(F.col("x").cast("binary")).alias("digest"))


@query("SELECT doc_id, doc_id % 4 IN (0, 1) OR (doc_id % 4 = 2 AND doc_id % 3 <> 0) AS referenced FROM documents")
def code_references(spark, d):
    r = F.col("doc_id")
    name = F.concat(F.lit("fn"), r.cast("string"))
    code = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.when(r % 4 == 0, F.concat(F.lit("x = 1\nfrom pkg.mod"), r.cast("string"), F.lit(" import y"))).when(r % 4 == 1, F.concat(F.lit("import {a} from './mod"), r.cast("string"), F.lit("'"))).when(r % 4 == 2, F.concat(F.lit("y = "), name, F.lit("(2)"))).otherwise(F.concat(F.lit("def "), name, F.lit("(x):\n  pass"))))
    new = F.when(r % 3 == 0, F.concat(F.lit("A."), name)).otherwise("other")
    return b.read(spark, d, "documents").select("doc_id", markup.has_reference(code, F.concat(F.lit("src/mod"), r.cast("string"), F.lit(".py")), F.concat(F.lit("K."), name), new).alias("referenced"))

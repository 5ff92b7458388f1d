"""The relations of the data model, derived from the given tables, in Spark and in SQL.

The given tables have no platforms, owners, memories or links; these follow from ids by fixed rules, the same in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-09-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def messages(spark: SparkSession, d: str) -> DataFrame:
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), cast(turn as int), 0)")
    owner = F.concat(F.lit("u"), (F.col("conv_id") % 5).cast("string"))
    tenant = F.concat(F.lit("t"), (F.col("conv_id") % 2).cast("string"))
    return read(spark, d, "conversations").select(F.col("conv_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), ts.alias("ts"), owner.alias("owner_user_id"), tenant.alias("tenant_id"))


def threads(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    user = F.col("role") == "user"
    t = m.groupBy("conv_id").agg(F.count(F.lit(1)).alias("msg_count"), F.min("ts").alias("started_at"), F.max("ts").alias("last_ts"), F.substring(F.min_by("content", F.when(user, F.col("seq"))), 1, 80).alias("title"))
    r = F.col("conv_id")
    return t.select(
        "conv_id",
        F.element_at(F.array(*map(F.lit, ("claude_code", "chatgpt", "claude_ai", "codex"))), (r % 4 + 1).cast("int")).alias("platform"),
        "title",
        "started_at",
        F.when(r % 3 != 0, F.col("last_ts")).alias("ended_at"),
        "msg_count",
        F.when(r % 5 == 0, "").otherwise(F.concat(F.lit("topic"), (r % 6).cast("string"))).alias("dominant_topic"),
        F.when(r % 11 == 0, "__no_project__").when(r % 13 == 0, "__excluded__").otherwise(F.concat(F.lit("proj"), (r % 7).cast("string"))).alias("project_slug"),
        F.concat(F.lit("t"), (r % 2).cast("string")).alias("tenant_id"),
        F.concat(F.lit("u"), (r % 5).cast("string")).alias("owner_user_id"),
        F.element_at(F.array(*map(F.lit, ("private", "team", "org"))), (r % 3 + 1).cast("int")).alias("visibility"),
        F.when(r % 3 == 1, F.concat(F.lit("team"), (r % 4).cast("string"))).alias("team_id"),
    )


def corpus(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("doc_id")
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dense"), "label")
    return (
        read(spark, d, "documents")
        .join(e, "doc_id", "left")
        .select(
            "doc_id",
            "text",
            "lang",
            "source",
            "dense",
            "label",
            F.concat(F.lit("t"), (r % 2).cast("string")).alias("tenant_id"),
            F.concat(F.lit("u"), (r % 5).cast("string")).alias("owner_user_id"),
            F.element_at(F.array(*map(F.lit, ("private", "team", "org"))), (r % 3 + 1).cast("int")).alias("visibility"),
            F.when(r % 3 == 1, F.concat(F.lit("team"), (r % 4).cast("string"))).alias("team_id"),
        )
    )


def query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> DataFrame:
    """One row: qv."""
    return read(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("qv"))


def memories(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("doc_id")
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dense"))
    day = lambda n: F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast({n} as int), 0, 0, 0)")
    link = F.concat(F.lit("\n[[M"), ((r * 7 + 3) % 1500).cast("string"), F.lit("|next]] see `[[code]]` and [[:space:]] [[m"), r.cast("string"), F.lit("]]"))
    return (
        read(spark, d, "documents")
        .join(e, "doc_id", "left")
        .select(
            r.alias("id"),
            F.concat(F.lit("c"), (r % 3).cast("string")).alias("chassis_id"),
            "source",
            F.concat(F.lit("src"), (r % 3).cast("string")).alias("source_project"),
            F.concat(F.lit("m"), r.cast("string")).alias("source_stem"),
            F.concat(F.col("text"), link).alias("body"),
            F.element_at(F.array(*map(F.lit, ("shared", "shared-restricted", "shared", "local"))), (r % 4 + 1).cast("int")).alias("scope"),
            "dense",
            day("doc_id % 200").alias("first_dubbed_at"),
            day("doc_id % 200 + doc_id % 50").alias("last_dubbed_at"),
            F.when(r % 13 == 0, day("240")).alias("deleted_at"),
        )
    )


def telemetry(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("doc_id")
    last = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 200 + doc_id % 41 as int), 0, 0, 0)")
    return read(spark, d, "labels").select(r.alias("memory_pk"), (r % 11).cast("int").alias("activation_count"), F.col("quality").alias("incident_prevention"), (r % 3).cast("int").alias("user_endorsement"), F.col("toxic").alias("user_correction"), ((r % 10) / 10.0).alias("prediction_error_ewma"), F.when(r % 4 != 0, last).alias("last_activated_at"))


def allowlist(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("doc_id % 8 = 1").select(F.col("doc_id").alias("memory_pk"), F.lit("src1").alias("allowed_project"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """A link from each memory to (7 id + 3) mod 1500, or to (5 id + 1) mod 400 for every third; missing ones dangle."""
    m = memories(spark, d).select("id")
    one = m.select(F.col("id").alias("source_memory_pk"), ((F.col("id") * 7 + 3) % 1500).alias("n"))
    two = m.where("id % 3 = 0").select(F.col("id").alias("source_memory_pk"), ((F.col("id") * 5 + 1) % 400).alias("n"))
    e = one.union(two).distinct()
    return e.join(m.withColumnRenamed("id", "n"), "n", "left_semi").withColumn("target_memory_pk", F.col("n")).unionByName(e.join(m.withColumnRenamed("id", "n"), "n", "left_anti").withColumn("target_memory_pk", F.lit(None).cast("long"))).select("source_memory_pk", F.concat(F.lit("m"), F.col("n").cast("string")).alias("target_slug"), "target_memory_pk")


def completions(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    outcome = F.element_at(F.array(*map(F.lit, ("ok", "unparseable", "embed_error", "no_hit"))), (k % 4 + 1).cast("int"))
    e = read(spark, d, "events")
    return e.select("event_id", "ts", F.col("event_type").alias("source"), F.floor("value").cast("int").alias("elapsed_ms"), F.when(F.col("value") > 100, 1).otherwise(0).alias("fired_count"), outcome.alias("outcome_reason"), (F.col("event_id") % 5).cast("int").alias("eligible_chunks"), (F.col("event_id") % 97 == 0).alias("timed_out"))


def advisories(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    r = F.col("event_id")
    return e.select(r, "ts", F.col("event_type").alias("source"), (F.col("value") > 50).alias("fired"), F.round(F.col("value") / 1000, 6).alias("sim"), F.when(r % 17 == 0, "tests/live_probe.js").when(r % 4 != 0, F.concat(F.lit("src/f"), (r % 50).cast("string"), F.lit(".py"))).alias("new_path"), F.lit(None).cast("string").alias("hit_path"), F.concat(F.lit("repo"), (r % 6).cast("string")).alias("cwd_repo"), F.concat(F.lit("fn"), (r % 40).cast("string")).alias("new_symbol"), (r % 30).alias("hit_chunk_id"))


def diary(spark: SparkSession, d: str) -> DataFrame:
    """One entry for each day of events, with the vector of the day's number mod 500."""
    day = read(spark, d, "events").groupBy(F.to_date("ts").alias("entry_date")).agg(F.count(F.lit(1)).alias("conv_count"))
    day = day.withColumn("vec_id", (F.datediff("entry_date", F.lit("2020-01-01").cast("date")) % 500).cast("long"))
    return day.join(read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("dense")), "vec_id", "left")


def message_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Messages with an id and a vector, that of (8 conv_id + seq) mod 500; some have none."""
    m = messages(spark, d).withColumn("id", F.col("conv_id") * 1000 + F.col("seq")).withColumn("vec_id", (F.col("conv_id") * 8 + F.col("seq")) % 500)
    return m.join(read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("dense")), "vec_id", "left").drop("vec_id")


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """A label for each label of vectors; threads are of cluster conv_id mod 13, which some clusters lack."""
    return read(spark, d, "embeddings").where("label % 3 <> 0").select(F.col("label").cast("long").alias("cluster_id"), F.concat(F.lit("cluster "), F.col("label").cast("string")).alias("cluster_label")).distinct()


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Every line of an assistant's message as a fact of its thread."""
    m = messages(spark, d).where("role = 'assistant'").select("conv_id", "seq", "ts", F.posexplode(F.split("content", "\n")).alias("n", "fact_text")).where("fact_text <> ''")
    m = m.select((F.col("conv_id") * 1_000_000 + F.col("seq") * 1000 + F.col("n")).alias("id"), "conv_id", "fact_text", F.col("ts").alias("extracted_at"), ((F.col("conv_id") * 8 + F.col("seq") + F.col("n")) % 500).alias("vec_id"))
    return m.join(read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("dense")), "vec_id", "left").drop("vec_id")


def diary_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries with the first message of thread vec_id mod 90 as their body."""
    first = messages(spark, d).where("seq = 0").select(F.col("conv_id").alias("k"), F.col("content").alias("body"))
    return diary(spark, d).withColumn("k", F.col("vec_id") % 90).join(first, "k", "left").drop("k")


VIEWS = {
    "message_vectors": "SELECT m.*, conv_id * 1000 + seq AS id, CAST(e.embedding AS DOUBLE[]) AS dense FROM messages m LEFT JOIN embeddings e ON e.vec_id = (conv_id * 8 + seq) % 500",
    "clusters": "SELECT DISTINCT label AS cluster_id, 'cluster ' || label AS cluster_label FROM embeddings WHERE label % 3 <> 0",
    "facts": """SELECT f.*, CAST(e.embedding AS DOUBLE[]) AS dense FROM (SELECT conv_id * 1000000 + seq * 1000 + n AS id, conv_id, fact_text, ts AS extracted_at, (conv_id * 8 + seq + n) % 500 AS vec_id
        FROM (SELECT conv_id, seq, ts, unnest(l) AS fact_text, unnest(range(0, len(l))) AS n FROM (SELECT *, string_split(content, chr(10)) AS l FROM messages WHERE role = 'assistant')) WHERE fact_text <> '') f LEFT JOIN embeddings e USING (vec_id)""",
    "diary_entries": "SELECT d.*, m.content AS body FROM diary d LEFT JOIN messages m ON m.seq = 0 AND m.conv_id = d.vec_id % 90",
    "messages": "SELECT conv_id, turn AS seq, role, text AS content, TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS ts, 'u' || (conv_id % 5) AS owner_user_id, 't' || (conv_id % 2) AS tenant_id FROM conversations",
    "threads": """SELECT conv_id, ['claude_code', 'chatgpt', 'claude_ai', 'codex'][conv_id % 4 + 1] AS platform,
        substr(arg_min(content, seq) FILTER (WHERE role = 'user'), 1, 80) AS title, min(ts) AS started_at,
        CASE WHEN conv_id % 3 <> 0 THEN max(ts) END AS ended_at, count(*) AS msg_count,
        CASE WHEN conv_id % 5 = 0 THEN '' ELSE 'topic' || (conv_id % 6) END AS dominant_topic,
        CASE WHEN conv_id % 11 = 0 THEN '__no_project__' WHEN conv_id % 13 = 0 THEN '__excluded__' ELSE 'proj' || (conv_id % 7) END AS project_slug,
        't' || (conv_id % 2) AS tenant_id, 'u' || (conv_id % 5) AS owner_user_id, ['private', 'team', 'org'][conv_id % 3 + 1] AS visibility,
        CASE WHEN conv_id % 3 = 1 THEN 'team' || (conv_id % 4) END AS team_id FROM messages GROUP BY conv_id""",
    "corpus": """SELECT d.doc_id, d.text, d.lang, d.source, CAST(e.embedding AS DOUBLE[]) AS dense, e.label, 't' || (doc_id % 2) AS tenant_id,
        'u' || (doc_id % 5) AS owner_user_id, ['private', 'team', 'org'][doc_id % 3 + 1] AS visibility,
        CASE WHEN doc_id % 3 = 1 THEN 'team' || (doc_id % 4) END AS team_id FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
    "qvec": "SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0",
    "memories": """SELECT doc_id AS id, 'c' || (doc_id % 3) AS chassis_id, 'src' || (doc_id % 3) AS source_project, 'm' || doc_id AS source_stem,
        text || chr(10) || '[[M' || ((doc_id * 7 + 3) % 1500) || '|next]] see `[[code]]` and [[:space:]] [[m' || doc_id || ']]' AS body,
        ['shared', 'shared-restricted', 'shared', 'local'][doc_id % 4 + 1] AS scope, CAST(e.embedding AS DOUBLE[]) AS dense,
        TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 200 AS INT)) AS first_dubbed_at,
        TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 200 + doc_id % 50 AS INT)) AS last_dubbed_at,
        CASE WHEN doc_id % 13 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(240) END AS deleted_at
        FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
    "telemetry": """SELECT doc_id AS memory_pk, doc_id % 11 AS activation_count, quality AS incident_prevention, doc_id % 3 AS user_endorsement,
        toxic AS user_correction, CAST(doc_id % 10 AS DOUBLE) / 10.0 AS prediction_error_ewma,
        CASE WHEN doc_id % 4 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 200 + doc_id % 41 AS INT)) END AS last_activated_at FROM labels""",
    "allowlist": "SELECT doc_id AS memory_pk, 'src1' AS allowed_project FROM documents WHERE doc_id % 8 = 1",
    "edges": """SELECT e.s AS source_memory_pk, 'm' || e.n AS target_slug, d.doc_id AS target_memory_pk FROM (
        SELECT doc_id AS s, (doc_id * 7 + 3) % 1500 AS n FROM documents UNION SELECT doc_id, (doc_id * 5 + 1) % 400 FROM documents WHERE doc_id % 3 = 0) e
        LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d ON d.doc_id = e.n""",
    "completions": """SELECT event_id, ts, event_type AS source, CAST(floor(value) AS INT) AS elapsed_ms, CASE WHEN value > 100 THEN 1 ELSE 0 END AS fired_count,
        ['ok', 'unparseable', 'embed_error', 'no_hit'][CAST(json_extract_string(props, '$.k') AS INT) % 4 + 1] AS outcome_reason,
        event_id % 5 AS eligible_chunks, event_id % 97 = 0 AS timed_out FROM events""",
    "advisories": """SELECT event_id, ts, event_type AS source, value > 50 AS fired, round(value / 1000, 6) AS sim,
        CASE WHEN event_id % 17 = 0 THEN 'tests/live_probe.js' WHEN event_id % 4 <> 0 THEN 'src/f' || (event_id % 50) || '.py' END AS new_path,
        'repo' || (event_id % 6) AS cwd_repo, 'fn' || (event_id % 40) AS new_symbol, event_id % 30 AS hit_chunk_id FROM events""",
    "diary": """SELECT x.*, CAST(e.embedding AS DOUBLE[]) AS dense FROM (SELECT CAST(ts AS DATE) AS entry_date, count(*) AS conv_count,
        (CAST(ts AS DATE) - DATE '2020-01-01') % 500 AS vec_id FROM events GROUP BY CAST(ts AS DATE)) x LEFT JOIN embeddings e USING (vec_id)""",
    "visible": """SELECT m.* FROM memories m WHERE deleted_at IS NULL AND (scope = 'shared' OR (scope = 'shared-restricted'
        AND id IN (SELECT memory_pk FROM allowlist WHERE allowed_project = 'src1')))""",
    "enriched": """SELECT v.*, t.last_activated_at, coalesce(t.activation_count, 0) * 0.2::DOUBLE + coalesce(t.incident_prevention, 0) * 0.5::DOUBLE + coalesce(t.user_endorsement, 0) * 0.3::DOUBLE
        - coalesce(t.user_correction, 0) * 0.4::DOUBLE - coalesce(t.prediction_error_ewma, 0.0) * 0.2::DOUBLE + CASE WHEN scope IN ('shared', 'shared-restricted') THEN 0.1 ELSE 0.0 END AS base_score,
        exp(-(epoch(TIMESTAMP '2024-09-01 00:00:00') - epoch(coalesce(t.last_activated_at, v.first_dubbed_at))) / 2592000.0) AS recency_factor,
        coalesce(greatest(list_cosine_similarity(v.dense, q.qv), 0), 0) AS semantic_sim, q.qv FROM visible v LEFT JOIN telemetry t ON t.memory_pk = v.id CROSS JOIN qvec q""",
}

NEEDS = {"message_vectors": ["messages"], "facts": ["messages"], "diary_entries": ["diary", "messages"], "threads": ["messages"], "visible": ["memories", "allowlist"], "enriched": ["visible", "telemetry", "qvec"]}


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """The query with the views that it needs before it."""
    order: list[str] = []

    def add(v: str) -> None:
        for x in NEEDS.get(v, []):
            add(x)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    ctes = ",\n".join(f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in order)
    body = body.strip()
    if not ctes:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    if body[:5].upper() == "WITH ":
        return f"{head}{ctes},\n{body[5:]}"
    return f"{head}{ctes}\n{body}"

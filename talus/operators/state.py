"""State transitions as pure functions: old and new rows in, the next state out.

Parquet has no MERGE; each transition is an anti join and a union, or one full join, and writers replace the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.text import redacted_brief


def upsert(old: DataFrame, new: DataFrame, key: str, latest: list[str], first: list[str]) -> DataFrame:
    """latest: the new value wins where there is a new row; first: a value that is not null is never replaced."""
    o = old.select(key, *[F.col(c).alias(f"o_{c}") for c in latest + first], F.lit(True).alias("had"))
    n = new.select(key, *[F.col(c).alias(f"n_{c}") for c in latest + first], F.lit(True).alias("has"))
    both = o.join(n, key, "full")
    take_new = F.coalesce("has", F.lit(False))
    return both.select(key, *[F.when(take_new, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in latest], *[F.coalesce(f"o_{c}", f"n_{c}").alias(c) for c in first])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """New rows with new keys, one a key: the first by `order`, and by the other columns where that ties, so reruns agree."""
    rest = [c for c in new.columns if c not in keys]
    by = [c for c in order or [] if c in rest] + [c for c in rest if c not in (order or [])]
    first = new.groupBy(*keys).agg(F.min(F.struct(*by)).alias("__row")).select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest]) if rest else new.select(*keys).distinct()
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def bump(telemetry: DataFrame, ids: DataFrame, visible: DataFrame, as_of: Column) -> DataFrame:
    """Each distinct visible id has one more activation; ids without a row get one."""
    hit = ids.select(F.explode("ids").alias("memory_pk")).distinct().join(visible.select(F.col("id").alias("memory_pk")), "memory_pk", "left_semi").withColumn("hit", F.lit(1))
    t = telemetry.join(hit, "memory_pk", "full")
    return t.select("memory_pk", (F.coalesce("activation_count", F.lit(0)) + F.coalesce("hit", F.lit(0))).alias("activation_count"), F.when(F.col("hit") == 1, as_of).otherwise(F.col("last_activated_at")).alias("last_activated_at"))


def purge_counts(slug: str, reason: str, threads: DataFrame, messages: DataFrame, memories: DataFrame) -> DataFrame:
    """What a purge of the project would delete, as one audit row; sentinels and blank reasons are refused."""
    if not slug or slug.startswith("__"):
        raise ValueError(f"refusing to purge {slug!r}")
    if not reason or not reason.strip():
        raise ValueError("a purge needs a reason")
    gone = threads.where(F.col("project_slug") == slug)
    m = messages.join(gone.select("conv_id"), "conv_id", "left_semi").agg(F.count(F.lit(1)).alias("messages"))
    g = memories.where(F.col("source_project") == slug).agg(F.count(F.lit(1)).alias("memories"))
    counts = gone.agg(F.count(F.lit(1)).alias("conversations")).crossJoin(m).crossJoin(g)  # one row each
    return counts.select(F.lit(slug).alias("project_slug"), F.to_json(F.struct("conversations", "messages", "memories")).alias("row_counts"), redacted_brief(F.lit(reason), 10_000).alias("reason"))


def purge(slug: str, threads: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = threads.where(F.col("project_slug") == slug).select("conv_id")
    return threads.join(gone, "conv_id", "left_anti"), messages.join(gone, "conv_id", "left_anti")


def share(threads: DataFrame, conv_ids: DataFrame, visibility: str, team: str | None, teams: tuple[str, ...], mine: Column) -> tuple[DataFrame, DataFrame]:
    """Threads after sharing, and an audit row for each that changed; only own threads change."""
    if visibility not in ("private", "team", "org") or (visibility == "team") != (team is not None) or team is not None and team not in teams:
        raise ValueError("visibility and team don't agree")
    named = threads.join(conv_ids.select("conv_id", F.lit(True).alias("named")).distinct(), "conv_id", "left")
    hit = F.coalesce(F.col("named") & mine, F.lit(False))
    after = named.withColumn("hit", hit).withColumn("before", F.col("visibility")).withColumn("visibility", F.when(F.col("hit"), visibility).otherwise(F.col("visibility"))).withColumn("team_id", F.when(F.col("hit"), F.lit(team)).otherwise(F.col("team_id")))
    audit = after.where(F.col("hit") & (F.col("before") != F.col("visibility"))).select("conv_id", F.col("before").alias("old_visibility"), F.col("visibility").alias("new_visibility"))
    return after.drop("before", "hit", "named"), audit


def classify_files(found: DataFrame, known: DataFrame, per_message: int = 50_000) -> DataFrame:
    """new, grown, truncated or legacy files; unchanged ones are left out."""
    f = found.join(known, "conv_id", "left")
    kind = (
        F.when(F.col("last_size").isNull(), "new")
        .when(F.col("last_size") == 0, "legacy")
        .when(F.col("last_size") / F.greatest(F.col("msg_count"), F.lit(1)) > per_message, "truncated")
        .when(F.col("size") > F.col("last_size"), "grown")
    )
    return f.withColumn("kind", kind).where("kind is not null")


def chunk_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """What each file's new chunks need: nothing, or a replacement that reuses vectors of equal content."""
    side = lambda df, name: df.select("path", "seq", F.col("content_sha").alias(name))
    both = side(new, "now").join(side(old, "was"), ["path", "seq"], "full").groupBy("path").agg(F.count("now").alias("n_now"), F.count("was").alias("n_was"), F.count_if(~F.col("now").eqNullSafe(F.col("was"))).alias("n_off"))
    known = old.select("content_sha").distinct().withColumn("reuse", F.lit(1))
    reuse = new.join(known, "content_sha", "left").groupBy("path").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.coalesce("reuse", F.lit(0))).alias("n_reused"))
    status = F.when(F.col("n_was") == 0, "new").when(F.col("n_off") == 0, "metadata-only").otherwise("replaced")
    return both.where("n_now > 0").select("path", status.alias("status")).join(reuse, "path")


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new chunks as the next state of an index, with their vectors and what became of their file.

    Both have path, seq, symbol, content_sha, start_line, end_line; old has dense too. A file whose symbols and hashes are the same in order keeps
    its vectors row by row (metadata-only); of other files (new, replaced) a chunk takes the vector of any old chunk of equal content, the first by path
    and seq, and null where there is none yet, to be embedded. Chunks of files that aren't in new are gone."""
    was = old.select("path", "seq", F.struct("symbol", "content_sha").alias("was"), F.col("dense").alias("own"))
    both = new.withColumn("now", F.struct("symbol", "content_sha")).select("path", "seq", "now").join(was.drop("own"), ["path", "seq"], "full")
    status = both.groupBy("path").agg(F.count("now").alias("n_now"), F.count("was").alias("n_was"), F.count_if(~F.col("now").eqNullSafe(F.col("was"))).alias("n_off")).where("n_now > 0")
    status = status.select("path", F.when(F.col("n_was") == 0, "new").when(F.col("n_off") == 0, "metadata-only").otherwise("replaced").alias("status"))
    known = old.where("dense is not null").groupBy("content_sha").agg(F.min_by("dense", F.struct("path", "seq")).alias("known"))
    rows = new.join(status, "path").join(was.drop("was"), ["path", "seq"], "left").join(known, "content_sha", "left")
    return rows.select("path", "seq", "symbol", "content_sha", "start_line", "end_line", F.when(F.col("status") == "metadata-only", F.col("own")).otherwise(F.col("known")).alias("dense"), "status")


def write_scores(threads: DataFrame, scores: DataFrame, as_of: Column) -> DataFrame:
    """Threads with the scores of (conv_id, scored, intensity, topic). One that had nothing to score (scored is false) is marked
    as done, once and without scores, so that it isn't tried again; the others keep what they have."""
    s = scores.select("conv_id", "scored", F.col("intensity").alias("new_intensity"), F.coalesce("topic", F.lit("")).alias("new_topic"))
    t = threads.join(s, "conv_id", "left")
    hit = F.coalesce("scored", F.lit(False))
    pick = lambda new, old: F.when(hit, F.col(new)).otherwise(F.col(old)).alias(old)
    done = F.when(hit | (F.col("scored").isNotNull() & F.col("scored_at").isNull()), as_of).otherwise(F.col("scored_at"))
    return t.select("conv_id", pick("new_intensity", "intensity"), pick("new_topic", "dominant_topic"), done.alias("scored_at"))


def provision(users: DataFrame, memberships: DataFrame, roster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users and memberships after a roster of (tenant_id, user_id, db_role, display_name, email, team_id), a row a team.

    A user's role is replaced, name and address only by values that are there; memberships are only added."""
    key = ["tenant_id", "user_id"]
    new = roster.groupBy(*key).agg(*[F.max(c).alias(f"new_{c}") for c in ("db_role", "display_name", "email")])
    both = users.join(new, key, "full")
    after = both.select(*key, *[F.coalesce(f"new_{c}", c).alias(c) for c in ("db_role", "display_name", "email")], "disabled_at")
    teams = roster.where("team_id is not null").select("tenant_id", "team_id", "user_id")
    return after, insert_ignore(memberships, teams, ["tenant_id", "team_id", "user_id"])


def disable(users: DataFrame, who: DataFrame, as_of: Column) -> DataFrame:
    """Users with those of (tenant_id, user_id) disabled; one that is disabled already keeps its time."""
    named = who.select("tenant_id", "user_id", F.lit(True).alias("named")).distinct()
    return users.join(named, ["tenant_id", "user_id"], "left").withColumn("disabled_at", F.when(F.col("named"), F.coalesce("disabled_at", as_of)).otherwise(F.col("disabled_at"))).drop("named")


def backfill(rows: DataFrame, transform, key: str, out: str, buckets: int, stop_after: int | None = None) -> tuple[DataFrame, list[dict]]:
    """Rows after a backfill in hash buckets of the key, each a job that writes its own folder and then its checkpoint.

    The rows are read once, dealt by bucket to a staged copy that lasts until all buckets are done. A rerun leaves the copy and finished
    buckets alone, so it goes on where a lost run ended, with the rows as they were when it began. Returns what is there and one heartbeat for each
    bucket that this run did. stop_after ends the run early, as an interruption would."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    done = lambda at: fs.exists(path(f"{at}/_SUCCESS"))
    staged, beats = f"{out}/_staged", []
    left = [i for i in range(buckets) if not done(f"{out}/bucket={i}")]
    if left and not done(staged):
        dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        dealt.write.mode("overwrite").partitionBy("__bucket").parquet(staged)
    for i in left[:stop_after]:
        at = f"{staged}/__bucket={i}"
        part = spark.read.schema(rows.schema).parquet(at) if fs.exists(path(at)) else rows.limit(0)
        transform(part).write.mode("overwrite").parquet(f"{out}/bucket={i}")
        beats.append({"bucket": i, "status": "complete"})
        spark.createDataFrame([(i, "complete")], "bucket int, status string").coalesce(1).write.mode("append").json(f"{out}/_checkpoints")
    if len(beats) == len(left):
        fs.delete(path(staged), True)
    return spark.read.option("basePath", out).parquet(f"{out}/bucket=*").drop("bucket"), beats


def residual(rows: DataFrame, pending: Column) -> DataFrame:
    """(rows_total, residual): how many rows still need work; a finished backfill has none."""
    return rows.agg(F.count(F.lit(1)).alias("rows_total"), F.count_if(pending).alias("residual"))

"""Agent memories: ranking, link graph, expansion and curation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions import lexical, vectors
from talus.functions import text as tx
from talus.functions.times import decay

from .access import visible_memories
from .fusion import ranked
from .nearest import nearest_in_group

#: Weights of the importance score.
WEIGHTS = {"activation_count": 0.2, "incident_prevention": 0.5, "user_endorsement": 0.3, "user_correction": -0.4, "prediction_error_ewma": -0.2}


def enriched(memories: DataFrame, telemetry: DataFrame, allowlist: DataFrame, as_of: Column, project: str, restricted: bool, query: DataFrame | None = None) -> DataFrame:
    """Visible memories with base_score, recency_factor and semantic_sim (0 without a query vector `qv`)."""
    t = telemetry.withColumnRenamed("memory_pk", "id")
    m = visible_memories(memories, allowlist, project, restricted).join(t, "id", "left")
    base = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        base = base + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * weight
    base = base + F.when(F.col("scope").isin("shared", "shared-restricted"), 0.1).otherwise(0.0)
    m = m.withColumn("base_score", base).withColumn("recency_factor", decay(as_of, F.coalesce("last_activated_at", "first_dubbed_at")))
    if query is None:
        return m.withColumn("semantic_sim", F.lit(0.0))
    return m.crossJoin(F.broadcast(query)).withColumn("semantic_sim", vectors.similarity("dense", "qv"))


def rank_linear(rows: DataFrame, n: int, text: str | None = None) -> DataFrame:
    """base x recency + half the similarity; text is a filter."""
    if text:
        rows = rows.where(lexical.websearch("body", text))
    rows = rows.withColumn("rank_score", F.col("base_score") * F.col("recency_factor") + F.col("semantic_sim") * 0.5)
    return rows.orderBy(F.desc("rank_score"), F.desc("last_dubbed_at"), "id").limit(max(1, min(n, 50)))


def rank_rrf(rows: DataFrame, n: int, text: str | None = None, has_vector: bool = False) -> DataFrame:
    """Fused vector and text ranks, importance breaking ties; without a query, importance alone."""
    rows = rows.withColumn("importance", F.col("base_score") * F.col("recency_factor"))
    if not has_vector and not text:
        return rows.withColumn("rank_score", F.col("importance")).orderBy(F.desc("rank_score"), F.desc("last_dubbed_at"), "id").limit(max(1, min(n, 50)))
    legs = []
    if has_vector:
        d = rows.where("dense is not null").withColumn("d", vectors.cosine_distance("dense", "qv"))
        legs.append(ranked(d.select("id", "d"), [F.col("d").asc_nulls_last(), F.col("id")], 100, "rank").select("id", "rank"))
    if text:
        t = rows.where(lexical.websearch("body", text)).withColumn("r", lexical.rank_text("body", text))
        legs.append(ranked(t.select("id", "r"), [F.desc("r"), F.col("id")], 100, "rank").select("id", "rank"))
    scores = legs[0].withColumn("s", vectors.rrf(F.col("rank"))).select("id", "s")
    for leg in legs[1:]:
        scores = scores.unionByName(leg.withColumn("s", vectors.rrf(F.col("rank"))).select("id", "s"))
    scores = scores.groupBy("id").agg(F.sum("s").alias("rank_score"))
    return rows.join(F.broadcast(scores), "id").orderBy(F.desc("rank_score"), F.desc("importance"), F.desc("last_dubbed_at"), "id").limit(max(1, min(n, 50)))  # at most 200 ids


def extract_edges(memories: DataFrame) -> DataFrame:
    """(source id, target slug, link text) of every link in live bodies."""
    live = memories.where("deleted_at is null").withColumn("link", F.explode(tx.wikilinks(F.col("body"), F.col("source_stem"))))
    return live.select(F.col("id").alias("source_memory_pk"), "chassis_id", "source_project", F.col("link.target").alias("target_slug"), F.col("link.alias").alias("link_text"))


def resolve_edges(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """Targets by stem whatever its case, within chassis and project; null where there is none."""
    key = memories.where("deleted_at is null").groupBy("chassis_id", "source_project", F.lower("source_stem").alias("k")).agg(F.min("id").alias("target_memory_pk"))
    return edges.withColumn("k", F.lower("target_slug")).join(key, ["chassis_id", "source_project", "k"], "left").drop("k")


def expand(edges: DataFrame, memories: DataFrame, allowlist: DataFrame, sources: list[int], project: str, restricted: bool, most: int = 5) -> DataFrame:
    """Visible neighbours of ranked memories, each by its best source."""
    ids = F.array(*[F.lit(i).cast("long") for i in sources])
    e = edges.where(F.col("source_memory_pk").isin(*sources) & F.col("target_memory_pk").isNotNull() & ~F.col("target_memory_pk").isin(*sources))
    alive = memories.where("deleted_at is null").select(F.col("id").alias("source_memory_pk"))
    e = e.join(alive, "source_memory_pk", "left_semi").withColumn("src_rank", F.array_position(ids, F.col("source_memory_pk")))
    best = e.groupBy(F.col("target_memory_pk").alias("id")).agg(F.min("src_rank").alias("src_rank"), F.min_by("source_memory_pk", "src_rank").alias("via_source_pk"))
    return visible_memories(memories, allowlist, project, restricted).join(best, "id").orderBy("src_rank", "id").limit(max(0, min(most, 10)))


def suggested_links(memories: DataFrame, edges: DataFrame, threshold: float, limit: int, nearest: int = 3) -> DataFrame:
    """Unlinked pairs of a chassis and project, each memory with its nearest; symmetric pairs once."""
    m = memories.where("deleted_at is null and dense is not null").select("id", "chassis_id", "source_project", "dense")
    two = edges.where("target_memory_pk is not null").select(F.col("source_memory_pk").alias("id"), F.col("target_memory_pk").alias("other"))
    linked = two.union(two.select(F.col("other").alias("id"), F.col("id").alias("other"))).groupBy("id").agg(F.collect_set("other").alias("linked"))
    near = nearest_in_group(m.join(linked, "id", "left"), ["chassis_id", "source_project"], "id", "dense", nearest, "linked").where(F.col("sim") >= threshold)
    near = near.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "sim")
    return near.groupBy("lo", "hi").agg(F.max("sim").alias("sim")).orderBy(F.desc("sim"), "lo", "hi").limit(limit)


def dangling(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """Edges of existing sources without a target, or with a deleted one."""
    s = memories.select(F.col("id").alias("source_memory_pk"), F.col("source_stem").alias("src"), F.col("source_project").alias("proj"))
    t = memories.select(F.col("id").alias("target_memory_pk"), F.col("deleted_at").alias("target_deleted"))
    e = edges.drop("source_project").join(s, "source_memory_pk").join(t, "target_memory_pk", "left").where("target_memory_pk is null or target_deleted is not null")
    return e.select("proj", "src", "target_slug", F.when(F.col("target_memory_pk").isNull(), "unresolved").otherwise("deleted-target").alias("kind"))


def stale(memories: DataFrame, as_of: Column, days: int) -> DataFrame:
    return memories.where("deleted_at is null").where(F.col("last_dubbed_at") < as_of - F.make_dt_interval(F.lit(days)))


def digest(memories: DataFrame, edges: DataFrame) -> DataFrame:
    live = memories.where("deleted_at is null").agg(F.count(F.lit(1)).alias("memories"))
    every = edges.agg(F.count(F.lit(1)).alias("edges"))
    t = memories.select(F.col("id").alias("target_memory_pk"), F.col("deleted_at").alias("gone"))
    loose = edges.join(t, "target_memory_pk", "left").where("target_memory_pk is null or gone is not null").agg(F.count(F.lit(1)).alias("dangling"))
    return live.crossJoin(every).crossJoin(loose)  # one row each


def degrees(edges: DataFrame) -> DataFrame:
    """In and out degree of every node, dangling targets as stubs of their slug."""
    out = edges.select(F.col("source_memory_pk").cast("string").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = edges.select(F.coalesce(F.col("target_memory_pk").cast("string"), F.concat(F.lit("?"), F.lower("target_slug"))).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.unionByName(into).groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def promotable(memories: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Shared memories that no project was allowed yet."""
    return memories.where("deleted_at is null and scope = 'shared'").join(allowlist.select(F.col("memory_pk").alias("id")), "id", "left_anti")

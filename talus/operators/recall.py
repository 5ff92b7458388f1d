"""Hybrid searches over messages, facts, diary and library, and the recall of memories with all that follows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions import lexical

from . import access, memories as mem, state
from .fusion import clamp_k, full_outer_fuse, pool_of, ranked, rrf_fuse, topk_by_vector


def dense_leg(rows: DataFrame, id_col: str, pool: int, where: Column | None = None) -> DataFrame:
    """(id, rnk) of the rows nearest to their query vector qv; access is applied before the limit."""
    near = topk_by_vector(rows, "dense", F.col("qv"), id_col, pool, "s", where)
    return ranked(near.select(id_col, "s"), [F.desc("s"), F.col(id_col)], pool, "rnk").select(id_col, "rnk")


def similar_leg(rows: DataFrame, id_col: str, text_col: str, query: str, pool: int, where: Column | None = None) -> DataFrame:
    """(id, rnk) of rows that hold a word of the query, by word similarity."""
    hit = rows.where(lexical.matches_any_word(text_col, query))
    hit = (hit if where is None else hit.where(where)).select(id_col, lexical.word_similarity(text_col, query).alias("s"))
    return ranked(hit, [F.desc("s"), F.col(id_col)], pool, "rnk").select(id_col, "rnk")


def cover_leg(rows: DataFrame, id_col: str, text_col: str, query: str, pool: int, where: Column | None = None) -> DataFrame:
    """(id, rnk) of rows that hold all words of the query, by how close together they are."""
    hit = rows.where(lexical.matches_all(text_col, query))
    hit = (hit if where is None else hit.where(where)).select(id_col, lexical.rank_cover(text_col, query).alias("s"))
    return ranked(hit, [F.desc("s"), F.col(id_col)], pool, "rnk").select(id_col, "rnk")


def fused(near: DataFrame, lex: DataFrame, id_col: str, k: int) -> DataFrame:
    return rrf_fuse([(near, "rnk"), (lex, "rnk")], id_col, score="score").orderBy(F.desc("score"), id_col).limit(k)


def search_messages(messages: DataFrame, threads: DataFrame, clusters: DataFrame, query_vector: DataFrame, query: str, me: access.Principal, k: int = 10) -> DataFrame:
    """Messages by vector and by words, fused, with their thread's title, topic and cluster.

    The dense leg sees all threads that the principal can read, the lexical leg only own messages. A blank query has the
    dense leg alone, scored by inner product."""
    k, qv = clamp_k(k), F.broadcast(query_vector)  # one row
    owner = ["tenant_id", "owner_user_id"]
    shown = threads.select("conv_id", "title", "platform", "visibility", "team_id", *owner, F.nullif("dominant_topic", F.lit("")).alias("topic"), "topic_cluster_id")
    joined = messages.drop(*owner).join(shown, "conv_id").crossJoin(qv)
    if query.strip():
        near = dense_leg(joined, "id", pool_of(k), access.can_read(me))
        lex = similar_leg(messages, "id", "content", query.strip(), pool_of(k), access.owns(me))
        top = fused(near, lex, "id", k)
    else:
        top = topk_by_vector(joined, "dense", F.col("qv"), "id", k, "score", access.can_read(me)).select("id", "score")
    rows = messages.join(F.broadcast(top), "id").join(shown.drop(*owner), "conv_id")  # k rows
    rows = rows.join(clusters, F.col("topic_cluster_id") == F.col("cluster_id"), "left")
    return rows.select("id", "conv_id", "role", "platform", "title", "topic", "cluster_label", "score").orderBy(F.desc("score"), "id")


def search_facts(facts: DataFrame, threads: DataFrame, query_vector: DataFrame, query: str, me: access.Principal, k: int = 10) -> DataFrame:
    """Facts by vector and by the cover of all words, both within the threads that the principal can read."""
    k = clamp_k(k)
    rows = facts.join(threads.select("conv_id", "platform", "tenant_id", "owner_user_id", "visibility", "team_id"), "conv_id").where(access.can_read(me))
    top = fused(dense_leg(rows.crossJoin(F.broadcast(query_vector)), "id", pool_of(k)), cover_leg(rows, "id", "fact_text", query, pool_of(k)), "id", k)
    return rows.join(F.broadcast(top), "id").select("id", "conv_id", "fact_text", "platform", "score").orderBy(F.desc("score"), "id")


def search_diary(entries: DataFrame, query_vector: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Entries by vector and by words, with an excerpt of 500 characters."""
    k = clamp_k(k, 1, 30)
    pool = pool_of(k, 4, 100)
    top = fused(dense_leg(entries.crossJoin(F.broadcast(query_vector)), "entry_date", pool), similar_leg(entries, "entry_date", "body", query, pool), "entry_date", k)
    excerpt = F.when(F.length("body") > 500, F.concat(F.substring("body", 1, 500), F.lit("…"))).otherwise(F.coalesce("body", F.lit("")))
    return entries.join(F.broadcast(top), "entry_date").select("entry_date", excerpt.alias("excerpt"), "score").orderBy(F.desc("score"), "entry_date")


def search_library(books: DataFrame, media: DataFrame, query_vector: DataFrame, query: str, k: int = 8, depth: int = 100) -> DataFrame:
    """Books by inner product and media by fused ranks (an absent leg counts as rank 101), merged as they are: the two
    scales differ, and that is how the search is defined."""
    qv = F.broadcast(query_vector)
    shelf = topk_by_vector(books.crossJoin(qv), "dense", F.col("qv"), "doc_id", k, "score").select(F.lit("book").alias("kind"), F.col("doc_id").alias("id"), "score")
    near = dense_leg(media.crossJoin(qv), "doc_id", depth).withColumnRenamed("rnk", "ra")
    lex = cover_leg(media, "doc_id", "text", query, depth).withColumnRenamed("rnk", "rb")
    both = full_outer_fuse(near, lex, "doc_id", "ra", "rb").orderBy(F.desc("score"), "doc_id").limit(k)
    return shelf.unionByName(both.select(F.lit("media").alias("kind"), F.col("doc_id").alias("id"), "score")).orderBy(F.desc("score"), "kind", "id").limit(k)


def thread_of(threads: DataFrame, messages: DataFrame, bare_id: str, me: access.Principal) -> DataFrame:
    """The messages of the one thread that the id names, if the principal can read it: else no row, as for no thread.

    threads has conv_id as `platform:id` and key, the conv_id of messages."""
    from .threads import resolve_suffix

    found = resolve_suffix(threads, bare_id).where(access.can_read(me)).select(F.col("key").alias("conv_id"), "title", "platform")
    return messages.join(F.broadcast(found), "conv_id").select("title", "platform", "seq", "role", "content").orderBy("seq")  # one row


def recall(rows: DataFrame, memories: DataFrame, telemetry: DataFrame, allowlist: DataFrame, edges: DataFrame, as_of: Column, project: str, query: str, k: int, restricted: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Hits in rank order, the audit row of the read, telemetry after it, and the hits' visible neighbours.

    rows are the enriched memories. Hits are at most 50, so they are collected once and named in what follows."""
    spark = rows.sparkSession
    hits = mem.rank_rrf(rows, k, query or None, True)
    ids = [r.id for r in hits.select("id").collect()]
    hits = hits.join(F.broadcast(spark.createDataFrame([(i, n + 1) for n, i in enumerate(ids)], "id long, hit_rank int")), "id")
    audit = spark.createDataFrame([("search", project, query[:500], ids)], "query_kind string, current_project string, query_text string, returned_ids array<long>")
    visible = access.visible_memories(memories, allowlist, project, restricted)
    after = state.bump(telemetry, spark.createDataFrame([(ids,)], "ids array<long>"), visible, as_of)
    near = mem.expand(edges, memories, allowlist, ids, project, restricted, min(k, 5)) if ids else memories.limit(0)
    return hits, audit, after, near

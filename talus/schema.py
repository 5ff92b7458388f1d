"""Explicit schemas of the relations and the checks their constraints stand for.

Spark keeps no CHECK or UNIQUE constraints, so each relation has a function that returns its violating rows with the
name of the rule; writers assert that it is empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "smallint": T.ShortType(), "float": T.FloatType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def _type(kind: str) -> T.DataType:
    if kind.startswith("array<"):
        return T.ArrayType(_type(kind[6:-1]))
    if kind.startswith("struct<"):
        return T.StructType([T.StructField(name, _type(k)) for name, k in (x.split(":") for x in kind[7:-1].split(","))])
    return _TYPES[kind]


def _s(*fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, _type(kind)) for name, kind in (f.split(" ", 1) for f in fields)])


CONVERSATIONS = _s("conv_id string", "platform string", "title string", "started_at timestamp", "ended_at timestamp", "msg_count int", "model string", "dominant_topic string", "intensity smallint", "ai_engagement smallint", "topic_cluster_id int", "last_file_size bigint", "summary_text string", "conv_dense array<float>", "project_slug string", "source_host string", "tenant_id string", "owner_user_id string", "visibility string", "team_id string", "shared_at timestamp")
MESSAGES = _s("conv_id string", "msg_id string", "role string", "content string", "content_type string", "ts timestamp", "seq int", "dense array<float>", "tenant_id string", "owner_user_id string")
SEGMENTS = _s("conv_id string", "seg_idx int", "start_seq int", "end_seq int", "summary_text string", "seg_dense array<float>")
FACTS = _s("id bigint", "conv_id string", "fact_text string", "dense array<float>", "extracted_at timestamp")
DIARY = _s("entry_date date", "body string", "dense array<float>", "conv_count int", "model_used string", "source_conv_ids array<string>", "source_provenance array<struct<session_id:string,runtime:string,model:string,host:string>>")
MEMORIES = _s("id bigint", "chassis_id string", "source_project string", "memory_slug string", "memory_type string", "title string", "body string", "scope string", "embed_model string", "dense array<float>", "first_dubbed_at timestamp", "last_dubbed_at timestamp", "deleted_at timestamp", "source_file string", "source_stem string")
TELEMETRY = _s("memory_pk bigint", "activation_count int", "incident_prevention int", "user_endorsement int", "user_correction int", "prediction_error_ewma float", "last_activated_at timestamp")
EDGES = _s("source_memory_pk bigint", "target_slug string", "target_memory_pk bigint", "link_text string")
CHUNKS = _s("repo_id string", "path string", "symbol string", "kind string", "start_line int", "end_line int", "content string", "content_sha string", "dense array<float>")
COMPLETIONS = _s("source string", "tool_name string", "outcome_reason string", "timed_out boolean", "elapsed_ms int", "eligible_chunks int", "fired_count int")

SENTINELS = ("__no_project__", "__unresolved__", "__excluded__")
ROLES = ("user", "assistant", "system", "tool")
VISIBILITIES = ("private", "team", "org")
SCOPES = ("local", "shared", "shared-restricted")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, once for each, with the rule's name; a rule that is null holds."""
    named = [F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("violation", F.explode(F.array_compact(F.array(*named)))).select("violation", *df.columns)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def conversation_rules() -> dict[str, Column]:
    slug = F.col("project_slug")
    return {
        "slug": slug.isNull() | slug.isin(*SENTINELS) | slug.rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]{0,62}$"),
        "visibility": F.col("visibility").isin(*VISIBILITIES),
        "team": (F.col("visibility") == "team") == F.col("team_id").isNotNull(),
    }


def message_rules() -> dict[str, Column]:
    return {"role": F.col("role").isin(*ROLES), "seq": F.col("seq") >= 0, "conv_id": F.col("conv_id").isNotNull()}


def memory_rules() -> dict[str, Column]:
    return {"scope": F.col("scope").isin(*SCOPES), "slug": F.col("memory_slug").isNotNull()}


def assert_empty(df: DataFrame, what: str) -> None:
    bad = df.limit(5).collect()
    if bad:
        raise ValueError(f"{what}: {bad}")


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))

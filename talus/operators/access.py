"""Row-level access as predicates that candidate legs apply before their limit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Principal:
    tenant_id: str = ""
    user_id: str = ""
    team_ids: tuple[str, ...] = ()
    multiuser: bool = True


def can_read(p: Principal) -> Column:
    """Own rows; rows of the tenant that are open to it, or to a team of the principal."""
    if not p.multiuser:
        return F.lit(True)
    team = (F.col("visibility") == "team") & F.col("team_id").isin(*p.team_ids) if p.team_ids else F.lit(False)
    return (F.col("tenant_id") == p.tenant_id) & ((F.col("owner_user_id") == p.user_id) | (F.col("visibility") == "org") | team)


def owns(p: Principal) -> Column:
    if not p.multiuser:
        return F.lit(True)
    return (F.col("tenant_id") == p.tenant_id) & (F.col("owner_user_id") == p.user_id)


def visible_memories(memories: DataFrame, allowlist: DataFrame, project: str, restricted: bool) -> DataFrame:
    """Live memories that are shared, or restricted and allowed to the project (a semi join)."""
    live = memories.where("deleted_at is null")
    shared = live.where("scope = 'shared'")
    if not restricted:
        return shared
    allowed = allowlist.where(F.col("allowed_project") == project).select(F.col("memory_pk").alias("id"))
    return shared.unionByName(live.where("scope = 'shared-restricted'").join(allowed, "id", "left_semi"))


def write_violations(rows: DataFrame, owned: DataFrame, p: Principal) -> DataFrame:
    """Rows that the principal may not write: foreign identity, or a conversation that isn't theirs."""
    foreign = rows.where(~F.coalesce(owns(p), F.lit(False))).withColumn("violation", F.lit("identity"))
    orphan = rows.where(owns(p)).join(owned.where(owns(p)).select("conv_id"), "conv_id", "left_anti").withColumn("violation", F.lit("parent"))
    return foreign.unionByName(orphan)

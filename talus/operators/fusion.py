"""Ranked candidate legs and their fusion.

A leg is an ordered limit first (TakeOrderedAndProject: each task keeps k rows) and ranked afterwards, so the ranking
window only ever sees k rows. Access predicates go into the leg before the limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.vectors import dot, rrf, rrf_with_default


def clamp_k(k: int, low: int = 1, high: int = 50) -> int:
    return max(low, min(int(k), high))


def pool_of(k: int, factor: int = 4, most: int = 200) -> int:
    return min(k * factor, most)


def ranked(df: DataFrame, order: list[Column], k: int, rank: str) -> DataFrame:
    """The first k rows with their rank."""
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def topk_by_vector(df: DataFrame, vector: str, query: Column, id_col: str, k: int, score: str = "score", where: Column | None = None) -> DataFrame:
    """The k rows of greatest inner product; rows without a vector are no candidates."""
    df = df.where(F.col(vector).isNotNull())
    if where is not None:
        df = df.where(where)
    return df.withColumn(score, dot(F.col(vector), query)).orderBy(F.desc(score), id_col).limit(k)


def rrf_fuse(legs: list[tuple[DataFrame, str]], id_col: str, k: int = 60, score: str = "rrf_score") -> DataFrame:
    """Sum of 1 / (k + rank) over the legs of (id, rank): one union and one grouping."""
    parts = [leg.select(id_col, rrf(F.col(rank), k).alias("__part")) for leg, rank in legs]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(id_col).agg(F.sum("__part").alias(score))


def full_outer_fuse(a: DataFrame, b: DataFrame, id_col: str, rank_a: str, rank_b: str, k: int = 20, absent: int = 101, score: str = "score") -> DataFrame:
    """An absent leg counts as a fixed rank."""
    return a.join(b, id_col, "full").withColumn(score, rrf_with_default(F.col(rank_a), k, absent) + rrf_with_default(F.col(rank_b), k, absent))


def best_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in the order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")


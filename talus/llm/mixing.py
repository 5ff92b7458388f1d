"""Mixing sources to target weights by weighted fair queueing.

Every shuffled document gets a virtual finish time, the tokens its source has sent up to its end divided by the
source's target; copies of later epochs follow the whole source. All copies are range-sorted by that time and cut
where their sizes reach the total budget."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, retire, spread

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Rows that a slice of a source should have at most, but for whole repeats of one row; slices are named by leading hex digits of
#: the shuffling hash, three at least, and sizes are summed by slice first.
SLICE_ROWS = 50_000


def row_hash(doc_id: Column, text: Column) -> Column:
    """What shuffles the documents of a source: MD5 of id and text."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))).cast("binary"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = 3) -> DataFrame:
    """Per source (one row each, by code point, null last): size, weight and target.

    Targets share the total by weight; none is above epochs times its source's size, and what it would have above
    goes to the others by weight. In the order of size over weight, a source is at its limit if the share that is
    left at its turn is above it. Sources are a short table, so one ordered window holds them."""
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.lit(epochs) * F.col("source_size"))
    turn = Window.orderBy((F.col("most") / F.col("weight")).asc(), "place")
    every = Window.partitionBy()
    ranked = ranked.withColumn("before", F.coalesce(F.sum("most").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.withColumn("weights_left", F.sum("weight").over(turn.rowsBetween(0, Window.unboundedFollowing))).withColumn("total", F.sum("source_size").over(every))
    ranked = ranked.withColumn("level", (F.col("total") - F.col("before")).cast("double") / F.col("weights_left"))
    ranked = ranked.withColumn("limited", F.col("most").cast("double") / F.col("weight") <= F.col("level"))
    ranked = ranked.withColumn("share", F.max(F.when(~F.col("limited"), F.col("level"))).over(every))
    target = F.when(F.col("limited"), F.col("most").cast("double")).otherwise(F.col("share") * F.col("weight"))
    return ranked.select("source", "place", "source_size", target.alias("target"), "total")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = 3) -> DataFrame:
    """How many words of every document the mix takes: doc_id, source, size, source_size, target, copies, taken.

    The order within a source is that of md5(id and text), then id and size, so reruns agree. A null or empty text
    has size 0 and is never taken; a null source is a source; a null id is ordered as ''. Repeated rows each have
    their own place. Other columns are ignored. Sources of size 0 have target 0. An empty table gives an empty result."""
    spark = docs.sparkSession
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    sized = spread(held).select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("hash"))
    sized, sized_path = materialize(sized, "mix-sized")
    targets, target_path = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs), "mix-targets")
    named = sized.join(targets.withColumnRenamed("source", "its_source"), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source", "total")
    digits = max(3, math.ceil(math.log(max(sized.count(), 1) / SLICE_ROWS, 16)))
    named, named_path = materialize(named.withColumn("slice", F.substring("hash", 1, digits)), "mix-named")
    slices = named.groupBy("place", "slice").agg(F.sum("size").alias("n"))
    sent = F.sum("n").over(Window.partitionBy("place").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.select("place", "slice", F.coalesce(sent, F.lit(0)).alias("sent"))
    within = F.sum("size").over(Window.partitionBy("place", "slice").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    queued = named.withColumn("within", within).join(slices, ["place", "slice"]).withColumn("cum", F.col("sent") + F.col("within"))
    queued, queued_path = materialize(queued.select("doc_id", "source", "place", "size", "source_size", "target", "hash", "cum"), "mix-queued")

    def finish(epoch: Column) -> Column:
        time = (F.col("cum") + epoch * F.col("source_size")).cast("double") / F.col("target")
        return F.struct(time.alias("time"), F.col("hash"), F.col("place"), epoch.alias("epoch"), F.col("doc_id"), F.col("size"))

    copies = queued.where("size > 0 and target > 0").select("size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))).alias("e"), "cum", "source_size", "target", "hash", "place", "doc_id")
    copies = copies.select("size", finish(F.col("e")).alias("at"))
    ordered, ordered_path = materialize(copies.repartitionByRange("at").withColumn("part", F.spark_partition_id()), "mix-ordered")
    parts = ordered.groupBy("part").agg(F.sum("size").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), "n")
    budget = targets.agg(F.max("total").alias("budget"))
    # Only the part in which the budget ends needs its own running total; those before it are taken whole.
    parts = parts.crossJoin(budget).where("before < budget")  # one row each on the right
    running = F.sum("size").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    edge = ordered.join(parts.where("before + n > budget"), "part").withColumn("upto", running + F.col("before")).where("upto <= budget")
    whole = ordered.join(parts.where("before + n <= budget"), "part")
    last = whole.agg(F.max("at").alias("last")).union(edge.agg(F.max("at").alias("last"))).agg(F.max("last").alias("last"))
    last, last_path = materialize(last, "mix-last")
    got = sum((F.when(finish(F.lit(e).cast("long")) <= F.col("last"), 1).otherwise(0) for e in range(epochs)), F.lit(0))
    out = queued.crossJoin(F.broadcast(last)).withColumn("copies", F.when((F.col("size") > 0) & (F.col("target") > 0), F.coalesce(got, F.lit(0))).otherwise(0))
    out, at = materialize(out.select("doc_id", "source", "hash", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken")), "mix-out")
    retire(spark, at)
    discard(spark, sized_path, target_path, named_path, queued_path, ordered_path, last_path)
    return out


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS hash FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sources),
weighed AS (SELECT *, CAST(CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight, 3 * source_size AS most FROM placed),
turned AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY CAST(most AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_,
         sum(weight) OVER (ORDER BY CAST(most AS DOUBLE) / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left,
         sum(source_size) OVER () AS total FROM weighed),
levelled AS (SELECT *, CAST(total - before_ AS DOUBLE) / CAST(weights_left AS DOUBLE) AS level_ FROM turned),
shared AS (SELECT *, max(CASE WHEN CAST(most AS DOUBLE) / weight > level_ THEN level_ END) OVER () AS share FROM levelled),
targets AS (SELECT source, place, source_size, total, CASE WHEN CAST(most AS DOUBLE) / weight <= level_ THEN CAST(most AS DOUBLE) ELSE share * weight END AS target FROM shared),
queued AS (
  SELECT s.*, t.place, t.source_size, t.target, t.total, sum(s.size) OVER (PARTITION BY t.place ORDER BY s.hash, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS cum
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT q.*, e.epoch, CAST(q.cum + e.epoch * q.source_size AS DOUBLE) / q.target AS finish FROM queued q, (VALUES (0), (1), (2)) e(epoch) WHERE q.size > 0 AND q.target > 0),
sent AS (SELECT *, sum(size) OVER (ORDER BY finish, hash, place, epoch, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM copies),
took AS (SELECT doc_id, source, hash, cum, CAST(sum(size) AS BIGINT) AS taken FROM sent WHERE upto <= total GROUP BY ALL)
SELECT q.doc_id, q.size, CAST(q.source_size AS BIGINT) AS source_size, q.target, coalesce(t.taken, 0) AS taken
FROM queued q LEFT JOIN took t ON q.doc_id IS NOT DISTINCT FROM t.doc_id AND q.source IS NOT DISTINCT FROM t.source AND q.hash = t.hash AND q.cum = t.cum
"""

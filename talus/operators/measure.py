"""Measurement over append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.scratch import fresh, retire

from talus.functions.stats import wilson, worst

#: Canary thresholds, and outcomes that mean the search could not run.
MIN_WINDOW, ZERO_ELIGIBLE, TIMEOUT, LATENCY_MS, UNPARSEABLE = 20, 0.95, 0.02, 8000, 0.50
UNAVAILABLE = ("embed_error", "hnsw_unhealthy", "pg_error", "search_unavailable")


def rollup(log: DataFrame) -> DataFrame:
    """Per source: invocations, fired, without eligible chunk, timed out, unparseable, search unavailable."""
    return log.groupBy("source").agg(
        F.count(F.lit(1)).alias("invocations"),
        F.count_if(F.coalesce("fired_count", F.lit(0)) > 0).alias("fired_invocations"),
        F.count_if(F.coalesce(F.col("eligible_chunks") == 0, F.lit(False))).alias("zero_eligible"),
        F.count_if(F.coalesce("timed_out", F.lit(False))).alias("timed_out"),
        F.count_if(F.coalesce(F.col("outcome_reason") == "unparseable", F.lit(False))).alias("unparseable"),
        F.count_if(F.coalesce(F.col("outcome_reason").isin(*UNAVAILABLE), F.lit(False))).alias("search_unavailable"),
    )


def crosstab(log: DataFrame) -> DataFrame:
    """Outcome by whether the invocation fired."""
    fired = F.coalesce("fired_count", F.lit(0)) > 0
    return log.groupBy("source", F.coalesce("outcome_reason", F.lit("unknown")).alias("outcome")).agg(F.count_if(fired).alias("fired"), F.count_if(~fired).alias("not_fired"))


def latency(log: DataFrame, fractions: dict[str, float] | None = None) -> DataFrame:
    """Nearest-rank percentiles per source by ordered ranks, without gathering a source's values in one list.

    Values are counted first: the ranks of equal values are known from running counts of distinct ones."""
    fractions = fractions or {"p50_ms": 0.5, "p95_ms": 0.95}
    counts = log.where("elapsed_ms is not null").groupBy("source", F.col("elapsed_ms").cast("int").alias("ms")).agg(F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy("source")
    counts = counts.withColumn("upto", F.sum("c").over(by.orderBy("ms").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(by))
    picks = [F.min(F.when(F.col("upto") >= F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(f))) + 1, F.col("ms"))).alias(name) for name, f in fractions.items()]
    return counts.groupBy("source").agg(F.sum("c").alias("n"), F.min("ms").alias("min_ms"), *picks, F.max("ms").alias("max_ms"))


def advisories(log: DataFrame, probe_mark: str = "live_probe.js") -> DataFrame:
    """Per source: fired and near hits, probes apart, distinct organic fires."""
    probe = F.coalesce(F.col("new_path").contains(probe_mark), F.lit(False)) | F.coalesce(F.col("hit_path").contains(probe_mark), F.lit(False))
    fired = F.coalesce("fired", F.lit(False))
    organic = F.when(fired & ~probe, F.struct("cwd_repo", "new_symbol", "hit_chunk_id"))
    return log.groupBy("source").agg(F.count_if(fired).alias("fired"), F.count_if(~fired).alias("near"), F.count_if(fired & probe).alias("probe_fired"), F.count_if(fired & ~probe).alias("organic_fired"), F.count_distinct(organic).alias("organic_distinct"))


def similarity_summary(log: DataFrame) -> DataFrame:
    """n, min, median (element n // 2) and max of sim, rounded to 4 places.

    Distinct values are dealt by range and written; only the range in which the median lies is looked into, by running counts."""
    spark = log.sparkSession
    at = fresh(spark, "similarity")
    retire(spark, at)
    log.where("sim is not null").groupBy("sim").agg(F.count(F.lit(1)).alias("c")).repartitionByRange("sim").withColumn("part", F.spark_partition_id()).write.parquet(at)
    parts = spark.read.schema("sim double, c long, part int").parquet(at)
    by_part = Window.orderBy("part")  # a row a part
    totals = parts.groupBy("part").agg(F.sum("c").alias("c"), F.min("sim").alias("low"), F.max("sim").alias("high"))
    totals = totals.withColumn("before", F.sum("c").over(by_part.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).withColumn("n", F.sum("c").over(Window.partitionBy()))
    rank = F.floor(F.col("n") / 2)
    middle = totals.where((F.col("before") <= rank) & (rank < F.col("before") + F.col("c"))).select("part", "before", "n")
    inside = parts.join(F.broadcast(middle), "part").withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy("sim").rowsBetween(Window.unboundedPreceding, 0)))
    half = inside.where(F.col("upto") > rank).agg(F.round(F.min("sim"), 4).alias("p50"))
    return totals.agg(F.sum("c").alias("n"), F.round(F.min("low"), 4).alias("min"), F.round(F.max("high"), 4).alias("max")).crossJoin(half).select("n", "min", "p50", "max")  # one row each


def rates(rows: DataFrame, *by: str) -> DataFrame:
    """Adopted of decided with its interval, and decided of all."""
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("label") == "adopted").alias("n_adopted"), F.count_if(F.col("label") == "not_adopted").alias("n_not_adopted"), F.count_if(F.col("label") == "cant_tell").alias("n_cant_tell"))
    g = g.withColumn("n_decided", F.col("n_adopted") + F.col("n_not_adopted"))
    point, low, high = wilson(F.col("n_adopted"), F.col("n_decided"))
    some = F.col("n_decided") > 0
    return g.withColumn("rate", F.when(some, F.round(point, 4))).withColumn("low", F.when(some, F.round(low, 4))).withColumn("high", F.when(some, F.round(high, 4))).withColumn("coverage", F.round(F.col("n_decided") / F.col("n_total"), 4))


def canaries(stats: DataFrame) -> DataFrame:
    """Status of each check per source, and the worst of them; few invocations give no verdict."""
    n = F.col("invocations")
    few = n < MIN_WINDOW

    def check(value, threshold):
        return F.when(few, "insufficient_data").when(value / n > threshold, "warn").otherwise("ok")

    zero, unparsed, search = check(F.col("zero_eligible"), ZERO_ELIGIBLE), check(F.col("unparseable"), UNPARSEABLE), check(F.col("search_unavailable"), 0.0)
    timeout = F.when(few, "insufficient_data").when(F.col("timed_out") / n > TIMEOUT, "crit").when(F.col("p95_ms") > LATENCY_MS, "warn").otherwise("ok")
    out = stats.select("source", "invocations", zero.alias("zero_eligible_status"), timeout.alias("timeout_status"), unparsed.alias("unparseable_status"), search.alias("search_status"))
    return out.withColumn("overall", worst("zero_eligible_status", "timeout_status", "unparseable_status", "search_status"))


def adoption_class(rows: DataFrame) -> DataFrame:
    """First matching class of a fired advisory, from what is known of it: label and evidence."""
    cases = [
        (F.col("is_probe"), "excluded", "E0"),
        (F.coalesce("cwd_repo", F.lit("")) == "", "cant_tell", "E5"),
        (F.coalesce("new_path", F.lit("")) == "", "cant_tell", "E5"),
        (~F.col("files_found"), "cant_tell", "E5"),
        (F.col("reference_now") & F.col("snapshot_known") & ~F.col("reference_before"), "adopted", "E1"),
        (F.col("reference_now"), "cant_tell", "E4"),
        (~F.col("symbol_found"), "cant_tell", "E3"),
        (F.col("sha_unchanged"), "not_adopted", "E2"),
    ]
    label, code = F.lit("cant_tell"), F.lit("E4")
    for when, a, b in reversed(cases):
        hit = F.coalesce(when, F.lit(False))
        label, code = F.when(hit, a).otherwise(label), F.when(hit, b).otherwise(code)
    return rows.withColumn("label", label).withColumn("evidence_code", code)


def latest_marks(tally: DataFrame) -> DataFrame:
    """Last mark of each record."""
    return tally.groupBy("record_id").agg(F.max_by("mark", F.struct("ts", "seq")).alias("mark"))


def agreement(labels: DataFrame, marks: DataFrame) -> DataFrame:
    both = labels.where(F.col("label").isin("adopted", "not_adopted")).join(marks.where(F.col("mark").isin("accepted", "ignored")), "record_id")
    same = (F.col("label") == "adopted") == (F.col("mark") == "accepted")
    return both.agg(F.count(F.lit(1)).alias("agreement_n"), F.round(F.avg(F.when(same, 1.0).otherwise(0.0)), 4).alias("agreement"))


def drift(entries: DataFrame, day: str, vector: str, sigma: float = 2.0) -> DataFrame:
    """Cosine distance of each entry to the one before, flagged above mean + sigma deviations."""
    from talus.functions.vectors import cosine_distance

    e = entries.where(F.col(vector).isNotNull()).withColumn("prev", F.lag(vector).over(Window.orderBy(day))).where("prev is not null")
    e = e.withColumn("distance", cosine_distance(vector, "prev")).drop("prev")
    every = Window.partitionBy()
    return e.withColumn("mean", F.avg("distance").over(every)).withColumn("sd", F.stddev_pop("distance").over(every)).withColumn("flagged", F.col("distance") > F.col("mean") + sigma * F.col("sd"))


def heartbeat(runs: DataFrame, as_of, ok: tuple[str, ...] = ("ok", "partial")) -> DataFrame:
    """Last good run per group and its age in seconds."""
    last = F.max(F.when(F.col("status").isin(*ok), F.col("ts")))
    return runs.groupBy("source").agg(last.alias("last_ok")).withColumn("age_s", (F.unix_micros(as_of) - F.unix_micros(F.col("last_ok").cast("timestamp"))) / 1e6)




def record_key(session_id, chunk_id, n: int = 8):
    """The key of a log record in a worksheet: the head of its session and its chunk."""
    return F.concat(F.substring(F.coalesce(session_id, F.lit("")), 1, n), F.lit("-"), chunk_id.cast("string"))


def worksheet_key(item_id):
    """A worksheet's item without its running number."""
    return F.regexp_replace(F.coalesce(item_id, F.lit("")), r"^\d{2}-", "")

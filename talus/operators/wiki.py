"""Versioned pages and their claims; diary and fact rows; index upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions import text as tx


def evidence_index(messages: DataFrame, cap: int = 40, chars: int = 120) -> DataFrame:
    """The first `cap` distinct message ids of each thread with a snippet."""
    first = messages.where("msg_id is not null").groupBy("conv_id", "msg_id").agg(F.min("seq").alias("seq"), F.min_by("content", "seq").alias("content"))
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq", "msg_id"))
    snippet = F.substring(F.trim(F.regexp_replace(tx.strip(F.col("content")), r"\s+", " ")), 1, chars)
    return first.withColumn("rn", rn).where(F.col("rn") <= cap).select("conv_id", "msg_id", snippet.alias("snippet"))


def claim_rows(items: DataFrame, valid: DataFrame) -> DataFrame:
    """Clean claims of pages: page_slug, pos, section, claim_text, source_msg_id and conv_id in; one row a claim out.

    Blank claims and echoed turns go; of equal claims of a page the first stays; a source that isn't known takes the
    conversation with it."""
    c = items.withColumn("claim_text", tx.strip(F.col("claim_text"))).where((F.col("claim_text") != "") & ~tx.is_role_echo(F.col("claim_text")))
    c = c.withColumn("claim_hash", tx.claim_hash(F.col("claim_text")))
    section = F.nullif(tx.strip(F.col("section")), F.lit(""))
    c = c.withColumn("section", F.when(~F.lower(section).isin("null", "none"), section))
    c = c.withColumn("rn", F.row_number().over(Window.partitionBy("page_slug", "claim_hash").orderBy("pos"))).where("rn = 1")
    known = valid.select(F.col("msg_id").alias("source_msg_id"), F.lit(True).alias("known")).distinct()
    c = c.join(known, "source_msg_id", "left")
    return c.select("page_slug", "claim_hash", "claim_text", "section", F.when(F.col("known"), F.col("conv_id")).alias("source_conv_id"), F.when(F.col("known"), F.col("source_msg_id")).alias("source_msg_id"))


def claim_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per page: claims added, struck and held."""
    o = old.select("page_slug", "claim_hash").distinct().withColumn("o", F.lit(1))
    n = new.select("page_slug", "claim_hash").distinct().withColumn("n", F.lit(1))
    return o.join(n, ["page_slug", "claim_hash"], "full").groupBy("page_slug").agg(F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("struck"), F.count_if(F.col("n").isNotNull()).alias("n_claims"))


def apply_merges(pages: DataFrame, log: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages and log after the staged merges: once each, and only onto the revision they were made from."""
    fresh = staged.join(log.select("merge_id"), "merge_id", "left_anti")
    fresh = fresh.withColumn("rn", F.row_number().over(Window.partitionBy("slug").orderBy("merge_id"))).where("rn = 1")
    s = fresh.select("slug", "merge_id", "base_rev", F.col("body").alias("new_body"))
    both = pages.join(s, "slug", "full").withColumn("hit", F.coalesce(F.col("base_rev") == F.coalesce("rev", F.lit(0)), F.lit(False)))
    after = both.where(F.col("rev").isNotNull() | F.col("hit")).select("slug", F.when(F.col("hit"), F.coalesce("rev", F.lit(0)) + 1).otherwise(F.col("rev")).alias("rev"), F.when(F.col("hit"), F.col("new_body")).otherwise(F.col("body")).alias("body"))
    rows = both.where("hit").select("merge_id", "slug", (F.coalesce("rev", F.lit(0)) + 1).alias("rev"), F.col("body").alias("before"))
    return after, log.unionByName(rows)


def rollback(pages: DataFrame, log: DataFrame, merge_ids: DataFrame) -> DataFrame:
    """Pages with the named merges undone, as new revisions; only the latest merge of a page can be."""
    last = log.groupBy("slug").agg(F.max_by(F.struct("merge_id", "before"), "rev").alias("m"))
    undo = last.withColumn("merge_id", F.col("m.merge_id")).join(merge_ids.select("merge_id"), "merge_id", "left_semi").select("slug", F.col("m.before").alias("before"), F.lit(True).alias("undo"))
    p = pages.join(undo, "slug", "left")
    hit = F.coalesce("undo", F.lit(False))
    return p.select("slug", F.when(hit, F.col("rev") + 1).otherwise(F.col("rev")).alias("rev"), F.when(hit, F.coalesce("before", F.lit(""))).otherwise(F.col("body")).alias("body"))


def line_changes(rows: DataFrame, key: list[str], old: str, new: str) -> DataFrame:
    """(key, added, removed): the bags of lines of two texts against each other."""

    def lines(column: str, side: int) -> DataFrame:
        return rows.select(*key, F.explode(F.split(F.coalesce(F.col(column), F.lit("")), "\n")).alias("line"), F.lit(1 - side).alias("o"), F.lit(side).alias("n"))

    held = lines(old, 0).unionByName(lines(new, 1)).groupBy(*key, "line").agg((F.sum("n") - F.sum("o")).alias("more"))
    return held.groupBy(*key).agg(F.sum(F.greatest("more", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("more"), F.lit(0))).alias("removed"))


def review_flags(diff_lines: Column, n_claims: Column, n_sourced: Column, most: int = 400, least: float = 0.5) -> Column:
    """What a reviewer should look at: a long diff, or few claims with a source."""
    return F.array_compact(F.array(F.when(diff_lines > most, "long-diff"), F.when((n_claims > 0) & (n_sourced / n_claims < least), "thin-evidence")))


SUBTITLE = r"\s*[—–]\s*|\s+-\s+"


def split_subtitle(text: Column) -> tuple[Column, Column]:
    """Head and tail around the first dash between words; the tail is empty without one."""
    parts = F.split(F.coalesce(text, F.lit("")), SUBTITLE, 2)
    return tx.strip(F.get(parts, F.lit(0))), F.coalesce(tx.strip(F.get(parts, F.lit(1))), F.lit(""))


def clean_inline(text: Column) -> Column:
    text = F.regexp_replace(text, r"\[\[[^\]|]*\|([^\]]+)\]\]", "$1")
    text = F.regexp_replace(text, r"\[\[([^\]|#]+)(?:#[^\]|]+)?\]\]", "$1")
    text = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1")
    for mark in ("**", "__", "`"):
        text = F.replace(text, F.lit(mark), F.lit(""))
    return tx.strip(text)


def first_sentence(body: Column, cap: int = 46) -> Column:
    """Of the first line of prose, without markup, what comes before its first full stop within the cap, or else the cap's
    worth. Marks are looked for in the order of the list, not of the line."""
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: tx.strip(x))
    prose = F.filter(F.transform(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^[#><\-|!_`]")), clean_inline), lambda x: x != "")
    s = F.coalesce(F.get(prose, F.lit(0)), F.lit(""))
    cut = F.when(F.length(s) > cap, F.concat(F.substring(s, 1, cap), F.lit("…"))).otherwise(s)
    for mark in (". ", "!", "！", "。"):
        at = F.instr(s, mark)
        cut = F.when((at > 0) & (at <= cap + 1), F.substring(s, F.lit(1), at - 1)).otherwise(cut)
    return cut


def lede(title: Column, body: Column) -> tuple[Column, Column]:
    """Short title and description of a page: the title's subtitle, or that of the first heading, or the first sentence."""
    short, tail = split_subtitle(title)
    heads = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: tx.strip(x)), lambda x: x.startswith("# "))
    h1 = tx.strip(F.substring(F.coalesce(F.get(heads, F.lit(0)), F.lit("")), 3, 1 << 30))
    blank = lambda c: F.nullif(c, F.lit(""))
    description = F.coalesce(blank(tail), blank(split_subtitle(h1)[1]), first_sentence(body))
    return F.coalesce(blank(short), title, F.lit("")), description


def diary_status(days: DataFrame, entries: DataFrame, min_len: int = 40) -> DataFrame:
    """What becomes of each day: day, n_convs, transcript, body (the writer's) in."""
    e = entries.select("day", F.lit(True).alias("there"))
    d = days.join(e, "day", "left")
    status = (
        F.when(F.col("there"), "skip-exists")
        .when(F.coalesce("n_convs", F.lit(0)) == 0, "skip-empty")
        .when(F.coalesce(F.col("transcript"), F.lit("")) == "", "skip-empty")
        .when(tx.looks_degenerate(F.col("body"), min_len), "skip-degenerate")
        .otherwise("written")
    )
    return d.select("day", status.alias("status"))


def clean_facts(rows: DataFrame, most: int = 8) -> DataFrame:
    """Up to `most` facts a thread from (conv_id, facts array); a thread without one gets a sentinel row."""
    good = F.slice(F.filter(F.transform("facts", lambda x: tx.strip(x)), lambda x: x.isNotNull() & (x != "") & ~x.rlike(tx.ROLE_ECHO)), 1, most)
    return rows.select("conv_id", F.explode(F.when(F.size(good) > 0, good).otherwise(F.array(F.lit("")))).alias("fact_text"))


def index_plan(found: DataFrame, known: DataFrame, allowed: list[str]) -> DataFrame:
    """Per file of (repo, path, sha): new, changed, unchanged or vanished; files of repos no longer allowed are delisted.

    An empty list of allowed repos never removes anything."""
    f = found.select("repo", "path", F.col("sha").alias("now"))
    k = known.select("repo", "path", F.col("sha").alias("was"))
    j = f.join(k, ["repo", "path"], "full")
    kind = F.when(F.col("now").isNull(), "vanished").when(F.col("was").isNull(), "new").when(F.col("now") != F.col("was"), "changed").otherwise("unchanged")
    if allowed:
        kind = F.when(~F.col("repo").isin(allowed), "delisted").otherwise(kind)
    else:
        kind = F.when(F.col("now").isNull(), "unchanged").otherwise(kind)
    return j.select("repo", "path", kind.alias("kind"))


def batch_bounds(rows: DataFrame, key: str, size: int) -> DataFrame:
    """First and last key and size of the first `size` rows that still need work."""
    return rows.orderBy(key).limit(size).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("n"))


def register_sql_functions(spark) -> None:
    """The scalar functions as temporary SQL functions."""
    spark.sql(
        r"""CREATE OR REPLACE TEMPORARY FUNCTION canonical_project_slug(url STRING, cwd STRING) RETURNS STRING RETURN
        (SELECT CASE WHEN slug RLIKE '^[A-Za-z0-9][A-Za-z0-9_-]{0,62}$' THEN slug ELSE '__unresolved__' END FROM (SELECT regexp_replace(regexp_replace(regexp_replace(
        coalesce(nullif(regexp_replace(trim(CASE WHEN length(url) <= 4096 THEN url END), '/+$', ''), ''), nullif(regexp_replace(trim(CASE WHEN length(cwd) <= 4096 THEN cwd END), '/+$', ''), '')),
        '[.]git$', ''), '^(git@[^:]+:|https?://[^/]+/)', ''), '.*/', '') AS slug))"""
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION source_identity(tenant STRING, owner STRING, platform STRING, conv STRING) RETURNS STRING RETURN sha2(tenant || chr(0) || owner || chr(0) || platform || chr(0) || conv, 256)")


def page_status(pages: DataFrame, claims: DataFrame, staged: DataFrame, log: DataFrame) -> DataFrame:
    """Each page with its live claims, staged merges that aren't in the log yet, and merges."""
    live = claims.where("status = 'live'").groupBy("slug").agg(F.count(F.lit(1)).alias("live_claims"))
    pending = staged.join(log.select("merge_id"), "merge_id", "left_anti").groupBy("slug").agg(F.count(F.lit(1)).alias("pending"))
    merged = log.groupBy("slug").agg(F.count(F.lit(1)).alias("merges"))
    out = pages.join(live, "slug", "left").join(pending, "slug", "left").join(merged, "slug", "left")
    return out.fillna(0, ["live_claims", "pending", "merges"])


def page_index(pages: DataFrame) -> DataFrame:
    """Pages that have a body with their place in the index of their domain; pages without a domain come last."""
    w = Window.partitionBy("domain").orderBy("title", "slug")
    kept = pages.where("body is not null and trim(body) <> ''")
    return kept.select("domain", "slug", "title", F.row_number().over(w).alias("place"))

"""Line diffs: least edit scripts, and hunks with context.

The script is found within a task, text pair by text pair, over the hashes of lines; hunks, their headers and their text are expressions."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.session import ship

LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def lines_of(text: Column) -> Column:
    """Lines without their ends; a null or empty text has none, and an end at the end begins no line."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


#: Texts further apart are matched by chains of equal lines, which takes no memory for the edits.
MOST_EDITS = 1000


def longest_chain(a: list, b: list) -> list[tuple[int, int]]:
    """The longest chain of equal lines in order: each line of a goes, last place first, to where it ends the shortest b."""
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    last, chains = [], []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(last, j)
            chain = (i, j, chains[k - 1] if k else None)
            last[k : k + 1], chains[k : k + 1] = [j], [chain]
    out, chain = [], chains[-1] if chains else None
    while chain:
        out.append(chain[:2])
        chain = chain[2]
    return out[::-1]


def edit_script(a: list, b: list) -> list[tuple[int, int]]:
    """The matched places of a script of least length, by furthest-reaching paths: for each number of edits, the furthest place
    reached on each diagonal; the way back gives the matches. Common ends are set aside first."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    n, m = len(a) - head - tail, len(b) - head - tail
    ends = [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)]
    trail, reach = [], {1: 0}
    done = not n and not m
    while not done:
        if len(trail) == MOST_EDITS:
            return [(i, i) for i in range(head)] + [(head + x, head + y) for x, y in longest_chain(a[head : head + n], b[head : head + m])] + ends
        trail.append(dict(reach))
        edits = len(trail) - 1
        for k in range(-edits + 2 * max(0, edits - m), edits - 2 * max(0, edits - n) + 1, 2):
            down = k == -edits or k != edits and reach.get(k - 1, -1) < reach.get(k + 1, -1)
            x = reach[k + 1] if down else reach[k - 1] + 1
            while x < n and x - k < m and a[head + x] == b[head + x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                done = True
                break
    middle, x, y = [], n, m
    for edits in range(len(trail) - 1, -1, -1):
        before, k = trail[edits], x - y
        down = k == -edits or k != edits and before.get(k - 1, -1) < before.get(k + 1, -1)
        to_x = before[k + 1] if down else before[k - 1] + 1
        while x > to_x:
            x, y = x - 1, y - 1
            middle.append((head + x, head + y))
        if edits:
            x, y = (before[k + 1], before[k + 1] - k - 1) if down else (before[k - 1], before[k - 1] - k + 1)
    return [(i, i) for i in range(head)] + middle[::-1] + ends


def _scripts(batches):
    """(key, hashes of old lines, of new lines) to the steps of each script: old and new line from 1, null on the side that lacks it."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for batch in batches:
        out = []
        for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            steps, i, j = [], 0, 0
            for x, y in [*edit_script(a, b), (len(a), len(b))]:
                steps += [{"a": r + 1, "b": None} for r in range(i, x)] + [{"a": None, "b": r + 1} for r in range(j, y)]
                if x < len(a):
                    steps.append({"a": x + 1, "b": y + 1})
                i, j = x + 1, y + 1
            out.append(steps)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["__key", "steps"])


def scripts(rows: DataFrame, key: list[str], old: str, new: str) -> DataFrame:
    """(key, old_lines, new_lines, steps): steps array<struct<a, b>>, a line that stays having both numbers.

    The number of edits is the least there is. Lines are equal if their 64-bit hashes are. Rows of equal keys and texts are rows of their own;
    null texts have no lines."""
    ship(rows.sparkSession)
    lined = rows.select(F.struct(*key).alias("__k"), lines_of(F.col(old)).alias("old_lines"), lines_of(F.col(new)).alias("new_lines"))
    hashes = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    packed = lined.select(F.struct("__k", "old_lines", "new_lines").alias("__key"), hashes("old_lines").alias("x"), hashes("new_lines").alias("y"))
    schema = packed.select("__key", F.lit(None).cast("array<struct<a:int,b:int>>").alias("steps")).schema
    done = packed.mapInArrow(_scripts, schema)
    return done.select("__key.__k.*", "__key.old_lines", "__key.new_lines", "steps")


def unified(rows: DataFrame, key: list[str], old: str, new: str, name: Column, context: int = 3) -> DataFrame:
    """(key, added, removed, n_lines, diff): the diff with `context` lines around changes, n_lines of it; empty for equal texts."""
    s = scripts(rows, key, old, new).withColumn("__name", name)
    changed = lambda x: x["a"].isNull() | x["b"].isNull()
    step = F.transform("steps", lambda x, i: F.struct(i.alias("i"), x["a"].alias("a"), x["b"].alias("b")))
    # Changes less than 2 * context + 1 lines apart share a hunk: its first and last step.
    spots = F.transform(F.filter(step, changed), lambda x: x["i"])
    grown = F.aggregate(
        spots,
        F.array().cast("array<struct<lo:int,hi:int>>"),
        lambda acc, i: F.when((F.size(acc) > 0) & (i - F.element_at(acc, -1)["hi"] <= 2 * context + 1), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["lo"].alias("lo"), i.alias("hi"))))).otherwise(F.concat(acc, F.array(F.struct(i.alias("lo"), i.alias("hi"))))),
    )
    hunks = s.withColumn("__spans", grown).withColumn("__span", F.explode_outer("__spans")).withColumn("__lo", F.greatest(F.col("__span.lo") - context, F.lit(0))).withColumn("__hi", F.least(F.col("__span.hi") + context, F.size("steps") - 1))
    hunks = hunks.withColumn("__part", F.slice("steps", F.col("__lo") + 1, F.col("__hi") - F.col("__lo") + 1)).withColumn("__before", F.slice("steps", F.lit(1), F.col("__lo")))
    text = lambda x: F.when(x["b"].isNull(), F.concat(F.lit("-"), F.get("old_lines", x["a"] - 1))).when(x["a"].isNull(), F.concat(F.lit("+"), F.get("new_lines", x["b"] - 1))).otherwise(F.concat(F.lit(" "), F.get("old_lines", x["a"] - 1)))

    def range_of(side: str) -> Column:
        n = F.size(F.filter("__part", lambda x: x[side].isNotNull()))
        first = F.size(F.filter("__before", lambda x: x[side].isNotNull())) + F.when(n > 0, 1).otherwise(0)
        return F.when(n == 1, first.cast("string")).otherwise(F.concat_ws(",", first.cast("string"), n.cast("string")))

    head = F.concat(F.lit("@@ -"), range_of("a"), F.lit(" +"), range_of("b"), F.lit(" @@"))
    body = F.concat(F.array(head), F.transform("__part", text))
    count = lambda side: F.size(F.filter("steps", lambda x: x[side].isNull())).cast("long")
    hunks = hunks.select(*key, "__name", count("a").alias("added"), count("b").alias("removed"), F.when(F.col("__span").isNotNull(), F.struct(F.col("__lo").alias("lo"), body.alias("lines"))).alias("hunk"))
    whole = hunks.groupBy(*key, "__name", "added", "removed").agg(F.flatten(F.transform(F.array_sort(F.collect_list("hunk")), lambda h: h["lines"])).alias("lines"))
    names = F.array(F.concat(F.lit("--- a/"), F.col("__name")), F.concat(F.lit("+++ b/"), F.col("__name")))
    every = F.when(F.size("lines") > 0, F.concat(names, "lines")).otherwise(F.array().cast("array<string>"))
    return whole.withColumn("lines", every).select(*key, "added", "removed", F.size("lines").cast("long").alias("n_lines"), F.array_join("lines", "\n").alias("diff"))

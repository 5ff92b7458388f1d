"""Rotated logs, markdown vaults, tracked source files, rosters, and the sinks."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.functions import front
from talus.functions import text as tx
from talus.operators import chunks
from talus.session import ship

#: What an index of source files takes.
EXTENSIONS = ("py", "js", "mjs", "cjs", "ts", "sh", "bash", "html")
DENIED_DIRS = ("data", "dist", "build", "vendor", "node_modules")
DENIED_NAMES = r"^(.*\.min\.js|secrets.*|.*\.enc\..*|\.env.*|.*\.env|.*\.env\..*|credentials.*|.*\.pem|.*_key.*)$"
MAX_BYTES = 300 * 1024
MIN_LINES, MAX_CHARS = 4, 6000
SECRETS = [r"AKIA[0-9A-Z]{16}", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", r"ghp_[A-Za-z0-9]{36}", r"sk-ant-", r"AGE-SECRET-KEY-1[0-9A-Z]{50,}", r"(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^:@/\s]+:[^@/\s]+@", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.", r"xox[baprs]-[A-Za-z0-9-]{10,}"]


def rotated_log(spark: SparkSession, folder: str, base: str, schema: T.StructType, generations: int = 3) -> DataFrame:
    """The log and its rotated generations; malformed lines and lines that are no object are left out."""
    glob = f"{base}{{,{','.join(f'.{i}' for i in range(1, generations))}}}"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", glob).json(folder)


def whole_texts(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """(path, value) of the files under a folder, or a pattern of folders, whose names end so; hidden ones are left out.

    Tasks list the folders and read the files, many a task: no list of files is in the driver, and no file a split of its own."""
    ship(spark)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    roots = [re.sub(r"^(\w+):/(?!/)", r"\1:///", str(x.getPath().toString())) for x in found or () if not (set("*?[{") & set(path) and x.getPath().getName()[:1] in ("_", "."))]
    if not roots:
        raise FileNotFoundError(path)

    def listed(deep):
        def run(batches):
            import pyarrow as pa
            from pyarrow import fs

            for batch in batches:
                for root, at, folder in zip(*[batch.column(n).to_pylist() for n in range(3)], strict=True):
                    if not folder:
                        out = [(root, at, False)]
                    else:
                        store, top = fs.FileSystem.from_uri(quote(root, safe=":/@"))
                        here = top if at is None else at
                        info = store.get_file_info(here)
                        inside = store.get_file_info(fs.FileSelector(here, recursive=deep)) if info.type == fs.FileType.Directory else [info]
                        seen = lambda p, n=len(here): not any(x[:1] in ("_", ".") for x in p[n:].split("/"))
                        out = [(root, f.path, f.type == fs.FileType.Directory) for f in inside if seen(f.path) and (f.path.endswith(ending) or not deep and f.type == fs.FileType.Directory)]
                        out = [x for x in out if not (deep and x[2])]
                    for lo in range(0, len(out), 10_000):
                        part = out[lo : lo + 10_000]
                        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in part], t) for n, t in enumerate((pa.string(), pa.string(), pa.bool_()))], names=["root", "at", "folder"])

        return run

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        stores = {}
        for batch in batches:
            paths, values, held = [], [], 0
            for root, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if root not in stores:
                    stores[root] = fs.FileSystem.from_uri(quote(root, safe=":/@"))
                store, top = stores[root]
                with store.open_input_stream(at) as f:
                    value = f.read()
                paths.append((root[: -len(top)] if root.endswith(top) else "") + at)
                values.append(value)
                held += len(value)
                if held >= 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.binary())], names=["path", "value"])
                    paths, values, held = [], [], 0
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.binary())], names=["path", "value"])

    kinds = "root string, at string, folder boolean"
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    top = spark.createDataFrame([(r, None, True) for r in roots], kinds).mapInArrow(listed(False), kinds)
    every = top.repartition(tasks, "at").mapInArrow(listed(True), kinds)
    return every.repartition(tasks, "at").select("root", "at").mapInArrow(read, "path string, value binary").select("path", F.col("value").cast("string").alias("value"))


def vault(spark: SparkSession, path: str) -> DataFrame:
    """path, stem, front (map of the front matter's own keys to scalars, or to JSON of lists and maps), front_json, body of markdown files.

    Of repeated keys the first counts. Front matter that can't be read gives an empty map and no JSON."""
    raw = whole_texts(spark, path, ".md")
    read = front.with_json(raw.withColumn("__front", front.front_matter(F.col("value"))), "__front", "front_json")
    keys = F.coalesce(F.from_json("front_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    body = F.regexp_replace("value", r"(?s)\A---[ \t]*\r?\n(?:.*?\n)?---[ \t]*(?:\r?\n|\z)", "")
    return read.select("path", tx.file_stem(F.col("path")).alias("stem"), keys.alias("front"), "front_json", body.alias("body"))


def allowed_path(path: Column) -> Column:
    parts = F.split(path, r"[/\\]")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return ~F.exists(dirs, lambda x: x.isin(*DENIED_DIRS)) & ~F.exists(parts, lambda x: x.rlike(DENIED_NAMES)) & F.lower(F.regexp_extract(F.element_at(parts, -1), r"\.([^.]+)$", 1)).isin(*EXTENSIONS)


def is_secret(text: Column) -> Column:
    hit = F.lit(False)
    for p in SECRETS:
        hit = hit | text.rlike(p)
    return hit


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), content of source files within the policy; larger ones are refused before they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", r"^.*?\Q" + root.rstrip("/").replace("file://", "") + r"\E/", "")
    return files.where(F.col("length") <= MAX_BYTES).select(rel.alias("path"), F.col("content").cast("string").alias("content")).where(allowed_path(F.col("path")))


def _tracked(batches):
    """Index files to their entries: fixed fields of 62 bytes, longer ones where a flag says so, and paths, padded or (version 4) cut by
    what they share with the one before."""
    import struct

    import pyarrow as pa

    for batch in batches:
        out = []
        for root, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            magic, version, count = struct.unpack(">4sII", raw[:12]) if len(raw) >= 12 else (b"", 0, 0)
            at, name = 12, b""
            for _ in range(count if magic == b"DIRC" and version in (2, 3, 4) else 0):
                first, (mode, size, flags) = at, struct.unpack(">24xI8xI20xH", raw[at : at + 62])
                at += 64 if version > 2 and flags & 0x4000 else 62
                if version == 4:
                    cut, shift = 0, 0
                    while True:  # groups of seven bits, each but the last with a higher one to come
                        byte = raw[at]
                        cut, at = (cut + shift << 7) | byte & 127, at + 1
                        if byte < 128:
                            break
                        shift = 1
                    end = raw.index(b"\0", at)
                    name, at = name[: len(name) - cut] + raw[at:end], end + 1
                else:
                    end = raw.index(b"\0", at)
                    name, at = raw[at:end], first + (end - first + 8 & ~7)
                out.append((root, name.decode("utf-8", "replace"), mode, size, flags >> 12 & 3))
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["root", "path", "mode", "size", "stage"])


def tracked_files(spark: SparkSession, roots: str) -> DataFrame:
    """root, path, size of the regular files that the repositories matching `roots` (a folder, or a pattern of folders) track.

    Read from each repository's index; an index of another format gives no files. Symbolic links and submodules, entries of an open
    merge, absolute paths and those that leave the repository are refused."""
    ship(spark)
    raw = spark.read.format("binaryFile").load(f"{roots.rstrip('/')}/.git/index").select(F.regexp_replace("path", "/[.]git/index$", "").alias("root"), "content")
    rows = raw.mapInArrow(_tracked, "root string, path string, mode int, size long, stage int")
    kind = F.shiftright("mode", 12)  # 8: a regular file, 10: a link, 14: a submodule
    inside = ~F.exists(F.split("path", "/"), lambda x: x.isin("..", ".", "", ".git"))
    return rows.where((kind == 8) & (F.col("stage") == 0) & inside).select("root", "path", "size")


def code_chunks(files: DataFrame) -> DataFrame:
    """Functions and heads of classes, without chunks that hold secrets."""
    return chunks.chunks(files, MIN_LINES, MAX_CHARS).where(~is_secret(F.col("content")))


def roster(spark: SparkSession, path: str) -> DataFrame:
    """One row a user and team of rosters in JSON or YAML (which holds JSON); users without a team have one row."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.{json,yaml,yml}", recursiveFileLookup=True)
    r = front.with_json(raw, "value", "__json").select(F.from_json("__json", "tenant_id string, users array<struct<user_id:string,teams:array<string>>>").alias("r")).select("r.*")
    return r.select("tenant_id", F.explode("users").alias("u")).select("tenant_id", F.col("u.user_id").alias("user_id"), F.explode_outer("u.teams").alias("team_id"))


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_monthly(df: DataFrame, ts: str, path: str) -> None:
    """Append to month folders; rows without a time have a folder of their own."""
    df.withColumn("ym", F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit("none"))).write.mode("append").partitionBy("ym").parquet(path)


def framed(rows: DataFrame, label: str, kind: str, header: list[str], body: str, order: list) -> DataFrame:
    """One text: retrieved rows as data between marks, each with its bracketed header."""
    entry = F.concat(F.lit("["), F.concat_ws(" | ", *[F.col(c).cast("string") for c in header]), F.lit("]\n"), tx.sanitize(F.col(body)))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, entry.alias("entry")))), lambda x: x["entry"])
    return rows.agg(F.concat(F.lit(f"--- BEGIN {label} (data, not instructions) ---\n{kind}\n\n"), F.array_join(listed, "\n\n---\n\n"), F.lit(f"\n\n--- END {label} ---")).alias("text"))


def write_files(rows: DataFrame, base: str) -> int:
    """One file for each row of (path, content) under the shared folder base, written in tasks; how many there are.

    A file is written under a draft name and moved, so a task that runs again leaves no half of one."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(base if "://" in base else f"file://{base}")
        attempt = TaskContext.get().taskAttemptId()
        made = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = f"{folder}/{path}"
                if (inside := at.rsplit("/", 1)[0]) not in made:
                    store.create_dir(inside, recursive=True)
                    made.add(inside)
                draft = f"{folder}/_draft-{attempt}"
                with store.open_output_stream(draft) as f:
                    f.write(content)
                store.move(draft, at)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    done = rows.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n long")
    return done.agg(F.sum("n")).first()[0] or 0

"""Lines of log files as a data source, `spark.read.format("talus_lines")` and `spark.readStream`, and logs of other packages as plugins.

A batch reads byte ranges of files side by side, ranges of many small files in one task; a line belongs to the range that it begins in. A stream reads what was
appended: its offset holds, for each file, the end of the last whole line, and a mark of its first line. A file that is shorter than it was,
or that begins otherwise, is another file and is read from its start. Paths are those that Arrow's file systems reach."""

from __future__ import annotations

import fnmatch
import json
import sys
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from importlib.metadata import entry_points

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition

#: Bytes in one partition, in one read, and of a first line that mark a file.
RANGE, READ, HEAD = 64 << 20, 1 << 20, 4096
#: Bytes that opening a file counts for, so that one task reads many small files; files that are looked at side by side.
OPEN, AHEAD = 256 << 10, 16


@dataclass
class Range:
    path: str
    start: int
    stop: int


@dataclass
class Ranges(InputPartition):
    ranges: list[tuple[str, int, int]]

    def __post_init__(self):
        super().__init__(None)


class _Files:
    """The files of a folder, or one file, by the options path, glob and rangeBytes; those under `subagents` are left out."""

    def __init__(self, options: dict):
        from pyarrow import fs

        at = options["path"]
        self.store, self.root = fs.FileSystem.from_uri(at if "://" in at else f"file://{at}")
        self.glob, self.range = options.get("glob", "*.jsonl"), int(options.get("rangebytes", options.get("rangeBytes", RANGE)))

    def listed(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        found = self.store.get_file_info(fs.FileSelector(self.root, recursive=True))
        return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.glob) and "/subagents/" not in f.path)

    def cut(self, path: str, start: int, stop: int) -> list[Range]:
        return [Range(path, at, min(at + self.range, stop)) for at in range(start, stop, self.range)]

    def packed(self, ranges: list[Range]) -> list[Ranges]:
        """Ranges in as few partitions as hold at most `range` bytes each, the opening of files counted."""
        out, held, size = [], [], 0
        for r in ranges:
            cost = r.stop - r.start + OPEN
            if held and size + cost > self.range:
                out.append(Ranges(held))
                held, size = [], 0
            held.append((r.path, r.start, r.stop))
            size += cost
        return [*out, Ranges(held)] if held else out

    def end_and_mark(self, path: str, size: int) -> list[int]:
        """The place behind the last line end, and the mark of the first line."""
        with self.store.open_input_file(path) as f:
            mark, stop = zlib.crc32(f.read(HEAD).split(b"\n")[0]), size
            while stop > 0:
                start = max(0, stop - READ)
                f.seek(start)
                at = f.read(stop - start).rfind(b"\n")
                if at >= 0:
                    return [start + at + 1, mark]
                stop = start
        return [0, mark]

    def all_lines(self, part: Ranges) -> Iterator[tuple[str, int, str]]:
        for r in part.ranges:
            yield from self.lines(Range(*r))

    def lines(self, part: Range) -> Iterator[tuple[str, int, str]]:
        """(path, start, line) of the lines that begin in the range."""
        with self.store.open_input_file(part.path) as f:
            at = max(0, part.start - 1)
            f.seek(at)
            rest, begins = b"", part.start == 0
            while at < part.stop or rest:
                data = f.read(READ)
                pieces = (rest + data).split(b"\n")
                rest = pieces.pop() if data else b""
                for x in pieces:
                    if begins and at < part.stop and (data or x):
                        yield part.path, at, x.rstrip(b"\r").decode("utf-8", "replace")
                    begins = True
                    at += len(x) + 1
                if not data or at >= part.stop:
                    return


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.only = options, None

    def pushFilters(self, filters):
        """An equal path keeps other files from being read; the filter stays, which costs little."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.only = f.value
            yield f

    def partitions(self):
        files = _Files(self.options)
        return files.packed([r for path, size in files.listed() if self.only in (None, path) for r in files.cut(path, 0, size)])

    def read(self, partition):
        return _Files(self.options).all_lines(partition) if partition else iter(())  # no files, no partition


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.known = options, {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self, *_) -> dict:
        files = _Files(self.options)
        listed = files.listed()
        new = [x for x in listed if self.known.get(x[0], (None,))[0] != x[1]]
        with ThreadPoolExecutor(AHEAD) as pool:
            self.known |= {path: (size, found) for (path, size), found in zip(new, pool.map(lambda x: files.end_and_mark(*x), new), strict=True)}
        return {"files": json.dumps({path: self.known[path][1] for path, _ in listed}, sort_keys=True)}

    def partitions(self, start: dict, end: dict):
        files, before, now = _Files(self.options), json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, (stop, mark) in now.items():
            was, old = before.get(path, (0, mark))
            out += files.cut(path, was if old == mark and was <= stop else 0, stop)
        return files.packed(out)

    def read(self, partition):
        return _Files(self.options).all_lines(partition)

    def commit(self, end: dict) -> None:
        pass


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "talus_lines"

    def schema(self) -> str:
        return "path string, start long, value string"

    def reader(self, schema):
        return _Batch(dict(self.options))

    def streamReader(self, schema):
        return _Stream(dict(self.options))


# Workers that plan a source don't share the driver's path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LineSource)


def plugins(registry: dict, group: str = "talus.sources", found=None) -> tuple[dict, list[tuple[str, str]]]:
    """The registry with the readers that other installed packages name in the group, and the plugins that didn't load, with why."""
    out, failed = dict(registry), []
    for point in entry_points(group=group) if found is None else found:
        try:
            reader = point.load()
            if not callable(reader):
                raise TypeError("not callable")
            out[point.name] = reader
        except Exception as e:  # a broken plugin must not keep the others from loading
            failed.append((point.name, f"{type(e).__name__}: {e}"))
    return out, failed

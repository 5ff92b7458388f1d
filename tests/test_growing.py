from pathlib import Path

import pytest

from talus.sources import growing, sessions
from talus.streaming import incremental as inc


def logs(spark, path, **options):
    growing.register(spark)
    return spark.read.format("talus_lines").options(**options).load(str(path))


def test_ranges_hold_every_line_once(spark, tmp_path):
    text = "\n".join(["a", "", "bé😀" * 50, "c" * 300, "", "end"])
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "one.jsonl").write_bytes(text.encode())
    (tmp_path / "two.jsonl").write_bytes(b"w\r\nlast\n")
    (tmp_path / "empty.jsonl").write_bytes(b"")
    (tmp_path / "no.txt").write_bytes(b"no\n")
    (tmp_path / "subagents").mkdir()
    (tmp_path / "subagents" / "s.jsonl").write_bytes(b"no\n")
    for size in (1, 7, 64, 10**6):
        got = logs(spark, tmp_path, rangeBytes=size).collect()
        assert [r.value for r in sorted(got, key=lambda r: (r.path, r.start))] == ["w", "last", *text.split("\n")]
        at = {r.start: r.value for r in got if r.path.endswith("one.jsonl")}
        assert all(text.encode()[s:].startswith(v.encode()) for s, v in at.items())


def test_an_equal_path_is_pushed_down(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"f{n}.jsonl").write_text(f"{n}\n")
    rows = logs(spark, tmp_path).where(f"path = '{tmp_path}/f1.jsonl'")
    assert [r.value for r in rows.collect()] == ["1"]
    assert rows.rdd.getNumPartitions() == 1


def follow(spark, src, out):
    growing.register(spark)
    stream = spark.readStream.format("talus_lines").option("rangeBytes", 5).load(str(src))
    return inc.run_to_end(stream, f"{out}/o", f"{out}/c").collect()


def test_a_stream_reads_what_was_appended(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    a, b, c = (Path(src / f"{x}.jsonl") for x in "abc")
    a.write_text("a1\na2\npart")
    b.write_text("b1\nb2\nb3\n")
    values = lambda: sorted(r.value for r in follow(spark, src, tmp_path))
    assert values() == ["a1", "a2", "b1", "b2", "b3"]  # a line that isn't ended waits
    assert values() == ["a1", "a2", "b1", "b2", "b3"]  # nothing new
    a.write_text("a1\na2\npartly\na4\n")
    c.write_text("c1\n")
    assert values() == ["a1", "a2", "a4", "b1", "b2", "b3", "c1", "partly"]
    b.write_text("b1\n")  # cut: read from its start again
    c.write_text("d1\nd2\n")  # longer, but another file
    assert values() == sorted(["a1", "a2", "partly", "a4", "b1", "b2", "b3", "c1", "b1", "d1", "d2"])


class Point:
    def __init__(self, name, made):
        self.name, self.made = name, made

    def load(self):
        if isinstance(self.made, Exception):
            raise self.made
        return self.made


def test_plugins_that_fail_are_skipped():
    reader = lambda spark, path: None
    found, failed = growing.plugins(sessions.REGISTRY, found=[Point("mine", reader), Point("broken", ImportError("gone")), Point("odd", 3)])
    assert found["mine"] is reader and set(sessions.REGISTRY) < set(found)
    assert [n for n, _ in failed] == ["broken", "odd"] and "gone" in failed[0][1]
    assert growing.plugins({}) == ({}, [])


def test_no_files(spark, tmp_path):
    assert logs(spark, tmp_path).count() == 0
    with pytest.raises(Exception):
        logs(spark, tmp_path / "missing").count()


def test_small_files_share_a_task(spark, tmp_path):
    for n in range(300):
        (tmp_path / f"{n}.jsonl").write_text(f"{n}\nx\n")
    rows = logs(spark, tmp_path)
    assert rows.rdd.getNumPartitions() == 2
    assert sorted(int(r.value) for r in rows.where("value <> 'x'").collect()) == list(range(300))
    stream = growing._Stream({"path": str(tmp_path)})
    assert len(stream.partitions(stream.initialOffset(), stream.latestOffset())) == 2

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from talus.schema import COMPLETIONS
from talus.sources import files, sessions


def put(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("conv_id", "seq").select(*cols).collect()]


def test_session_jsonl(spark, tmp_path):
    p = tmp_path / "projects" / "-home-me-x"
    put(p / "s1.jsonl", {"type": "summary"}, "", "{broken", "[1]", {"type": "user", "timestamp": "2026-01-01T00:00:02Z", "cwd": "/p\u0000/x", "message": {"content": " hi "}}, {"type": "assistant", "timestamp": "2026-01-01T00:00:01Z", "message": {"content": [{"type": "text", "text": "a"}, {"type": "tool_result", "tool_use_id": "t9"}, "b", {"type": "image"}]}}, {"type": "user", "message": {"content": "[not a list"}}, {"type": "user", "message": {"content": ""}}, {"type": "user", "message": {"content": "AKIA" + "A" * 16}})
    put(p / "subagents" / "s2.jsonl", {"type": "user", "message": {"content": "no"}})
    c, m = sessions.session_jsonl(spark, str(tmp_path))
    assert rows(m, "msg_id", "role", "content") == [("s1:4", "user", "hi"), ("s1:5", "assistant", "a\n[tool_result:t9]\nb"), ("s1:6", "user", "[not a list"), ("s1:8", "user", "[REDACTED:aws-akid]")]
    r = c.first()
    assert (r.conv_id, r.title, r.msg_count) == ("claude_code:s1", "home/me/x", 4)
    assert r.started_at.second == 2 and r.ended_at.second == 1  # in the order of the file
    assert sessions.header_cwd(spark, str(tmp_path)).first().cwd == "/p/x"


def test_history_jsonl(spark, tmp_path):
    put(tmp_path / "history.jsonl", {"session_id": "a", "ts": 5, "text": "exit"}, {"session_id": "a", "ts": 7, "text": "second\nline"}, {"session_id": "a", "ts": 6, "text": " first "}, {"session_id": "b", "ts": 1, "text": "quit"}, {"session_id": "", "ts": 1, "text": "x"}, {"session_id": "c", "ts": 1, "text": 5})
    c, m = sessions.history_jsonl(spark, str(tmp_path))
    assert rows(m, "conv_id", "seq", "content") == [("codex:a", 1, "first"), ("codex:a", 2, "second\nline")]
    r = c.first()
    assert (r.title, r.msg_count, r.started_at.second, r.ended_at.second) == ("first", 2, 5, 7)
    put(tmp_path / "rollout-1.jsonl", {"type": "session_meta", "payload": {"id": "a", "cwd": "/w"}}, {"type": "x"})
    assert sessions.rollout_cwd(spark, str(tmp_path)).collect() == [("a", "/w")]


def test_transcript_jsonl(spark, tmp_path):
    put(tmp_path / "sid" / ".system_generated" / "logs" / "transcript.jsonl", {"type": "USER_INPUT", "created_at": "2026-01-01T00:00:00Z", "content": "x <USER_REQUEST>\ndo it\n</USER_REQUEST> y"}, {"type": "OTHER", "content": "z"}, {"type": "PLANNER_RESPONSE", "content": "ok"})
    _, m = sessions.transcript_jsonl(spark, str(tmp_path))
    assert rows(m, "conv_id", "seq", "role", "content") == [("antigravity:sid", 0, "user", "do it"), ("antigravity:sid", 2, "assistant", "ok")]


def test_event_stream_coalesces_parts(spark, tmp_path):
    part = lambda t, turn, step, at: {"type": "context.append_loop_event", "time": at, "event": {"type": "content.part", "turnId": turn, "stepUuid": step, "part": {"type": "text", "text": t}}}
    put(tmp_path / "s" / "wire.jsonl", {"type": "metadata", "created_at": 1000}, {"type": "context.append_message", "time": 1500, "message": {"role": "user", "content": "q"}}, part("a", "1", "x", 2000), {"type": "tool.call"}, part("b", "1", "x", 2500), part("c", "1", "y", 3000), {"type": "context.append_message", "time": 4000, "message": {"role": "user", "content": "r"}}, part("d", "1", "y", 5000))
    base = spark.sql("SELECT 's' AS session_id, timestamp'2026-01-01 00:00:00' AS base_time")
    _, m = sessions.event_stream_jsonl(spark, str(tmp_path), base)
    assert rows(m, "seq", "role", "content", F.date_format("ts", "ss.SSS")) == [(1, "user", "q", "00.500"), (2, "assistant", "a\nb", "01.000"), (5, "assistant", "c", "02.000"), (6, "user", "r", "03.000"), (7, "assistant", "d", "04.000")]


def test_summary_sessions_interpolate(spark, tmp_path):
    put(tmp_path / "g" / "summary.json", {"info": {"id": "g1"}, "created_at": "2026-01-01T00:00:00Z", "updated_at": "2026-01-01T00:00:10Z", "generated_title": "T"})
    put(tmp_path / "g" / "chat_history.jsonl", {"type": "user", "content": "no query"}, "", {"type": "user", "content": "<user_query> q </user_query>"}, {"type": "assistant", "content": "a", "model_id": "m1"}, {"type": "assistant", "content": "b"})
    c, m = sessions.summary_sessions(spark, str(tmp_path))
    assert rows(m, "seq", "content", F.date_format("ts", "ss")) == [(1, "q", "00"), (2, "a", "05"), (3, "b", "10")]
    assert (c.first().title, c.first().model) == ("T", "m1")


def test_zip_exports(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir(), two.mkdir()
    node = lambda i, role, content: {"message": {"id": i, "author": {"role": role}, "content": content, "create_time": 1.5}}
    mapping = {"z": {"message": None}, "b": node("m1", "user", {"content_type": "text", "parts": ["x", {"k": 1}, "y"]}), "a": node("m2", "assistant", {"content_type": "code", "text": " c "}), "c": node("m3", "robot", {"parts": ["n"]})}
    with zipfile.ZipFile(one / "e.zip", "w") as z:
        z.writestr("conversations-000.json", json.dumps([{"conversation_id": "k", "title": "T" * 600, "create_time": 1, "update_time": 2, "mapping": mapping}]))
        z.writestr("other.json", "[]")
    c, m = sessions.sharded_export(spark, str(one))
    assert rows(m, "msg_id", "seq", "role", "content") == [("m1", 1, "user", "x y"), ("m2", 2, "assistant", "c")]
    assert len(c.first().title) == 500 and c.first().msg_count == 2
    with zipfile.ZipFile(two / "e.zip", "w") as z:
        z.writestr("conversations.json", json.dumps([{"uuid": "u", "name": "N", "created_at": "2026-01-01T00:00:00Z", "chat_messages": [{"uuid": "1", "sender": "human", "text": " hi "}, {"sender": "assistant", "text": "", "content": [{"type": "text", "text": "t"}, {"type": "tool_use", "name": "f"}, {"type": "tool_result"}]}, {"sender": "x", "text": "no"}]}]))
    c, m = sessions.web_export(spark, str(two))
    assert rows(m, "msg_id", "role", "content") == [("1", "user", "hi"), ("claude_ai:u:1", "assistant", "t\n[tool_use:f]\n[tool_result]")]


def test_rotated_log(spark, tmp_path):
    put(tmp_path / "c.jsonl", {"source": "a", "elapsed_ms": 5}, "{bad")
    put(tmp_path / "c.jsonl.1", {"source": "b"})
    put(tmp_path / "c.jsonl.9", {"source": "no"})
    assert sorted(r.source for r in files.rotated_log(spark, str(tmp_path), "c.jsonl", COMPLETIONS).collect()) == ["a", "b"]


def test_vault(spark, tmp_path):
    put(tmp_path / "a.md", "---", "name: 'N'", "scope: shared", "name: other", "---", "body [[b]]")
    put(tmp_path / "b.md", "no front")
    got = {r.stem: r for r in files.vault(spark, str(tmp_path)).collect()}
    assert got["a"].front == {"name": "N", "scope": "shared"} and got["a"].body.strip() == "body [[b]]" and got["b"].front == {}


def test_source_files_and_chunks(spark, tmp_path):
    code = "def a():\n    x = 1\n    def b():\n        y = 2\n        z = 3\n        return y\n    return b\n\ndef short():\n    pass\n"
    put(tmp_path / "pkg" / "m.py", code)
    put(tmp_path / "build" / "n.py", code)
    put(tmp_path / "secrets.py", code)
    put(tmp_path / "pkg" / "big.py", "#" * (files.MAX_BYTES + 1))
    put(tmp_path / "pkg" / "key.py", "def k():\n    a = 'sk-ant-x'\n    b = 1\n    return a\n")
    src = files.source_files(spark, str(tmp_path))
    assert sorted(r.path for r in src.collect()) == ["pkg/key.py", "pkg/m.py"]
    assert sorted((r.symbol, r.kind) for r in files.code_chunks(src).collect()) == [("a", "function"), ("a.b", "method")]


def test_sinks(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2026-01-05 00:00:00' AS ts, 1 AS x UNION ALL SELECT null, 2")
    files.write_monthly(df, "ts", str(tmp_path / "m"))
    assert {r.ym for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {"2026-01", "none"}
    files.append_jsonl(df, str(tmp_path / "j"))
    files.append_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    t = files.framed(spark.createDataFrame([(2, "b"), (1, "![x](http://e)")], "id long, body string"), "X", "k", ["id"], "body", ["id"]).first().text
    assert t.index("[1]\n[image-stripped:http://e]") < t.index("[2]\nb") and t.endswith("--- END X ---")


@pytest.mark.parametrize("name", ["claude-code", "chatgpt", "claude-ai", "codex", "antigravity", "kimi", "grok"])
def test_registry(name):
    assert callable(sessions.REGISTRY[name])


@pytest.mark.parametrize("version", [2, 4])
def test_tracked_files_equal_what_the_tool_lists(spark, tmp_path, version):
    import shutil
    import subprocess

    if not shutil.which("git"):
        pytest.skip("no git")
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "r"), "-c", "core.quotePath=false", *a], check=True, capture_output=True, text=True).stdout
    for p in ("a.py", "deep/er/b.py", "deep/er/bb.py", "é x.js", "not.txt"):
        put(tmp_path / "r" / p, f"# {p}\n")
    (tmp_path / "r" / "link.py").symlink_to("/etc/passwd")
    git("init", "-q")
    git("add", "a.py", "deep", "é x.js", "link.py")
    git("update-index", "--index-version", str(version))
    listed = {x for x in git("ls-files", "-z").split("\0") if x}
    got = {r.path: r.size for r in files.tracked_files(spark, str(tmp_path / "r")).collect()}
    assert set(got) == listed - {"link.py"} and got["a.py"] == len("# a.py\n\n")


def test_an_index_of_another_format_lists_nothing(spark, tmp_path):
    for n, raw in enumerate((b"", b"DIRC\0\0\0\x09\0\0\0\x01", b"no index at all, really")):
        (tmp_path / str(n) / ".git").mkdir(parents=True)
        (tmp_path / str(n) / ".git" / "index").write_bytes(raw)
    assert files.tracked_files(spark, f"{tmp_path}/*").count() == 0


def test_vault_is_listed_and_read_in_tasks(spark, tmp_path):
    """Nested, top-level and odd names are found, hidden and other files aren't; the driver holds no list of files."""
    for name in ("a.md", "x/b c.md", "x/y/z/d.md", "x/_e.md", ".h/f.md", "x/.h/f.md", "x/g.txt", "x/y/é.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("---\nname: n\n---\n" + name)
    v = files.vault(spark, str(tmp_path))
    assert sorted(r.body for r in v.collect()) == ["a.md", "x/b c.md", "x/y/z/d.md", "x/y/é.md"]
    assert {r.path for r in v.collect()} == {f"file://{tmp_path}/{n}" for n in ("a.md", "x/b c.md", "x/y/z/d.md", "x/y/é.md")}
    assert sorted(r.body for r in files.vault(spark, f"file://{tmp_path}/x/*").collect()) == ["x/b c.md", "x/y/z/d.md", "x/y/é.md"]
    assert v._jdf.inputFiles().__len__() == 0

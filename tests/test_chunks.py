import ast
import inspect
import json.decoder
import textwrap

import pytest
from pyspark.sql import functions as F

from talus.operators import chunks

JS = '''// function no() {
const s = "function nope() {";
export async function outer(a, b = (1, 2)) {
  const re = /[{]/g, t = `x ${a} {`;
  let inner = (p) => {
    if (p) { return 1 }
    return a / 2 / b
  }
  obj.handler = async function () {
    x()
  };
}
class K extends B {
  constructor() { super() }
  static async run(a,
      b) {
    for (const i of a) { b(i) }
  }
  get value()
  {
    return 3
  }
}
const o = {
  key: function () {
    return {a: 1}
  },
  "other-key": () => {
  },
  short() { return 1 },
}
el.on("x", () => {
  function deep() {
    y()
  }
})
const f = async x => {
}
function typed<T>(a: T): Promise<void> {
}
function open() {
'''
SHELL = '''#!/bin/bash
# f() {
f() {
  echo "}" '}' ${x} ${#y}
  cat <<EOF
}
EOF
  if true; then { echo; }; fi
}
function g {
  h() {
    :
  }
}
'''
HTML = "<p>\n<script type=x>\nfunction a() {\n}\n</script>\n<SCRIPT>function b() {\n}</SCRIPT><script>function open() {"


def found(spark, path, content):
    rows = chunks.functions(spark.createDataFrame([(path, content)], "path string, content string")).collect()
    return [(r.symbol, r.kind, r.start_line, r.end_line) for r in sorted(rows, key=lambda r: (r.start_line, -r.end_line))]


def test_brace_functions(spark):
    assert found(spark, "x/a.ts", JS) == [
        ("outer", "function", 3, 12), ("outer.inner", "function", 5, 8), ("outer.obj.handler", "function", 9, 11), ("constructor", "method", 14, 14),
        ("run", "method", 15, 18), ("value", "method", 19, 22), ("key", "function", 25, 27), ("other-key", "function", 28, 29), ("short", "method", 30, 30),
        ("deep", "function", 33, 35), ("f", "function", 37, 38), ("typed", "function", 39, 40),
    ]


def test_shell_functions(spark):
    assert found(spark, "b.sh", SHELL) == [("f", "function", 3, 9), ("g", "function", 10, 14), ("g.h", "function", 11, 13)]
    assert found(spark, "b.bash", SHELL.replace("\n", "\r\n"))[0] == ("f", "function", 3, 9)


def test_functions_of_scripts_count_the_lines_of_the_page(spark):
    assert found(spark, "d.HTML", HTML) == [("a", "script_fn", 3, 4), ("b", "script_fn", 6, 7)]


def by_parser(source: str) -> list[tuple]:
    """What the language's own parser says: heads of classes reach to their docstring, or to their body's first line."""
    out = []

    def walk(node, names):
        for x in ast.iter_child_nodes(node):
            if not isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                walk(x, names)
                continue
            body = x.body[0]
            if isinstance(x, ast.ClassDef):
                first = min([body.lineno, *(d.lineno for d in getattr(body, "decorator_list", []))])
                end = body.end_lineno if isinstance(body, ast.Expr) and isinstance(body.value, ast.Constant) and isinstance(body.value.value, str) else first
                out.append((".".join([*names, x.name]), "class", x.lineno, end))
            else:
                out.append((".".join([*names, x.name]), "method" if names else "function", x.lineno, x.end_lineno))
            walk(x, [*names, x.name])

    walk(ast.parse(source), [])
    return sorted(out, key=lambda r: (r[2], -r[3]))


@pytest.mark.parametrize("module", [json.decoder, textwrap, ast, inspect])
def test_python_functions_equal_the_parser(spark, module):
    source = inspect.getsource(module)
    got = found(spark, "m.py", source)
    lines = source.split("\n")
    # A block's last comment lines, of deeper indentation, belong to it here and not to the parser's node.
    for have, want in zip(got, by_parser(source), strict=True):
        assert have[:3] == want[:3] and have[3] >= want[3]
        assert all(not x.strip() or x.strip().startswith("#") for x in lines[want[3] : have[3]])


def test_edges_and_bodies(spark):
    rows = [("a.py", None), ("b.py", ""), ("c.txt", "def f():\n  pass\n"), ("noext", "x"), (None, "def f(): pass"), ("e.py", "def f(:\n '''open"), ("f.js", "function a() {\n{{{"), ("g.js", "}}} function a() {\n\n\n}")]
    files = spark.createDataFrame(rows, "path string, content string")
    assert sorted((r.path, r.symbol) for r in chunks.functions(files).collect()) == [("e.py", "f"), ("g.js", "a")]
    assert [r.symbol for r in chunks.chunks(files).collect()] == ["a"]
    assert chunks.chunks(files.limit(0)).count() == 0
    long = chunks.chunks(spark.createDataFrame([("a.py", "def f():\n" + "    x = 1\n" * 2000)], "path string, content string")).first()
    assert long.truncated and len(long.content) == 6000 and long.end_line == 2001
    two = spark.createDataFrame([("a.py", "class A:\n    def f(self):\n        return 1\n\ndef f():\n    return 2\n")], "path string, content string")
    wanted = spark.createDataFrame([("a.py", "f"), ("a.py", "A.f"), ("a.py", "x.f"), ("a.py", "zz"), ("q.py", "f")], "path string, wanted string")
    got = {(r.path, r.wanted): r.content for r in chunks.symbol_bodies(two, wanted).collect()}
    assert got == {("a.py", "f"): "def f():\n    return 2", ("a.py", "A.f"): "    def f(self):\n        return 1", ("a.py", "x.f"): "    def f(self):\n        return 1", ("a.py", "zz"): None, ("q.py", "f"): None}


def test_scripts_keep_order_and_place(spark):
    got = spark.createDataFrame([("<script>a</script>\n\n<script\n src=x>b\nc</script>", ), (None,), ("<script>open",)], "h string").select(chunks.scripts(F.col("h")).alias("s")).collect()
    assert [[(x.js, x.above) for x in r.s] for r in got] == [[("a", 0), ("b\nc", 3)], [], []]


def test_no_shuffle_carries_texts_to_the_state_of_chunks(spark, sf):
    import __spark_entry__

    def nodes(plan):
        yield plan
        for n in range(plan.children().size()):
            yield from nodes(plan.children().apply(n))

    plan = __spark_entry__.queries()["chunk_state"](spark, sf)._jdf.queryExecution().optimizedPlan()
    joined = [x.output().mkString(",") for x in nodes(plan) if x.nodeName() == "Join"]
    assert joined and not any("text#" in x for x in joined)


def test_comments_and_strings_are_one_step(spark):
    """Runs of comment lines are one token and lines of a string one step; lines are numbered as before, and files are read once."""
    text = "\n".join(f"line {i} (" for i in range(50))
    js = "function f() {\n  // " + text.replace("\n", "\n\n  // ") + "\n  a() // x\n}\n"
    sh = "# " + text.replace("\n", "\n  # ") + "\nf() {\n  :\n}\n"
    py = "def f():\n    x = 1 + \\\n        2\n    s = f'''" + text + "''' + (\n        '')\n\n\nclass K:\n    '''" + text + "'''\n    y = '''a\nb'''\n\n    def m(self): return 1\n"
    assert found(spark, "a.js", js) == [("f", "function", 1, 102)]
    assert found(spark, "a.sh", sh) == [("f", "function", 51, 53)]
    assert found(spark, "a.py", py) == [("f", "function", 1, 54), ("K", "class", 57, 107), ("K.m", "method", 111, 111)]
    size = lambda source, pattern: spark.createDataFrame([(source,)], "t string").select(F.size(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)))).first()[0]
    assert size(js, chunks.BRACES) < 50 and size(sh, chunks.SHELL) < 50
    files = spark.createDataFrame([("a.js", js)], "path string, content string")
    assert chunks.functions(files)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1

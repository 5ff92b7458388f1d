import json

import pytest
from pyspark.sql import functions as F

from talus.functions import front
from talus.sources import files

NESTED = '''
# a comment
name: "N: \\"x\\""   
single: 'it''s'
n: 3
x: 1.5
yes: true
none: ~
url: http://a.b/c#d
note: plain # not this
list:
- a
- 'b: c'
-
  - deep
  - [1, "two, 2", {k: v}]
flow: {a: 1, "b c": [x, y], empty: {}}
long: [1,
  2]
map:
  inner:
    leaf: 1
  other: text
    goes on
people:
  - name: A
    teams: [t1]
  - name: B
    teams:
    - t2
block: |
  line 1
    indented

  line 2
folded: >-
  one
  two

  three
last:
name: again
'''


def test_nested_values():
    assert front.parse(NESTED) == {
        "name": 'N: "x"', "single": "it's", "n": 3, "x": 1.5, "yes": True, "none": None, "url": "http://a.b/c#d", "note": "plain",
        "list": ["a", "b: c", ["deep", [1, "two, 2", {"k": "v"}]]], "flow": {"a": 1, "b c": ["x", "y"], "empty": {}}, "long": [1, 2],
        "map": {"inner": {"leaf": 1}, "other": "text goes on"}, "people": [{"name": "A", "teams": ["t1"]}, {"name": "B", "teams": ["t2"]}],
        "block": "line 1\n  indented\n\nline 2\n", "folded": "one two\nthree", "last": None,
    }


@pytest.mark.parametrize("text, want", [("", None), ("# only", None), ("- a\n- b", ["a", "b"]), ("word", "word"), ("[a, b]", ["a", "b"]), ("a: ''\nb: \"\"", {"a": "", "b": ""}), ("a:\r\n  b: 1\r\n", {"a": {"b": 1}})])
def test_small_documents(text, want):
    assert front.parse(text) == want


@pytest.mark.parametrize("text", ["a: [1, 2", "a: 1\n   b: 2\n c: 3", "a: {b: 'x}"])
def test_what_does_not_fit(text):
    with pytest.raises(ValueError):
        front.parse(text)


def test_json_of_json_is_the_same():
    value = {"a": [1, {"b": None, "c": [True, "x: y", "é"]}], "d": {}, "e": [], "f": -2.5}
    assert front.parse(json.dumps(value)) == value and front.parse(json.dumps(value, indent=2)) == value


def test_columns(spark):
    rows = [(1, "---\ntags: [a, b]\nmeta:\n  k: 1\n---\nbody"), (2, "no front"), (3, None), (4, "---\n---\nx"), (5, "---\na: [\n---\nx"), (1, "---\nx: 1\n---")]
    df = spark.createDataFrame(rows, "json string, text string" if False else "id int, text string").withColumn("f", front.front_matter(F.col("text")))
    got = [(r.id, r.j) for r in front.with_json(df, "f", "j").collect()]
    assert got == [(1, '{"tags": ["a", "b"], "meta": {"k": 1}}'), (2, None), (3, None), (4, None), (5, None), (1, '{"x": 1}')]


def test_vault_and_roster(spark, tmp_path):
    (tmp_path / "n.md").write_text("---\nname: 'A'\ntags:\n  - x\n  - y\nmeta: {k: v}\n---\nbody\n")
    (tmp_path / "plain.md").write_text("no front")
    got = {r.stem: (r.front, r.front_json, r.body) for r in files.vault(spark, str(tmp_path)).collect()}
    assert got["n"][1:] == ('{"name": "A", "tags": ["x", "y"], "meta": {"k": "v"}}', "body\n") and got["n"][0]["name"] == "A" and got["plain"] == ({}, None, "no front")
    (tmp_path / "r.yaml").write_text("tenant_id: t\nusers:\n  - user_id: u1\n    teams: [a, b]\n  - user_id: u2\n")
    (tmp_path / "r.json").write_text('{"tenant_id": "s", "users": [{"user_id": "u3", "teams": ["c"]}]}')
    both = files.roster(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, both), key=str) == [("s", "u3", "c"), ("t", "u1", "a"), ("t", "u1", "b"), ("t", "u2", None)]

import random
import re

from talus.operators import diffs


def longest_common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_scripts_are_of_least_length(monkeypatch):
    r = random.Random(1)
    for most in (1000, 2):
        monkeypatch.setattr(diffs, "MOST_EDITS", most)
        for _ in range(3000):
            a, b = ([r.randrange(4) for _ in range(r.randrange(14))] for _ in range(2))
            m = diffs.edit_script(a, b)
            assert all(a[i] == b[j] for i, j in m) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:], strict=False))
            assert len(m) == longest_common(a, b)


def patched(old: list[str], diff: list[str]) -> list[str]:
    """The old lines after a unified diff, every line of which must fit."""
    out, at = [], 0
    for line in diff[2:]:
        if m := re.fullmatch(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
            first = int(m[1]) - (m[2] != "0")
            out += old[at:first]
            at = first
            assert len(out) == int(m[3]) - (m[4] != "0")
        elif line[0] == "+":
            out.append(line[1:])
        else:
            assert old[at] == line[1:]
            out += [line[1:]] if line[0] == " " else []
            at += 1
    return out + old[at:]


def test_diffs_apply_as_patches(spark):
    r = random.Random(2)
    text = lambda n: "\n".join(r.choices("abcdefgh", k=n)) + r.choice(["", "\n"])
    rows = [(i, text(r.randrange(40)), text(r.randrange(40))) for i in range(60)]
    for i in range(60, 90):
        a = [str(x) for x in range(60)]
        b = [x for x in a if r.random() > 0.05] + ["end"] * r.randrange(2)
        rows.append((i, "\n".join(a), "\n".join(b)))
    rows += [(100, None, "x\r\ny"), (101, "x", None), (102, None, None), (103, "same\n", "same"), (103, "same\n", "same"), (104, "", "\n")]
    got = diffs.unified(spark.createDataFrame(rows, "k int, x string, y string"), ["k"], "x", "y", diffs.F.col("k").cast("string")).collect()
    assert len(got) == len(rows) - 1  # equal rows of one key are one text pair
    by = {k: (x, y) for k, x, y in rows}
    for g in got:
        a, b = ((v or "").splitlines() for v in by[g.k])
        diff = g.diff.split("\n") if g.diff else []
        assert patched(a, diff) == b and g.n_lines == len(diff)
        assert (g.added, g.removed) == (len(b) - longest_common(a, b), len(a) - longest_common(a, b))
        assert not diff or diff[:2] == [f"--- a/{g.k}", f"+++ b/{g.k}"]


def test_hunks_hold_three_lines_of_context(spark):
    a = [str(i) for i in range(30)]
    b = a[:5] + ["new"] + a[5:12] + a[13:25] + a[26:]
    row = spark.createDataFrame([(1, "\n".join(a), "\n".join(b))], "k int, x string, y string")
    diff = diffs.unified(row, ["k"], "x", "y", diffs.F.lit("p")).first().diff.split("\n")
    assert [x for x in diff if x[0] == "@"] == ["@@ -3,6 +3,7 @@", "@@ -10,7 +11,6 @@", "@@ -23,7 +23,6 @@"]
    assert diffs.unified(row.limit(0), ["k"], "x", "y", diffs.F.lit("p")).count() == 0

"""Secret scans by one combined deterministic automaton.

All rules are compiled together: subset construction over their patterns, then minimisation, gives one transition array over classes
of bytes. Each state holds, for every rule, the threads of the leftmost match under way, so a match ends by itself, later starts within
it are dropped and the search begins anew behind it: non-overlapping leftmost matches in one pass. Where a match ends is read off
the states; where it began, by a reversed automaton of its rule, run back from its end. Texts are scanned in many lanes at once; a
lane that began in another state than its neighbour ended in is put right until both agree."""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, ship, spread


@dataclass(frozen=True)
class Rule:
    """A pattern over ASCII: literals, classes, groups, |, ?, *, +, {n} and {n,}. `head` matches what stands before the secret itself;
    matches whose rest has fewer than `least` characters are dropped, but what they cover stays covered."""

    kind: str
    pattern: str
    least: int = 0
    head: str = ""


def either_case(pattern: str) -> str:
    """The pattern with each letter outside classes as a class of both its cases."""
    out, inside = [], False
    for c in pattern:
        inside = c == "[" or inside and c != "]"
        out.append(f"[{c.upper()}{c.lower()}]" if c in string.ascii_letters and not inside else c)
    return "".join(out)


_NAME = either_case("(password|passwd|secret|token|api_?key)") + "[\"']? *[:=] *[\"']?"
#: The rules that every scan reports.
BASE = (
    Rule("assign", _NAME + "[A-Za-z0-9+/_.=-]+", 8, _NAME),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]{32,}"),
)
#: Spans added to those: tokens of code hosts and chat services, signed web tokens, and headers of private keys.
MORE = (
    Rule("host_token", "gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("web_token", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 40),
    Rule("private_key", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
)


# Patterns to automata


class _Nfa:
    """edges[state]: (set of bytes, next) or (None, next) for a free step."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset[int] | None, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def link(self, a: int, over: frozenset[int] | None, b: int) -> None:
        self.edges[a].append((over, b))

    def closure(self, states) -> frozenset[int]:
        seen, left = set(states), list(states)
        while left:
            for over, b in self.edges[left.pop()]:
                if over is None and b not in seen:
                    seen.add(b)
                    left.append(b)
        return frozenset(seen)

    def step(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closure({b for a in states for over, b in self.edges[a] if over is not None and byte in over})


def _parse(pattern: str):
    """Nested tuples: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most or None)."""
    at = 0

    def alternatives():
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence():
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            one = atom()
            while at < len(pattern) and pattern[at] in "?*+{":
                c = pattern[at]
                if c == "{":
                    end = pattern.index("}", at)
                    low, comma, high = pattern[at + 1 : end].partition(",")
                    one, at = ("rep", one, int(low), int(high) if high else None if comma else int(low)), end + 1
                else:
                    one, at = ("rep", one, int(c == "+"), 1 if c == "?" else None), at + 1
            parts.append(one)
        return ("cat", parts)

    def atom():
        nonlocal at
        c = pattern[at]
        if c == "(":
            at += 1
            inner = alternatives()
            at += 1
            return inner
        if c == "[":
            end = pattern.index("]", at + 1)
            body, chosen, i = pattern[at + 1 : end], set(), 0
            while i < len(body):
                high = body[i + 2] if body[i + 1 : i + 2] == "-" and i + 2 < len(body) else body[i]
                chosen.update(range(ord(body[i]), ord(high) + 1))
                i += 3 if high != body[i] or body[i + 1 : i + 2] == "-" and i + 2 < len(body) else 1
            at = end + 1
            return ("set", frozenset(chosen))
        at += 1
        return ("set", frozenset({ord(c)}))

    return alternatives()


def _reversed(node):
    kind = node[0]
    if kind == "set":
        return node
    if kind == "rep":
        return ("rep", _reversed(node[1]), *node[2:])
    parts = [_reversed(x) for x in node[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


def _build(nfa: _Nfa, node, start: int) -> int:
    """Add the node's automaton behind `start`; its end state."""
    kind = node[0]
    if kind == "set":
        end = nfa.state()
        nfa.link(start, node[1], end)
        return end
    if kind == "cat":
        for part in node[1]:
            start = _build(nfa, part, start)
        return start
    if kind == "alt":
        end = nfa.state()
        for part in node[1]:
            nfa.link(_build(nfa, part, start), None, end)
        return end
    _, part, least, most = node
    for _ in range(least):
        start = _build(nfa, part, start)
    if most is None:
        loop = nfa.state()
        nfa.link(start, None, loop)
        nfa.link(_build(nfa, part, loop), None, loop)
        return loop
    end = nfa.state()
    nfa.link(start, None, end)
    for _ in range(most - least):
        start = _build(nfa, part, start)
        nfa.link(start, None, end)
    return end


class _Search:
    """One rule as a search: a state is the thread sets of the starts still under way, earliest first."""

    def __init__(self, rule: Rule):
        self.nfa, self.kind = _Nfa(), rule.kind
        first = self.nfa.state()
        self.end = _build(self.nfa, _parse(rule.pattern), first)
        self.first = self.nfa.closure({first})
        if self.end in self.first or any(self.end in self.nfa.step(self.first, b) for b in range(256)):
            raise ValueError(f"{rule.kind} may match fewer than two characters")

    def accepts(self, state: tuple) -> bool:
        return bool(state) and self.end in state[0]

    def step(self, state: tuple, byte: int) -> tuple:
        if self.accepts(state):
            on = self.nfa.step(state[0], byte)
            if on and self.end not in on:
                raise ValueError(f"{self.kind} may go on without ending again, so its matches can't be told in one pass")
            if on:
                return (on,)
            state = ()
        out, seen = [], set()
        for threads in (*state, self.first):
            # What an earlier start holds too can only give matches that begin earlier.
            on = frozenset(self.nfa.step(threads, byte) - seen)
            if on:
                out.append(on)
                seen |= on
            if self.end in on:
                if len(out) > 1:
                    # An earlier start is still open: its match, if it comes, wins, and this one can't be kept beside it.
                    raise ValueError(f"{self.kind} may end while an earlier start is open")
                break
        return tuple(out)


def _byte_classes(sets: list[frozenset[int]]) -> tuple[np.ndarray, list[int]]:
    """The least partition of bytes by which sets they are in, and a byte of each class."""
    known: dict[tuple, int] = {}
    classes = np.array([known.setdefault(tuple(b in s for s in sets), len(known)) for b in range(256)], dtype=np.uint8)
    return classes, [int(np.flatnonzero(classes == c)[0]) for c in range(len(known))]


def _minimal(table: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no input tells apart: parts by mark are split until their transitions agree. State 0 stays first."""
    part = np.unique(marks, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == part.max():
            break
        part = new
    _, first = np.unique(part, return_index=True)
    order = np.argsort(first)
    name = np.empty(len(order), dtype=np.int64)
    name[order] = np.arange(len(order))
    part, first = name[part], first[order]
    return part[table[first]], marks[first]


def _determinised(start, step, mark, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """States reached from start, by breadth first; their transitions over byte classes, and marks; minimised."""
    number, queue, table = {start: 0}, [start], []
    for state in queue:
        row = []
        for c in range(n_classes):
            to = step(state, c)
            if to not in number:
                number[to] = len(queue)
                queue.append(to)
            row.append(number[to])
        table.append(row)
    return _minimal(np.array(table, dtype=np.int64), np.array([mark(s) for s in queue], dtype=np.int64))


class Automaton:
    """classes: of bytes; table: state x class, flat, of next states times the number of classes; marks: bit i where rule i ends."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        searches = [_Search(r) for r in rules]
        self.classes, sample = _byte_classes([over for s in searches for edges in s.nfa.edges for over, _ in edges if over is not None])
        self.width = len(sample)
        parts = [_determinised((), lambda state, c, s=s: s.step(state, sample[c]), s.accepts, self.width) for s in searches]
        rows, ends = [t.tolist() for t, _ in parts], [m.tolist() for _, m in parts]
        table, self.marks = _determinised((0,) * len(rules), lambda state, c: tuple(r[x][c] for r, x in zip(rows, state, strict=True)), lambda state: sum(int(e[x]) << i for i, (e, x) in enumerate(zip(ends, state, strict=True))), self.width)
        self.table = (table * self.width).astype(np.int32).ravel()
        self.back = [self._anchored(_reversed(_parse(r.pattern))) for r in rules]
        self.heads = [self._anchored(_parse(r.head)) if r.head else None for r in rules]

    @staticmethod
    def _anchored(node) -> tuple[list[list[int]], list[bool]]:
        """Rows of 256 next states, -1 where no match is left, and which states accept."""
        nfa = _Nfa()
        first = nfa.state()
        end = _build(nfa, node, first)
        classes, sample = _byte_classes([over for edges in nfa.edges for over, _ in edges if over is not None])
        table, marks = _determinised(nfa.closure({first}), lambda s, c: nfa.step(s, sample[c]), lambda s: 2 if not s else int(end in s), len(sample))
        full = np.where(marks[table] == 2, -1, table)[:, classes]
        return full.tolist(), (marks == 1).tolist()

    def start_of(self, rule: int, raw: bytes, end: int, floor: int) -> int:
        """Where the match that ends at `end` begins, not before floor."""
        rows, accepts = self.back[rule]
        state, best = 0, end
        for at in range(end - 1, floor - 1, -1):
            state = rows[state][raw[at]]
            if state < 0:
                break
            if accepts[state]:
                best = at
        return best

    def head_end(self, rule: int, raw: bytes, start: int, end: int) -> int:
        rows, accepts = self.heads[rule]
        state, best = 0, start
        for at in range(start, end):
            state = rows[state][raw[at]]
            if state < 0:
                break
            if accepts[state]:
                best = at + 1
        return best


#: Bytes scanned together, and by one lane.
WINDOW, LANE = 4 << 20, 4096


def match_ends(automaton: Automaton, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marks, place behind) of all places where a match ends and doesn't go on; raw ends in a byte that no rule holds."""
    table, marks = automaton.table, np.repeat(automaton.marks.astype(np.uint8), automaton.width)
    found, places, state, ending = [], [], 0, 0
    for at in range(0, len(raw), WINDOW):
        part = raw[at : at + WINDOW]
        n = len(part)
        lanes = -(-n // LANE)
        cls = np.zeros(lanes * LANE, dtype=np.uint8)
        cls[:n] = automaton.classes[part]
        columns = np.ascontiguousarray(cls.reshape(lanes, LANE).T)
        states = np.empty((LANE, lanes), dtype=np.int32)
        now, index = np.zeros(lanes, dtype=np.int32), np.empty(lanes, dtype=np.int32)
        for j in range(LANE):
            np.add(now, columns[j], out=index)
            now = states[j]
            np.take(table, index, out=now, mode="clip")
        states = np.ascontiguousarray(states.T).ravel()
        for first in range(0, n, LANE):
            i, last = first, min(first + LANE, n)
            # The lane ran from the first state; from the true one until both runs agree.
            while state and i < last:
                state = int(table[state + int(cls[i])])
                if states[i] == state:
                    break
                states[i] = state
                i += 1
            state = int(states[last - 1])
        bits = np.take(marks, states[:n])
        before = np.concatenate([[np.uint8(ending)], bits[:-1]])
        over = before & ~bits
        hit = np.flatnonzero(over)
        found.append(over[hit])
        places.append(hit + at)
        ending = int(bits[-1])
    return np.concatenate(found or [np.zeros(0, np.uint8)]), np.concatenate(places or [np.zeros(0, np.int64)])


def spans_of(automaton: Automaton, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, rule, end) in code points, by start and then as rules are listed."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    joined = b"\xff".join([*texts, b""])
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bits, places = match_ends(automaton, np.frombuffer(joined, dtype=np.uint8))
    floor: dict[tuple[int, int], int] = {}
    for text, mark, end in zip(np.searchsorted(offsets, places, side="right") - 1, bits.tolist(), places.tolist(), strict=True):
        for rule, r in enumerate(automaton.rules):
            if mark >> rule & 1:
                begin = automaton.start_of(rule, joined, end, floor.get((text, rule), int(offsets[text])))
                floor[text, rule] = end
                if end - (automaton.head_end(rule, joined, begin, end) if r.head else begin) >= r.least:
                    out[text].append((begin - int(offsets[text]), rule, end - int(offsets[text])))
    for raw, spans in zip(texts, out, strict=True):
        if spans and not raw.isascii():
            before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
            spans[:] = [(int(before[s]), r, int(before[e])) for s, r, e in spans]
        spans.sort()
    return out


def _scan(shared):
    def run(batches):
        import pyarrow as pa

        automaton = shared.value
        rules = automaton.rules
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            found, texts = [], bytes_of(batch.column(1))
            held, size = [], 0
            for text in texts:
                held.append(text)
                size += len(text)
                if size > WINDOW:
                    found += spans_of(automaton, held)
                    held, size = [], 0
            found += spans_of(automaton, held)
            rows = [[{"kind": rules[r].kind, "start": s, "end": e} for s, r, e in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id, spans of every row: array<struct<kind, start, end>> in code points, ends exclusive, by start and then as rules are listed.

    Of each rule the leftmost matches that don't overlap; of different rules they may. Null and empty texts have none. Repeated rows and null
    ids are rows like others; other columns are ignored; an empty table gives an empty result. A text is scanned whole, in windows of
    fixed size. Eight rules at most; a rule
    whose matches one pass can't tell raises ValueError."""
    if len(rules) > 8:
        raise ValueError("eight rules at most")
    ship(docs.sparkSession)
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(rules))  # its size follows from the rules alone
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    schema = rows.select("doc_id", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>").alias("spans")).schema
    return rows.mapInArrow(_scan(automaton), schema)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE, mark: str = "[SECRET]") -> DataFrame:
    """docs with a column `redacted`: the text with each run of overlapping spans replaced by the mark. Rows are found again by id and
    text; null texts stay null."""
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    found = scan(docs.withColumn("__talus_key", key), "__talus_key", text_col, rules).where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("__talus_key")).agg(F.first("spans").alias("__talus_spans"))
    text = F.col(text_col).cast("string")

    def step(acc, s):
        after = F.greatest(acc["at"], s["end"])
        new = s["start"] >= acc["at"]
        gap = F.when(new, F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise("")
        return F.struct(after.alias("at"), F.concat(acc["out"], gap).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate("__talus_spans", start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return docs.withColumn("__talus_key", key).join(found, "__talus_key", "left").withColumn("redacted", F.when(F.col("__talus_spans").isNull(), text).otherwise(done)).select(*[F.col(f"`{c}`") for c in docs.columns], "redacted")


def _oracle() -> str:
    """Each rule's matches are set between two private characters, and places added up over the pieces between those."""
    legs = []
    for k, r in enumerate(BASE + MORE):
        rest = f"regexp_replace(m, '^{_sql(r.head)}', '')" if r.head else "m"
        legs.append(f"""SELECT r, {k} AS k, '{r.kind}' AS kind, s, s + length(m) AS e FROM (
  SELECT r, split_part(piece, chr(57345), 1) AS m, i, CAST(coalesce(sum(length(replace(piece, chr(57345), ''))) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM (
    SELECT r, unnest(p) AS piece, unnest(range(len(p))) AS i FROM (SELECT r, string_split(regexp_replace(x, '{_sql(r.pattern)}', chr(57344) || '\\0' || chr(57345), 'g'), chr(57344)) AS p FROM t))) WHERE i > 0 AND length({rest}) >= {r.least}""")
    return f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
found AS ({' UNION ALL '.join(legs)})
SELECT doc_id, count(f.r) FILTER (k = 0) AS n_assign, count(f.r) FILTER (k = 1) AS n_access, count(f.r) FILTER (k = 2) AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < {len(BASE)}), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k IS NOT NULL), '') AS spans
FROM t LEFT JOIN found f ON f.r = t.r GROUP BY doc_id, t.r
"""


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


ORACLE = _oracle()

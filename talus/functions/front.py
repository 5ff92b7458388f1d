"""Front matter and rosters: nested keys, lists, quoted, flow and block scalars by indentation, as JSON.

A small reader of the part of YAML that such files use; anchors, tags and several documents are none of it."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.session import ship

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#\[\]{},"'&*!|>%@`-][^#:]*?|-[^\s:][^:]*?)\s*:(?:\s+|$)""")
_BLOCK = re.compile(r"([|>])([+-]?)\d*\s*(?:#.*)?$")
_QUOTED = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')\s*(?:#.*)?""")
_PLAIN = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}


def _scalar(text: str):
    text = text.strip()
    if m := _QUOTED.fullmatch(text):
        if m[1][0] == "'":
            return m[1][1:-1].replace("''", "'")
        try:
            return json.loads(m[1])
        except ValueError:
            return m[1][1:-1]
    text = re.sub(r"(?:^|\s)#.*$", "", text).strip()
    if text in _PLAIN:
        return _PLAIN[text]
    if re.fullmatch(r"[-+]?(?:0|[1-9]\d*)", text):
        return int(text)
    return float(text) if re.fullmatch(r"[-+]?\d+\.\d+(?:[eE][-+]?\d+)?", text) else text


def _flow(text: str, at: int = 0):
    """A list or map in brackets from `at`, and the place behind it."""
    close, out, keyed = {"[": ("]", []), "{": ("}", {})}[text[at]] + (text[at] == "{",)
    at += 1
    key, part = None, ""
    value = lambda part: _scalar(part) if isinstance(part, str) else part

    def take() -> None:
        if keyed and (key is not None or part != "" and value(part) is not None):
            out[str(value(part) if key is None else key)] = None if key is None else value(part)
        elif not keyed and not (isinstance(part, str) and not part.strip()):
            out.append(value(part))

    while at < len(text):
        c = text[at]
        if c in "[{" and isinstance(part, str) and not part.strip():
            part, at = _flow(text, at)
            continue
        if c in "\"'" and isinstance(part, str) and not part.strip():
            m = re.compile(r'"(?:[^"\\]|\\.)*"' if c == '"' else r"'(?:[^']|'')*'").match(text, at)
            if not m:
                raise ValueError("a quote isn't closed")
            part, at = m[0], m.end()
            continue
        if c in (",", close):
            take()
            key, part = None, ""
            if c == close:
                return out, at + 1
        elif c == ":" and keyed and key is None and (at + 1 == len(text) or text[at + 1] in " \n" or str(part)[:1] in "\"'"):
            key, part = _scalar(part), ""
        else:
            part = part + c if isinstance(part, str) else part
        at += 1
    raise ValueError("a bracket isn't closed")


def parse(text: str):
    """The value of a document; ValueError where its indentation or brackets don't fit."""
    lines = text.replace("\r\n", "\n").split("\n")
    at = 0

    def indent(line: str) -> int:
        return len(line) - len(line.lstrip(" "))

    def skip() -> None:
        nonlocal at
        while at < len(lines) and (not lines[at].strip() or lines[at].lstrip().startswith("#")):
            at += 1

    def block(style: str, chomp: str, above: int) -> str:
        nonlocal at
        taken = []
        while at < len(lines) and (not lines[at].strip() or indent(lines[at]) > above):
            taken.append(lines[at])
            at += 1
        depth = min((indent(x) for x in taken if x.strip()), default=0)
        body = [x[depth:] if x.strip() else "" for x in taken]
        end = len(body)
        while end and not body[end - 1]:
            end -= 1
        tail = "\n" * (len(body) - end) if chomp == "+" else ""
        body = body[:end]
        if style == "|":
            out = "\n".join(body)
        else:  # neighbours of one depth are one line
            out = ""
            for i, x in enumerate(body):
                if i and x and body[i - 1] and not x.startswith(" ") and not body[i - 1].startswith(" "):
                    out += " "
                elif i and (not x or body[i - 1] or x.startswith(" ")):
                    out += "\n"
                out += x
        return out + ("" if chomp == "-" or not body else "\n") + tail

    def inline(rest: str, above: int):
        """What stands behind a key or a dash, and what goes on below it."""
        nonlocal at
        if m := _BLOCK.match(rest):
            return block(m[1], m[2], above)
        if rest[:1] in ("[", "{"):
            while True:
                try:
                    value, end = _flow(rest)
                    if rest[end:].strip() and not rest[end:].lstrip().startswith("#"):
                        raise TypeError
                    return value
                except ValueError:
                    if at == len(lines):
                        raise
                    rest += "\n" + lines[at]
                    at += 1
        if not rest or rest.startswith("#"):
            skip()
            if at < len(lines) and (indent(lines[at]) > above or indent(lines[at]) == above and re.match(r"\s*-(\s|$)", lines[at])):
                return node(indent(lines[at]))
            return None
        while rest[0] not in "\"'" and at < len(lines) and lines[at].strip() and indent(lines[at]) > above:  # a plain scalar over several lines
            if _KEY.match(lines[at].lstrip(" ")):
                raise ValueError(f"line {at + 1} doesn't fit")
            rest += " " + lines[at].strip()
            at += 1
        return _scalar(rest)

    def node(depth: int):
        nonlocal at
        if re.match(r"\s*-(\s|$)", lines[at]):
            out = []
            while at < len(lines) and indent(lines[at]) == depth and (m := re.match(r"\s*-(?:\s+|$)", lines[at])):
                rest = lines[at][m.end() :]
                if _KEY.match(rest):  # a map begins behind the dash
                    lines[at] = " " * m.end() + rest
                    out.append(node(m.end()))
                else:
                    at += 1
                    out.append(inline(rest.strip(), depth))
                skip()
            return out
        out = {}
        while at < len(lines) and indent(lines[at]) == depth and (m := _KEY.match(lines[at].lstrip(" "))):
            rest = lines[at].lstrip(" ")[m.end() :].strip()
            at += 1
            value = inline(rest, depth)
            out.setdefault(str(_scalar(m[1])), value)  # the first of repeated keys counts
            skip()
        if not out:
            rest, at = lines[at].strip(), at + 1
            return inline(rest, depth - 1)
        return out

    skip()
    if at == len(lines):
        return None
    out = node(indent(lines[at]))
    skip()
    if at < len(lines):
        raise ValueError(f"line {at + 1} doesn't fit")
    return out


def _json(batches):
    import pyarrow as pa

    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            try:
                out.append(None if text is None else json.dumps(parse(text), ensure_ascii=False))
            except (ValueError, TypeError, IndexError, RecursionError):
                out.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["__row", "json"])


def with_json(rows: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """rows with a column of JSON made of YAML; null for null texts and those that can't be read, `null` for empty ones."""
    ship(rows.sparkSession)
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"), F.col(text_col).cast("string").alias("__text"))
    done = packed.mapInArrow(_json, packed.select("__row", F.lit(None).cast("string").alias("json")).schema)
    return done.select("__row.*", F.col("json").alias(out_col))


def front_matter(text: Column) -> Column:
    """What stands between the two lines of dashes at a text's start; null without them."""
    return F.nullif(F.regexp_extract(text, r"(?s)\A---[ \t]*\r?\n(.*?\n)?---[ \t]*(?:\r?\n|\z)", 1), F.lit(""))

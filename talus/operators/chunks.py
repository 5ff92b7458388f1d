"""Functions of source files: where they begin and end, at any depth, with names that hold those around them.

One pattern cuts a source into tokens, so that strings, comments, regular expressions, templates and here-documents are one token each;
a fold over the tokens keeps a stack of open braces and the head of the statement before each brace. Python has blocks by
indentation: there the fold goes over lines. All of it is expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<symbol:string,kind:string,first:int,last:int>>"


def _quoted(q: str, inside: str = "") -> str:
    return rf"{q}[^{q}\\{inside}]*+(?:\\[\s\S][^{q}\\{inside}]*+)*+{q}"


_STRINGS = "|".join([_quoted("`"), _quoted('"', r"\n"), _quoted("'", r"\n")])
_REGEX = r"(?<=[(,=:\[!&|?{};]\s{0,8}|\breturn\s{1,8})/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/\w*"
_REST = r"\n|[^\S\n]++|[\w$#.]++|=>|[\s\S]"
#: Tokens; comments come first, with those that begin the next lines, then what quotes.
BRACES = rf"//[^\n]*+(?:\n\s*+//[^\n]*+)*+|/\*(?s:.*?)\*/|{_STRINGS}|{_REGEX}|{_REST}"
SHELL = rf"(?<![\w$&{{])\#[^\n]*+(?:\n\s*+\#[^\n]*+)*+|<<-?\s*+['\"]?(\w++)['\"]?[^\n]*+\n(?s:.*?)\n\s*+\1(?=\n|\z)|\$\{{[^}}\n]*+\}}|'[^']*+'|{_quoted('\"')}|\\[\s\S]|{_REST}"

_ARGS = r"\((?:[^()]|\((?:[^()]|\([^()]*+\))*+\))*+\)"
_TYPE = r"\s*(?::[^;{}=]*)?"
_MAKER = rf"(?:async\s*)?(?:function\b\s*\*?\s*[\w$]*\s*{_ARGS}|{_ARGS}{_TYPE}=>|[\w$]+\s*=>)\s*$"
#: What the text before a brace names, and whether that is a method; the first that matches counts.
HEADS = {
    "braces": (
        (rf"(?:^|[^\w$.])([\w$.]+)\s*(?::[^=(){{}}]*)?(?<![=!<>])=\s*{_MAKER}", False),
        (rf"(?:^|[^\w$.?])[\"']?([\w$-]+)[\"']?\s*:\s*{_MAKER}", False),
        (rf"\bfunction\b\s*\*?\s*([\w$]+)\s*(?:<[^<>]*>)?{_ARGS}{_TYPE}$", False),
        (rf"^\s*,?\s*(?:(?:static|async|get|set|public|private|protected|override|readonly)\s+)*\*?\s*(?!(?:if|for|while|switch|catch|with|function|return|else|do|new|await|typeof)\b)([\w$#]+)\s*(?:<[^<>]*>)?{_ARGS}{_TYPE}$", True),
    ),
    "shell": ((r"(?:^|\s)function\s+([\w:.-]+)\s*(?:\(\s*\))?\s*$", False), (r"(?:^|\s)([\w:.-]+)\s*\(\s*\)\s*$", False)),
}


def brace_spans(source: Column, lang: str = "braces", kind: Column | str = "function") -> Column:
    """array<struct<symbol, kind, first, last>> of the named functions, inner ones first; lines count from 1.

    A function without a name is no row, and lends no name to those within. Its first line is that of the statement that holds
    its head. Functions that have no braces, and those within templates, aren't seen. What is never closed is no function."""
    tokens = F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(SHELL if lang == "shell" else BRACES), F.lit(0))
    one = lambda name, method, first, paren: F.struct(name.cast("string").alias("name"), method.cast("boolean").alias("method"), first.cast("int").alias("first"), paren.cast("int").alias("paren"))

    def named(head: Column) -> tuple[Column, Column]:
        hits = [(F.nullif(F.regexp_extract(head, p, 1), F.lit("")), m) for p, m in HEADS[lang]]
        name = F.coalesce(*[h for h, _ in hits])
        return name, reduce(lambda rest, hm: F.when(hm[0].isNotNull(), F.lit(hm[1])).otherwise(rest), reversed(hits), F.lit(False))

    def step(s: Column, t: Column) -> Column:
        comment = t.startswith("//") | t.startswith("/*") if lang == "braces" else t.startswith("#")
        blank = comment | t.rlike(r"^\s+$")
        breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
        opens, closes, ends = t == "{", t == "}", t == ";"
        # A statement ends at a line's end unless parentheses are open or it can't end there; a brace on a line of its own still has its head.
        over = s["fresh"] & ~blank & ~opens & (s["paren"] <= 0) & ~s["head"].rlike(r"[=,:?&|+(\[<>-]\s*$")
        head = F.when(over, F.lit("")).otherwise(s["head"])
        first = F.when(head.rlike(r"^[\s,]*$"), s["line"]).otherwise(s["first"])
        name, method = named(head)
        named_here = F.when(opens, name)
        top = F.element_at(s["open"], -1)
        close = closes & (F.size(s["open"]) > 0)
        path = F.array_join(F.transform(F.filter(s["open"], lambda x: x["name"].isNotNull()), lambda x: x["name"]), ".")
        row = F.struct(path.alias("symbol"), F.when(top["method"], "method").otherwise(kind).alias("kind"), top["first"].alias("first"), s["line"].alias("last"))
        stack = F.when(opens, F.concat(s["open"], F.array(one(named_here, method, first, s["paren"])))).when(close, F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))).otherwise(s["open"])
        piece = F.when(comment, " ").when(t.rlike("^[`\"']") & ~t.rlike(r"^[\"'][\w$-]+[\"']$"), F.lit('""')).otherwise(t)
        paren = F.when(opens, F.lit(0)).when(close, top["paren"]).otherwise(s["paren"] + F.when(t.isin("(", "["), 1).when(t.isin(")", "]"), -1).otherwise(0))
        return F.struct(
            (s["line"] + breaks).cast("int").alias("line"),
            paren.cast("int").alias("paren"),
            F.when(opens | closes | ends & (s["paren"] <= 0), F.lit("")).otherwise(F.concat(head, piece)).alias("head"),
            first.cast("int").alias("first"),
            F.when(blank, s["fresh"] | (breaks > 0)).otherwise(F.lit(False)).alias("fresh"),
            stack.alias("open"),
            F.when(close & top["name"].isNotNull(), F.concat(s["out"], F.array(row))).otherwise(s["out"]).alias("out"),
        )

    start = F.struct(F.lit(1).alias("line"), F.lit(0).alias("paren"), F.lit("").alias("head"), F.lit(1).alias("first"), F.lit(False).alias("fresh"), F.array().cast("array<struct<name:string,method:boolean,first:int,paren:int>>").alias("open"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(tokens, start, step, lambda s: s["out"])


_PY_STRING = r"(?:[rRbBuUfF]{0,2})(?:\"\"\"[^\"\\]*+(?:(?:\\[\s\S]|\"(?!\"\"))[^\"\\]*+)*+\"\"\"|'''[^'\\]*+(?:(?:\\[\s\S]|'(?!''))[^'\\]*+)*+'''|" + _quoted('"', r"\n") + "|" + _quoted("'", r"\n") + ")"
PYTHON = rf"\#[^\n]*+|{_PY_STRING}|\\\n|\n|[^\S\n]++|\w++|[\s\S]"
#: Begins a line that a backslash goes on with, and what is left behind a string of several lines: once for each line but its first.
_ON = "\x01"


def python_spans(source: Column) -> Column:
    """Spans of functions, and of the heads of classes with their docstring, inner ones first; a function within another or a class is a method.

    A block ends with the last line that isn't blank before one of its own depth or less; lines within brackets and strings have
    no depth. A class's head reaches to its docstring's end, or to the first line of its body."""
    tokens = F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(PYTHON), F.lit(0))
    quoted = r"(?s)^[rRbBuUfF]{0,2}[\"'].+"
    ons = lambda n: F.when(n > 0, F.concat(F.lit("\n"), F.repeat(F.lit(_ON), n))).otherwise("")
    plain = F.transform(tokens, lambda t: F.when(t.startswith("#"), "").when(t == "\\\n", F.lit(f"\n{_ON}")).when(t == _ON, "?").when(t.rlike(quoted), F.concat(F.lit('"'), ons(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))), F.lit('"'))).otherwise(t))
    lines = F.split(F.array_join(plain, ""), "\n", -1)

    def step(s: Column, text: Column) -> Column:
        # The lines of a string are one step: only the last one's number counts.
        no = s["no"] + F.greatest(F.lit(1), F.length(F.regexp_extract(text, rf"^{_ON}*", 0)))
        going = (s["depth"] > 0) | text.startswith(_ON)
        blank = F.trim(text) == ""
        begins = ~going & ~blank
        indent = F.length(F.regexp_extract(text, r"^(\s*)", 1))
        kept = F.filter(s["open"], lambda x: x["indent"] < indent)
        done = F.filter(s["open"], lambda x: x["indent"] >= indent)
        name = F.nullif(F.regexp_extract(text, r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)", 1), F.lit(""))
        row = F.struct(indent.alias("indent"), F.concat_ws(".", F.transform(kept, lambda x: x["name"]), name).alias("symbol"), name.alias("name"), text.rlike(r"^\s*class\b").alias("is_class"), no.alias("first"), F.lit(0).alias("body"), F.lit(False).alias("doc"), (F.size(kept) > 0).alias("within"))
        # The first line of a class's body; further lines of a docstring there move the end of its head on.
        top = F.element_at(kept, -1)
        enters = begins & (F.size(kept) > 0) & (top["body"] == 0)
        more = text.startswith(_ON) & (F.size(s["open"]) > 0) & F.element_at(s["open"], -1)["doc"] & (F.element_at(s["open"], -1)["body"] == s["last"])
        set_top = lambda stack, body, doc: F.transform(stack, lambda x, i: F.when(i == F.size(stack) - 1, F.struct(x["indent"].alias("indent"), x["symbol"].alias("symbol"), x["name"].alias("name"), x["is_class"].alias("is_class"), x["first"].alias("first"), body.alias("body"), doc.alias("doc"), x["within"].alias("within"))).otherwise(x))
        entered = F.when(enters, set_top(kept, no, text.rlike(r'^\s*"'))).otherwise(kept)
        stack = F.when(begins, F.when(name.isNotNull(), F.concat(entered, F.array(row))).otherwise(entered)).when(more, set_top(s["open"], no, F.lit(True))).otherwise(s["open"])
        out = F.when(begins & (F.size(done) > 0), F.concat(s["out"], F.reverse(F.transform(done, lambda x: closed(x, s["last"]))))).otherwise(s["out"])
        depth = s["depth"] + F.length(F.regexp_replace(text, r"[^(\[{]", "")) - F.length(F.regexp_replace(text, r"[^)\]}]", ""))
        return F.struct(no.cast("int").alias("no"), F.greatest(depth, F.lit(0)).cast("int").alias("depth"), F.when(blank & ~going, s["last"]).otherwise(no).cast("int").alias("last"), stack.alias("open"), out.alias("out"))

    def closed(x: Column, last: Column) -> Column:
        end = F.when(x["is_class"], F.when(x["body"] > 0, x["body"]).otherwise(x["first"])).otherwise(last)
        kind = F.when(x["is_class"], "class").when(x["within"], "method").otherwise("function")
        return F.struct(x["symbol"].alias("symbol"), kind.alias("kind"), x["first"].cast("int").alias("first"), end.cast("int").alias("last"))

    zero = F.lit(0)
    kind = "array<struct<indent:int,symbol:string,name:string,is_class:boolean,first:int,body:int,doc:boolean,within:boolean>>"
    start = F.struct(zero.alias("no"), zero.alias("depth"), zero.alias("last"), F.array().cast(kind).alias("open"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(lines, start, step, lambda s: F.concat(s["out"], F.reverse(F.transform(s["open"], lambda x: closed(x, s["last"])))))


def scripts(html: Column) -> Column:
    """array<struct<js, above>>: the scripts of a page, and how many lines stand above each one's first."""
    pieces = F.split(F.coalesce(html, F.lit("")), r"(?i)(?=<script\b)|(?<=</script>)", -1)
    opening = r"(?i)^<script\b[^>]*>"
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))

    def step(s: Column, x: Column) -> Column:
        one = F.struct(F.regexp_replace(F.regexp_replace(x, opening, ""), r"(?i)</script>$", "").alias("js"), (s["above"] + breaks(F.regexp_extract(x, opening, 0))).cast("int").alias("above"))
        return F.struct((s["above"] + breaks(x)).cast("int").alias("above"), F.when(x.rlike(opening) & x.rlike(r"(?i)</script>$"), F.concat(s["out"], F.array(one))).otherwise(s["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("above"), F.array().cast("array<struct<js:string,above:int>>").alias("out"))
    return F.aggregate(pieces, start, step, lambda s: s["out"])


def functions(files: DataFrame) -> DataFrame:
    """(path, symbol, kind, start_line, end_line, content) of the functions in files of (path, content), whatever their length.

    By extension: py; js, mjs, cjs, ts; sh, bash; and the scripts of html, whose functions are script_fn. Other files, empty and null ones
    have none. content is the lines of the function, or of a class's head."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    f = files.select("path", F.regexp_replace("content", r"\r\n?", "\n").alias("content"), ext.alias("__ext")).where(F.col("__ext").isin("py", "js", "mjs", "cjs", "ts", "sh", "bash", "html"))
    # One pass over the files, each by the fold of its own kind.
    whole = F.array(F.struct(F.col("content").alias("js"), F.lit(0).alias("above")))
    code = f.select("path", "__ext", F.explode(F.when(F.col("__ext") == "html", scripts(F.col("content"))).otherwise(whole)).alias("x")).select("path", "__ext", F.col("x.above").alias("above"), F.col("x.js").alias("code"))
    kind = F.when(F.col("__ext") == "html", "script_fn").otherwise("function")
    spans = F.when(F.col("__ext") == "py", python_spans(F.col("code"))).when(F.col("__ext").isin("sh", "bash"), brace_spans(F.col("code"), "shell")).otherwise(brace_spans(F.col("code"), kind=kind))
    found = code.select("path", "above", "code", F.explode(spans).alias("s"))
    lines = F.slice(F.split("code", "\n", -1), F.col("s.first"), F.col("s.last") - F.col("s.first") + 1)
    return found.select("path", F.col("s.symbol").alias("symbol"), F.col("s.kind").alias("kind"), (F.col("above") + F.col("s.first")).alias("start_line"), (F.col("above") + F.col("s.last")).alias("end_line"), F.array_join(lines, "\n").alias("content"))


def chunks(files: DataFrame, min_lines: int = 4, most: int = 6000) -> DataFrame:
    """Functions of min_lines lines or more, and heads of classes, cut to `most` characters, with the hash of what is left."""
    f = functions(files).where((F.col("kind") == "class") | (F.col("end_line") - F.col("start_line") + 1 >= min_lines))
    return f.withColumn("truncated", F.length("content") > most).withColumn("content", F.substring("content", 1, most)).withColumn("content_sha", F.sha2(F.col("content").cast("binary"), 256))


def symbol_bodies(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, wanted, content): the body of the first function of a file whose last name is that of the wanted symbol; null where there is none.

    wanted: path, wanted (a symbol). A whole symbol that is the same goes before others of the same last name."""
    leaf = lambda c: F.element_at(F.split(c, r"\."), -1)
    found = functions(files).where("kind <> 'class'").withColumn("leaf", leaf(F.col("symbol")))
    pairs = wanted.join(found, "path", "left").where(F.col("symbol").isNull() | (F.col("leaf") == leaf(F.col("wanted"))))
    best = pairs.groupBy("path", "wanted").agg(F.min_by("content", F.struct(F.col("symbol") != F.col("wanted"), "start_line", "symbol")).alias("content"))
    return wanted.select("path", "wanted").distinct().join(best, ["path", "wanted"], "left")

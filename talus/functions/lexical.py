"""Lexical search on columns: tokens, boolean queries, ranks and trigrams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores, in order, without stemming or stop words."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def query_tokens(query: str) -> list[str]:
    return [w for w in re.findall(r"\w+", query.lower()) if w]


def matches_all(text: Column | str, query: str) -> Column:
    """Every token of the query occurs; a query without tokens matches nothing."""
    wanted = list(dict.fromkeys(query_tokens(query)))
    if not wanted:
        return F.lit(False)
    return reduce(lambda a, b: a & b, [has_token(text, w) for w in wanted])


def has_token(text: Column | str, word: str) -> Column:
    """Whether a token equals the word: a substring first, which is cheap, and only then its bounds."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.coalesce(low.contains(word) & low.rlike(rf"(?<![\p{{L}}\p{{N}}_]){re.escape(word)}(?![\p{{L}}\p{{N}}_])"), F.lit(False))


def word_regex(query: str) -> str:
    """Any of the query's words, case-insensitively and literally."""
    words = [re.sub(r"([^\w\s])", r"\\\1", w) for w in query.split()] or [re.sub(r"([^\w\s])", r"\\\1", query)]
    return "(?i)" + "|".join(words)


def matches_any_word(text: Column | str, query: str) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return col.rlike(word_regex(query))


def websearch(text: Column | str, query: str) -> Column:
    """Quoted phrases, `or`, and `-` negation; other terms must all occur."""
    toks = tokens(text)
    groups: list[list[Column]] = [[]]
    for neg, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if not neg and word.lower() == "or":
            groups.append([])
            continue
        parts = query_tokens(phrase or word)
        if not parts:
            continue
        if len(parts) == 1:
            hit = has_token(text, parts[0])
        else:  # adjacent tokens: a phrase over the token stream
            hit = F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" ")).contains(f" {' '.join(parts)} ")
        groups[-1].append(~hit if neg else hit)
    groups = [g for g in groups if g]
    if not groups:
        return F.lit(False)
    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, g) for g in groups))


#: The weight of an unlabelled word, the sum of 1 / n**2, and the numbers of the distance weight, as PostgreSQL documents them.
WEIGHT, SQUARES = 0.1, 1.64493406685
DISTANCE = (1.005, 0.05, 1.5, 2.0)
FAR, FAINT = 100, 1e-20
#: Ranks are rounded to so many places, so that equal ones tie in whatever order they were added up.
PLACES = 9


def _places(text: Column | str, words: list[str]) -> Column:
    """array<struct<pos, word>>: where the words occur, in order; word counts from 1."""
    wanted = F.array(*map(F.lit, words))
    every = F.transform(tokens(text), lambda x, i: F.struct((i + 1).alias("pos"), F.array_position(wanted, x).cast("int").alias("word")))
    return F.filter(every, lambda o: o["word"] > 0)


def rank_cover(text: Column | str, query: str) -> Column:
    """Cover density of a query all of whose words must occur: the sum over minimal covers of weight / (1 + other words within).

    A cover is an extent that holds all words and no smaller one that does. One sweep over the places keeps the last place of each
    word; the least of those begins the cover that ends here, if no cover began there before. 0 for null texts, for texts that lack a
    word and for queries without words. Every occurrence counts, wherever it stands."""
    words = list(dict.fromkeys(query_tokens(query)))
    if not words:
        return F.lit(0.0)
    place = lambda n, pos: F.struct(n.cast("int").alias("n"), pos.cast("int").alias("pos"))

    def step(acc: Column, o: Column) -> Column:
        n = acc["n"] + 1
        last = F.transform(acc["last"], lambda x, i: F.when(i == o["word"] - 1, place(n, o["pos"])).otherwise(x))
        low = F.array_min(last)
        new = low["n"] > acc["begin"]
        others = o["pos"] - low["pos"] - (n - low["n"])
        return F.struct(n.alias("n"), F.when(new, low["n"]).otherwise(acc["begin"]).alias("begin"), last.alias("last"), F.when(new, acc["sum"] + F.lit(WEIGHT) / (1 + others)).otherwise(acc["sum"]).alias("sum"))

    zero = F.lit(0)
    start = F.struct(zero.alias("n"), zero.alias("begin"), F.array(*[place(zero, zero)] * len(words)).alias("last"), F.lit(0.0).alias("sum"))
    return F.round(F.aggregate(_places(text, words), start, step, lambda a: a["sum"]), PLACES)


def rank_pairs(text: Column | str, words: list[str]) -> Column:
    """1 - product over pairs of places of two different words of 1 - weight of their distance; without such a pair the least rank.

    Beyond FAR words the weight is below what a double can tell, so a sweep needs the places of the last FAR words alone."""
    a, b, c, d = DISTANCE
    near = lambda r, o: o["pos"] - r["pos"] <= FAR

    def step(acc: Column, o: Column) -> Column:
        def less(x: Column, r: Column) -> Column:
            distance = (o["pos"] - r["pos"]).cast("double")
            return x * (1 - WEIGHT * F.sqrt(1 / (a + b * F.exp(distance / c - d))))

        others = F.filter(acc["recent"], lambda r: near(r, o) & (r["word"] != o["word"]))
        rest = F.aggregate(others, acc["rest"], less)
        return F.struct(F.concat(F.filter(acc["recent"], lambda r: near(r, o)), F.array(o)).alias("recent"), rest.alias("rest"))

    start = F.struct(F.array().cast("array<struct<pos:int,word:int>>").alias("recent"), F.lit(1.0).alias("rest"))
    rank = F.aggregate(_places(text, words), start, step, lambda x: 1 - x["rest"])
    return F.greatest(F.round(rank, PLACES), F.lit(FAINT))


def rank_words(text: Column | str, words: list[str]) -> Column:
    """Mean over the words of weight * (1 + 1/4 + ... + 1/n**2), n how often the word occurs, over the limit of that sum."""
    places = _places(text, words)

    def one(k: int) -> Column:
        n = F.size(F.filter(places, lambda o: o["word"] == k))
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda x, i: x + WEIGHT / (i * i).cast("double"))).otherwise(0.0)

    return F.round(reduce(lambda x, y: x + y, map(one, range(1, len(words) + 1))) / (SQUARES * len(words)), PLACES)


def rank_text(text: Column | str, query: str) -> Column:
    """The rank of a query as `websearch` reads it: by pairs if all its parts must hold and it has two words or more, else by words.

    Words under a negation are words of the query too. 0 for a query without words."""
    words = list(dict.fromkeys(query_tokens(re.sub(r"(?i)(?<!\S)or(?!\S)", " ", query))))
    if not words:
        return F.lit(0.0)
    either = any(w.lower() == "or" for _, _, w in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query))
    return rank_words(text, words) if either or len(words) < 2 else rank_pairs(text, words)


def trigrams(text: Column | str) -> Column:
    """Distinct trigrams of each word, padded with two blanks before and one behind."""
    words = F.array_distinct(tokens(text))
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column | str, query: str) -> Column:
    """Trigrams that text and query share, over those of either; 0 where neither has any.

    Words come from `tokens`, each once a text, with three blanks between them: every window of three code points is a trigram but
    those that two blanks end. Windows are numbers, counted in a task; trigrams of a whole text never become a column."""
    key = lambda c: c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    padded = [f"  {w} " for w in query_tokens(query)]
    wanted = np.unique(np.array([key(np.array([ord(c) for c in g], dtype=np.int64))[0] for w in padded for g in (w[i : i + 3] for i in range(len(w) - 2))], dtype=np.int64))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for words in columns:
            out = []
            for line in words.to_pylist():
                c = np.frombuffer(f"  {line} ".encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
                grams = np.unique(key(c)[(c[1:-1] != 32) | (c[2:] != 32)])
                both = len(np.intersect1d(grams, wanted, assume_unique=True))
                every = len(grams) + len(wanted) - both
                out.append(both / every if every else 0.0)
            yield pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")(F.array_join(F.array_distinct(tokens(a)), "   "))


def word_similarity(text: Column | str, query: str) -> Column:
    """Greatest similarity of the query's trigrams to those of a continuous extent of the text's words; 0 for null texts.

    The best extent begins at the last place of a wanted trigram before its end. So one sweep keeps, for each wanted trigram, its last
    place with how many wanted and how many other trigrams came since; a trigram is new to an extent that began after the
    trigram's place before, which sorting the places by trigram tells."""
    wanted = list(dict.fromkeys(f"  {w} "[i : i + 3] for w in query_tokens(query) for i in range(len(w) + 1)))
    if not wanted:
        return F.lit(0.0)
    grams = F.flatten(F.transform(tokens(text), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))
    by_gram = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("gram"), (i + 1).alias("pos"))))
    shifted = F.concat(F.array(F.struct(F.lit("").alias("gram"), F.lit(0).alias("pos"))), by_gram)
    known = F.array(*map(F.lit, wanted))

    def placed(x: Column, before: Column) -> Column:
        return F.struct(x["pos"].alias("pos"), F.array_position(known, x["gram"]).cast("int").alias("word"), F.when(x["gram"] == before["gram"], before["pos"]).otherwise(0).alias("before"))

    places = F.array_sort(F.filter(F.zip_with(by_gram, shifted, placed), lambda x: x["pos"].isNotNull()))
    since = lambda at, hit, miss: F.struct(at.cast("int").alias("at"), hit.cast("int").alias("hit"), miss.cast("int").alias("miss"))

    def step(acc: Column, o: Column) -> Column:
        def moved(s: Column, k: Column) -> Column:
            seen = (s["at"] == 0) | (o["before"] >= s["at"])
            return F.when(o["word"] == k + 1, since(o["pos"], F.lit(1), F.lit(0))).when(seen, s).when(o["word"] > 0, since(s["at"], s["hit"] + 1, s["miss"])).otherwise(since(s["at"], s["hit"], s["miss"] + 1))

        starts = F.transform(acc["starts"], moved)
        best = F.array_max(F.transform(starts, lambda s: s["hit"].cast("double") / (len(wanted) + s["miss"])))
        return F.struct(starts.alias("starts"), F.when(o["word"] > 0, F.greatest(acc["best"], best)).otherwise(acc["best"]).alias("best"))

    zero = F.lit(0)
    start = F.struct(F.array(*[since(zero, zero, zero)] * len(wanted)).alias("starts"), F.lit(0.0).alias("best"))
    return F.aggregate(places, start, step, lambda a: a["best"])

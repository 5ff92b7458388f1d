import math
import random
import re

import pytest
from pyspark.sql import functions as F

from talus.functions import lexical


def places(text, words):
    return [(i, t) for i, t in enumerate(re.findall(r"\w+", (text or "").lower())) if t in words]


def cover_brute(text, words):
    """Every extent that holds all words and no smaller one that does."""
    at = places(text, words)
    holds = lambda i, j: {w for _, w in at[i:j]} == set(words)
    spans = [(i, j) for i in range(len(at)) for j in range(i + 1, len(at) + 1) if holds(i, j) and not holds(i + 1, j) and not holds(i, j - 1)]
    return sum(0.1 / (1 + at[j - 1][0] - at[i][0] - (j - i - 1)) for i, j in spans)


def pairs_brute(text, words):
    rest = 1.0
    at = places(text, words)
    for i, (p, v) in enumerate(at):
        for q, w in at[i + 1 :]:
            if v != w:
                near = 1 / (1.005 + 0.05 * math.exp((q - p) / 1.5 - 2)) if q - p <= 100 else 1e-30
                rest *= 1 - math.sqrt(0.01 * near)
    return max(1 - rest, 1e-20)


@pytest.mark.parametrize("words", [["a"], ["a", "b"], ["a", "b", "c"]])
def test_ranks_equal_brute_force(spark, words):
    r = random.Random(len(words))
    texts = [" ".join(r.choices(["a", "b", "c", "A,", "x", "y"], k=r.randrange(25))) for _ in range(150)] + [None, "", "a " + "x " * 150 + "b c", "b a " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", lexical.rank_cover("t", " ".join(words)).alias("cover"), lexical.rank_text("t", " ".join(words)).alias("text"))
    for row, text in zip(df.orderBy("i").collect(), texts, strict=True):
        assert row.cover == pytest.approx(cover_brute(text, words), abs=1e-8)
        if len(words) > 1:
            assert row.text == pytest.approx(pairs_brute(text, words), abs=1e-8)
        else:
            assert row.text == pytest.approx(sum(0.1 / k**2 for k in range(1, len(places(text, words)) + 1)) / 1.64493406685, abs=1e-8)


def test_ranks_of_odd_queries(spark):
    df = spark.createDataFrame([("a b a",)], "t string")
    got = df.select(lexical.rank_cover("t", "").alias("x"), lexical.rank_text("t", " ... ").alias("y"), lexical.rank_text("t", "a or z").alias("z"), lexical.rank_cover("t", "a z").alias("w"), lexical.rank_text("t", "a a").alias("v")).first()
    assert (got.x, got.y, got.w) == (0.0, 0.0, 0.0)
    assert got.z == pytest.approx(0.1 * 1.25 / 1.64493406685 / 2, abs=1e-8) and got.v == pytest.approx(0.1 * 1.25 / 1.64493406685, abs=1e-8)


def test_word_similarity_is_the_best_extent(spark):
    r = random.Random(4)
    grams = lambda s: [g for w in lexical.query_tokens(s) for g in (f"  {w} "[i : i + 3] for i in range(len(w) + 1))]
    texts = [" ".join("".join(r.choices("abc", k=r.randrange(1, 5))) for _ in range(r.randrange(9))) for _ in range(80)] + [None]
    q = set(grams("abc cab"))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", lexical.word_similarity(F.col("t"), "abc cab").alias("s")).orderBy("i").collect()
    for row, text in zip(rows, texts, strict=True):
        t = grams(text or "")
        assert row.s == pytest.approx(max((len(q & set(t[i:j])) / len(q | set(t[i:j])) for i in range(len(t)) for j in range(i + 1, len(t) + 1)), default=0.0))


def test_trigram_similarity_is_that_of_sets(spark):
    grams = lambda s: {f"  {w} "[i : i + 3] for w in re.findall(r"\w+", s.lower()) for i in range(len(w) + 1)}
    texts = ["That with, THAT from", "", None, "... !", "é ÉCOLE a_b 12 𝒳𝒳 日本", "from wither thatch " * 50, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", lexical.trigram_similarity("t", "that with from").alias("s"), lexical.trigram_similarity(F.col("t"), " ? ").alias("none")).orderBy("i")
    q = grams("that with from")
    assert [(r.s, r.none) for r in got.collect()] == [(len(q & grams(t or "")) / len(q | grams(t or "")), 0.0) for t in texts]
    # The trigrams of a text aren't a column, which would be made of each once more for every use.
    assert "transform(" not in got._jdf.queryExecution().optimizedPlan().toString()

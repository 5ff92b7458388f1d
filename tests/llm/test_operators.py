"""Each operator on small tables with nulls, empties, long texts, ties, repeats and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.llm import decontam, embeddings, html, langid, licenses, lines, minmax, mixing, queries, tokenout, toxicity
from talus.llm.common import components, shingles_of

from ..conftest import oracle_rows, same_rows

DOCS = "doc_id long, text string, lang string, source string, size long, kept boolean, component_id long, score double"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns clash with those of results."""
    return spark.createDataFrame([(*r, 7, False, -1, 0.5) for r in rows], DOCS)


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(n))


LONG = words(60_000, 9)
EDGE = [(1, None, "en", None), (2, "", None, "a"), (3, "  \t\n ", "en", "a"), (4, "one", "en", "b"), (None, words(30, 3), "en", "b"), (5, LONG, "de", "c"), (6, words(40, 1), "en", "a"), (6, words(40, 1), "en", "a"), (7, words(40, 1).upper(), "en", None)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf, name):
    same_rows(queries.QUERIES[name](spark, sf), *oracle_rows(queries.ORACLE[name], sf))


# near duplicates


def brute_components(texts: dict, percent: int) -> dict:
    sets = {i: set(shingles_of((t or "").encode()).tolist()) for i, t in texts.items()}
    top = {i: i for i in texts}
    ids = sorted(texts)
    change = True
    while change:
        change = False
        for i in ids:
            for j in ids:
                if i < j and sets[i] and sets[j] and top[i] != top[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    low = min(top[i], top[j])
                    top = {k: low if v in (top[i], top[j]) else v for k, v in top.items()}
                    change = True
    return top


def edited(text: str, n: int, seed: int) -> str:
    r = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(spark, percent):
    base = [words(120, s) for s in range(4)]
    texts = {i: edited(base[i % 4], i % 9, i) for i in range(80)} | {100: "a b", 101: "A  b", 102: "b a", 103: None, 104: ""}
    got = {r.doc_id: r for r in minmax.near_duplicates(docs(spark, [(i, t, "en", "s") for i, t in texts.items()]), percent=percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(texts, percent)
    assert got[100].component_id == got[101].component_id == 100 and got[102].kept and got[103].n_shingles == 0


def test_near_duplicates_of_a_family_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(minmax, "BLOCK", 16)
    base = words(150, 5)
    texts = {i: edited(base, i % 14, i) for i in range(120)}
    got = {r.doc_id: r.component_id for r in minmax.near_duplicates(docs(spark, [(i, t, "en", "s") for i, t in texts.items()]), percent=85).collect()}
    assert got == brute_components(texts, 85)


def test_near_duplicates_of_templated_texts(spark, monkeypatch):
    """Texts that share half of their shingles are candidates in some bands, but no family and no link."""
    monkeypatch.setattr(minmax, "SIGNATURE_BLOCK", 16)
    frame = words(60, 6)
    texts = {i: f"{frame} {words(35, 700 + i)}" for i in range(200)}
    got = {r.doc_id: r.component_id for r in minmax.near_duplicates(docs(spark, [(i, t, "en", "s") for i, t in texts.items()]), percent=80).collect()}
    assert got == {i: i for i in texts}


def test_near_duplicates_of_ids_with_several_texts(spark):
    a, b, c = (words(50, 800 + i) for i in range(3))
    rows = [(1, a), (2, b), (5, a), (5, b), (5, None), (6, c), (7, c), (7, ""), (8, a), (None, a), (None, b)]
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in minmax.near_duplicates(docs(spark, [(i, t, "en", "s") for i, t in rows]), percent=80).collect())
    assert got == sorted([(1, 1, True), (2, 1, False), (5, 1, False), (5, 1, False), (5, 1, False), (6, 6, True), (7, 6, False), (7, 6, False), (8, 1, False), (0, None, True), (0, None, True)], key=lambda r: (r[0], r[1] or 0))


def test_signature_margin_keeps_links():
    """Pairs at the threshold agree in far more values than a family asks for."""
    r = np.random.default_rng(5)
    for percent in (80, 85):
        least = int(np.ceil(2 * minmax.PERMUTATIONS * (percent / 100 - minmax.MARGIN)))
        for size in (7, 12, 60, 400):
            pairs = []
            for _ in range(60):
                both = int(np.ceil(2 * size * percent / (100 + percent)))
                x = np.unique(r.integers(0, 2**63, 2 * size - both, dtype=np.uint64))
                pairs += [np.sort(x[:size]), np.sort(np.concatenate([x[:both], x[size:]]))]
            short = minmax.short_signatures(minmax.signatures(pairs))
            assert ((short[::2] == short[1::2]).sum(axis=1) >= least).all()


def test_near_duplicates_edge_rows(spark):
    out = minmax.near_duplicates(docs(spark, EDGE), percent=80).collect()
    assert len(out) == len(EDGE)
    by = {r.doc_id: r for r in out}
    assert by[None].kept and by[None].component_id is None and by[1].kept and by[3].n_shingles == 0 and by[7].component_id == 6
    assert minmax.near_duplicates(docs(spark, []), percent=80).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50) if i % 10 != 9] + [(5, 5), (None, 3), (60, 3)], "a long, b long")
    got = {r.node: r.component for r in components(e)[0].distinct().collect()}
    assert got[9] == 0 and got[19] == 10 and got[60] == 0 and len(got) == 51


# lines


def brute_lines(rows, min_docs, first=False):
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(low)
    held: dict = {}
    for n, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, []).append(n)
    gone = {k for k, v in held.items() if len(v) >= min_docs and len(k) >= 1}
    return ["\n".join(x for x in (t or "").split("\n") if key(x) not in gone) for _, t in rows]


def test_lines_equal_brute_force(spark):
    r = random.Random(4)
    rows = [(i, "\n".join(r.choice([" Menu ", "menu", f"line {r.randrange(400)}", "", "É", "é", "\x1cmenu"]) for _ in range(r.randrange(9)))) for i in range(60)]
    rows += [(60, None), (61, "x" * 200_000 + "\nmenu"), (None, "MENU\nother")]
    out = lines.drop_repeated_lines(docs(spark, [(i, t, "en", "s") for i, t in rows]), min_docs=10)
    got = {r.doc_id: r for r in out.collect()}
    for (i, t), kept in zip(rows, brute_lines(rows, 10), strict=True):
        assert got[i].kept_text == kept and got[i].n_lines == len((t or "").split("\n"))
        assert got[i].n_dropped == got[i].n_lines - (len(kept.split("\n")) if kept or "" in (t or "").split("\n") or not t else 0)


def test_lines_without_room_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lines, "small_enough", lambda n, b: False)
    rows = [(i, f"same\nown {i}") for i in range(12)]
    assert {r.kept_text for r in lines.drop_repeated_lines(docs(spark, [(i, t, "en", "s") for i, t in rows]), min_docs=10).collect()} == {f"own {i}" for i in range(12)}


@pytest.mark.parametrize("small", [True, False])
def test_lines_keep_first(spark, monkeypatch, small):
    monkeypatch.setattr(lines, "small_enough", lambda n, b: small)
    rows = [(i, f"same\nown {i}\nSame") for i in range(3)]
    got = {r.doc_id: r.kept_text for r in lines.drop_repeated_lines(docs(spark, [(i, t, "en", "s") for i, t in rows]), min_docs=2, keep="first").collect()}
    assert got == {0: "same\nown 0", 1: "own 1", 2: "own 2"}


def test_full_filter_only_costs(spark, monkeypatch):
    monkeypatch.setattr(lines, "MAX_BITS", 8)
    monkeypatch.setattr(lines, "MIN_BITS", 8)
    rows = [(i, "\n".join(f"l{(i * 7 + k) % 97}" for k in range(20))) for i in range(50)]
    got = {r.doc_id: r.kept_text for r in lines.drop_repeated_lines(docs(spark, [(i, t, "en", "s") for i, t in rows]), min_docs=10).collect()}
    assert [got[i] for i, _ in rows] == brute_lines(rows, 10)


def test_lines_empty_table(spark):
    assert lines.drop_repeated_lines(docs(spark, [])).count() == 0


# mixing


def test_mix_bounds_and_targets(spark):
    rows = [(i, words(5 + i % 40, i), "en", None if i % 7 == 0 else f"s{i % 4}") for i in range(400)] + EDGE
    out = mixing.mix(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    total: dict = {}
    for r in out:
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        total.setdefault(r.source, [0, r.target, r.source_size])[0] += r.taken
    largest = max(r.size for r in out)
    for taken, target, size in total.values():
        assert abs(taken - target) <= largest and target <= 3 * size + 1e-6
    assert sum(t[1] for t in total.values()) == pytest.approx(sum(r.size for r in out))
    again = {(r.doc_id, r.hash, r.size, r.taken) for r in mixing.mix(docs(spark, rows[::-1])).collect()}
    assert again == {(r.doc_id, r.hash, r.size, r.taken) for r in out}
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mix_limits_small_sources(spark):
    rows = [(i, words(10, i), "en", "tiny") for i in range(3)] + [(i, words(10, i), "en", "big") for i in range(3, 100)]
    target = {r.source: r.target for r in mixing.mix(docs(spark, rows)).collect()}
    assert target["tiny"] == 90 and target["big"] == 910


# tokens


def test_tokens_round_trip(spark):
    import zlib

    from tokenizers import Tokenizer

    odd = "It's ΩΜΈΓΑΣ. éa, é́. <|endoftext|>. a<|startoftext|>b x\xa0y İ, İstanbul. don't, (a). x). 12.5% Å. ǅ. \x1cabc\x1f ÉCOLE, ẞ. ﬁ. ½. x². 's. #$ ..."
    rows = [*EDGE, (8, odd, "en", "a"), (-3, odd.replace(" ", "\n"), "en", "a")]
    got = tokenout.token_output(docs(spark, rows), queries.vocabulary_path()).orderBy("start").collect()
    t = Tokenizer.from_file(queries.vocabulary_path())
    start = 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(got) == len(rows)
    for g, (i, text, *_) in zip(got, order, strict=True):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokenout.token_output(docs(spark, []), queries.vocabulary_path()).count() == 0


def test_shard_names_sort_by_turn():
    names = [tokenout.shard_name(p, k) for p in (0, 3, 12, 1_000_000) for k in (0, 9, 10, 9_999, 10_000, 123_456_789)]
    assert names == sorted(names)


def test_tokens_of_another_vocabulary(spark):
    """A vocabulary that doesn't part words as expected is used on whole texts."""
    import zlib

    from tokenizers import Tokenizer

    path = queries.vocabulary_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["  two  spaces\n\nand lines.", "Hello, World!", ""]
    got = tokenout.token_output(docs(spark, [(i, x, "en", "s") for i, x in enumerate(texts)]), path).orderBy("doc_id").collect()
    for g, x in zip(got, texts, strict=True):
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [1], dtype="<u4")
        assert (g.n_tokens, g.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_tokens_of_many_shards(spark, monkeypatch):
    monkeypatch.setattr(tokenout, "SHARD_TOKENS", 200)
    rows = [(i, words(30, i), "en", "a") for i in range(60)]
    got = tokenout.token_output(docs(spark, rows), queries.vocabulary_path()).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(60))
    assert [r.start for r in got] == list(np.cumsum([0, *[r.n_tokens for r in got[:-1]]]))


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1 << 12])
def test_codec_round_trip(n):
    r = np.random.default_rng(n)
    v = (r.integers(0, 2**32, n) >> r.integers(0, 32, n)).astype(np.uint32)
    c, d = tokenout.encode_values(v)
    assert (tokenout.decode_values(np.frombuffer(c, np.uint8), np.frombuffer(d, np.uint8), n) == v).all()


# embeddings


def test_embeddings_equal_brute_force(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((6, 16))
    v = [base[i % 6] + r.standard_normal(16) * 0.25 for i in range(150)]
    rows = [(i, x.tolist(), 7) for i, x in enumerate(v)] + [(200, v[0].tolist(), 0), (201, v[0].tolist(), 0), (202, None, 0), (203, [0.0] * 16, 0), (204, [1.0, None], 0), (205, [float("nan")] * 16, 0), (206, [float("inf")] * 16, 0), (207, [], 0), (208, [1.0, 2.0], 0), (209, [1e200, 2e200], 0), (None, v[0].tolist(), 0)]
    got = {x.vec_id: x for x in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")).collect()}
    assert len(got) == len(rows)
    ids = [i for i, x, _ in rows if i is not None and i not in (202, 203, 204, 205, 206, 207)]
    unit = {i: np.array(x) / np.abs(x).max() for i, x, _ in rows if i in ids}
    unit = {i: x / np.linalg.norm(x) for i, x in unit.items()}
    link = {i: [j for j in ids if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9 - 1e-12] for i in ids}
    for i in ids:
        assert got[i].n_links == len(link[i])
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i].component_id == min(seen)
    assert got[202].n_links == 0 and got[203].kept and got[None].component_id is None
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_embeddings_over_many_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "PER_CELL", 20)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    r = np.random.default_rng(2)
    base = r.standard_normal((12, 24))
    v = np.array([base[i % 12] + r.standard_normal(24) * 0.2 for i in range(300)])
    u = v / np.linalg.norm(v, axis=1)[:, None]
    true = (u @ u.T >= 0.9).sum(axis=1) - 1
    got = embeddings.near_vectors(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).orderBy("vec_id").toPandas()
    assert (got.n_links.values <= true).all() and got.n_links.sum() >= 0.9 * true.sum()


def planted(n: int, dim: int, seed: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Random directions, every tenth with a partner at cosine 0.9 to 0.93."""
    r = np.random.default_rng(seed)
    v = r.standard_normal((n, dim))
    v /= np.linalg.norm(v, axis=1)[:, None]
    pairs = []
    for i in range(0, n - 1, 10):
        side = r.standard_normal(dim)
        side -= (side @ v[i]) * v[i]
        c = r.uniform(0.9001, 0.93)
        v[i + 1] = c * v[i] + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
        pairs.append((i, i + 1))
    return v, pairs


@pytest.mark.parametrize("dim", [32, 256])
def test_embedding_recall_at_many_cells(dim):
    """The cells of planted pairs at 1,024 cells: nearly all pairs share one in the usual mode, all of them in the exact one."""
    v, pairs = planted(60_000, dim, dim)
    centres = embeddings.fit_cells(v[np.random.default_rng(1).choice(len(v), 16_384, replace=False)], 1024)
    a, b = (v[[p[k] for p in pairs]] for k in (0, 1))
    usual = (embeddings.cells_of(a, centres, None) & embeddings.cells_of(b, centres, None)).any(axis=1)
    assert usual.mean() >= 0.97
    sine = np.sqrt(1 - 0.9**2)
    assert (embeddings.cells_of(a, centres, sine) & embeddings.cells_of(b, centres, sine)).any(axis=1).all()


def test_embeddings_exact_mode_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "PER_CELL", 10)
    v, pairs = planted(600, 24, 3)
    true = (v @ v.T >= 0.9).sum(axis=1) - 1
    got = embeddings.near_vectors(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), exact=True).orderBy("vec_id").toPandas()
    assert (got.n_links.values == true).all() and got.n_links.sum() >= 2 * len(pairs)


# languages


def test_language_id_learns_and_marks_unknown(spark):
    r = random.Random(3)
    say = lambda parts, n: " ".join("".join(r.choices(parts, k=3)) for _ in range(n))
    rows = [(i, say(["th", "er", "ing"], 30) if i % 2 else say(["eau", "qué", "oi"], 30), "en" if i % 2 else "fr", "s") for i in range(80)]
    rows += [(100, None, "en", "s"), (101, " 12 ... ", "fr", "s"), (102, "therering", None, "s"), (None, "thereringth", "en", "s"), (103, "THERING " * 40_000, "en", "s")]
    d = docs(spark, rows)
    model = langid.train(d, "text", "lang", "doc_id", F.col("doc_id") % 4 != 2)
    got = {x.doc_id: x for x in langid.identify(d, model, F.col("doc_id") % 4 == 2).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows[:80]) and got[102].lang_pred == "en" and got[103].lang_pred == "en" and got[None].lang_pred == "en" and not got[None].held_out
    assert got[100].lang_pred == got[101].lang_pred == "und" and all(0 <= x.score <= 1 for x in got.values())
    none = langid.identify(d, langid.train(d.where("lang is null"), "text", "lang", "doc_id", F.lit(True)), F.lit(False))
    assert {x.lang_pred for x in none.collect()} == {"und"} and langid.identify(docs(spark, []), model, F.lit(False)).count() == 0


def test_language_id_equals_an_explicit_kernel():
    """The folded matrix against kernel ridge regression on an explicit Nystroem map."""
    r = random.Random(7)
    say = lambda parts, n: " ".join("".join(r.choices(parts, k=3)) for _ in range(n))
    parts = {"aa": ["th", "er", "ing"], "bb": ["eau", "que", "oi"], "cc": ["sch", "ung", "ein"]}
    texts, labels = zip(*[(say(parts[k], 6 + i % 9), k) for i in range(60) for k in parts], strict=True)

    def bits(text):
        buffer = np.zeros(1 << langid.SLOT_BITS, np.uint8)
        langid.present(text, buffer)
        return buffer

    x = np.array([bits(t) for t in texts], dtype=np.float64)
    model = langid.fit([np.packbits(b.astype(np.uint8)).tobytes() for b in x], list(labels))
    kernel = lambda a, b: (a @ b.T) / np.sqrt(np.outer(a.sum(axis=1), b.sum(axis=1)))
    k_mm = kernel(x, x)
    value, vector = np.linalg.eigh(k_mm)
    good = value > max(value[-1] * 1e-6, 1e-10)
    phi = k_mm @ (vector[:, good] / np.sqrt(value[good]))
    y = np.array([[1.0 if k == name else -1.0 for name in sorted(parts)] for k in labels])
    beta = np.linalg.solve(phi.T @ phi + langid.RIDGE * len(x) / 100 * np.eye(phi.shape[1]), phi.T @ y)
    new = np.array([bits(say(parts[k], 12)) for k in parts for _ in range(5)], dtype=np.float64)
    want = kernel(new, x) @ (vector[:, good] / np.sqrt(value[good])) @ beta
    got = model.scores(new[:, model.slots].astype(np.float32), new.sum(axis=1))
    assert np.abs(want - got).max() < 0.02 and (want.argmax(axis=1) == got.argmax(axis=1)).all()


def test_language_id_keeps_rare_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "IN_ALL", 12)
    r = random.Random(1)
    rows = [(i, " ".join("".join(r.choices("abc", k=4)) for _ in range(20)), "big", "s") for i in range(500)]
    rows += [(1000 + k, f"{chr(0x400 + 40 * k)}{chr(0x401 + 40 * k)} " * 9, f"rare{k}", "s") for k in range(5)] + [(1000, "again", "big", "s")]
    assert langid.train(docs(spark, rows), "text", "lang", "doc_id", F.lit(True)).languages == ["big", *(f"rare{k}" for k in range(5))]


def test_language_id_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    r = queries.op1_language_id(spark, d).where("held_out").join(lang, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert r > 0.97


# toxicity


def test_toxicity_learns(spark):
    rows = [(i, words(30, i) + (" Scum!" if i % 5 == 0 else ""), "en", "s") for i in range(300)] + [(400, None, "en", "s"), (401, "", "en", "s"), (None, "scum", "en", "s"), (402, LONG, "en", "s")]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 300, 2)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(docs(spark, rows), labels, F.col("doc_id") % 3 != 0, F.col("doc_id") % 3 == 0).collect()}
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(300))
    assert got[None].predicted == 1 and got[400].predicted == got[401].predicted == got[402].predicted == 0 and got[3].held_out and not got[None].held_out
    assert toxicity.toxicity(docs(spark, []), labels, F.lit(True), F.lit(False)).count() == 0
    none = toxicity.toxicity(docs(spark, rows), labels.where("toxic = 0"), F.lit(True), F.lit(False))
    assert {x.predicted for x in none.collect()} == {0}


def test_toxicity_on_held_out_labels(spark):
    """The query's held-out rows against their labels: most toxic ones are caught, few others flagged."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = queries.op3_toxicity(spark, d).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert len(toxic) > 30 and sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    above = np.mean([(t.score > c.score) + 0.5 * (t.score == c.score) for t in toxic for c in clean[:400]])
    assert above > 0.95


def test_negative_risk_is_held_at_zero():
    p, u = [np.array([1]), np.array([1])] * 30, [np.array([1, 2]), np.array([2])] * 60
    m = toxicity.fit(p, u, 0.9)
    assert np.isfinite(m.weights).all() and np.isfinite(m.bias)


# decontamination


def test_common_length_equals_table():
    r = random.Random(8)
    for _ in range(50):
        a, b = ([r.choice([b"a", b"b", b"c", b"d"]) for _ in range(r.randrange(1, 20))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontam.common_length(a, b) == t[-1, -1]


def test_decontamination_finds_copies_and_paraphrases(spark):
    items = {i: words(n, 100 + i) + "." for i, n in enumerate((8, 14, 22, 35, 60))}
    b = spark.createDataFrame([*items.items(), (50, None), (51, " "), (52, items[2])], "item_id long, text string")
    para = items[3].split()
    para[4:5], para[12:13] = ["changed"], ["also", "changed"]
    rows = [(i, f"{words(70 + i, i)} {items[i].upper()} {words(33, i + 50)}", "en", "s") for i in range(5)]
    rows += [(10, f"{words(90, 70)} {' '.join(para)} {words(20, 71)}", "en", "s"), (11, words(500, 72), "en", "s"), (12, None, "en", "s"), (13, "", "en", "s"), (14, f"{LONG} {items[1]}", "en", "s"), (None, items[0], "en", "s"), (15, " ".join(items[4].split()[:15]), "en", "s")]
    got = {x.doc_id: x for x in decontam.decontaminate(docs(spark, rows), b).collect()}
    assert len(got) == len(rows)
    for i in range(5):
        assert i in got[i].item_ids and got[i].common == 1
    assert got[2].item_ids == [2, 52] and got[10].item_ids == [3] and got[14].item_ids == [1] and got[None].item_ids == [0]
    assert not any(got[i].contaminated for i in (11, 12, 13, 15))
    assert decontam.decontaminate(docs(spark, []), b).count() == 0
    assert decontam.decontaminate(docs(spark, rows), b.where("item_id > 49 and item_id < 52")).where("contaminated").count() == 0


@pytest.mark.parametrize("bound", [{"ITEM_BLOCK": 2}, {"BLOCK_BYTES": 4 * decontam.RANK * 45}, {"ITEM_BLOCK": 2, "BROADCAST_BYTES": 0}])
def test_decontamination_in_blocks(spark, monkeypatch, bound):
    for name, value in bound.items():
        monkeypatch.setattr(decontam, name, value)
    items = {i: words(20, 200 + i) for i in range(5)}
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {x.doc_id: x.item_ids for x in decontam.decontaminate(docs(spark, [(i, f"{words(40, i)} {t}", "en", "s") for i, t in items.items()]), b).collect()}
    assert got == {i: [i] for i in items}


def test_decontamination_of_many_items(spark):
    items = {i: words(15 + i % 45, 3000 + i) for i in range(1000)}
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = [(i, f"{words(40, i)} {items[i]} {words(30, i + 2000)}", "en", "s") for i in range(0, 1000, 5)]
    got = {x.doc_id: x.item_ids for x in decontam.decontaminate(docs(spark, rows), b).collect()}
    assert got == {i: [i] for i, *_ in rows}


def test_decontamination_of_long_items(spark):
    items = {i: words(n, 5000 + i) for i, n in enumerate((90, 200, 300, 450, 800, 1500, 5000))}
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = [(i, f"{words(300, i)} {t} {words(200, i + 50)}", "en", "s") for i, t in items.items()]
    rows += [(10 + i, f"{words(300, i)} {' '.join(t.split()[: len(t.split()) // 2])}", "en", "s") for i, t in items.items()]
    got = {x.doc_id: (x.item_ids, x.common) for x in decontam.decontaminate(docs(spark, rows), b).collect()}
    assert got == {i: ([i], 1.0) for i in items} | {10 + i: ([], 0.0) for i in items}


def test_decontamination_checks_every_span(spark):
    """The question with a part of the answer early, and the whole item later."""
    item = words(60, 6000).split()
    text = f"{words(50, 1)} {' '.join(item[:50])} {words(12, 2)} {words(300, 3)} {' '.join(item[:20])} x {' '.join(item[21:])} {words(40, 4)}"
    got = decontam.decontaminate(docs(spark, [(1, text, "en", "s")]), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).first()
    assert got.item_ids == [7]
    head, tail = [b"a%d" % i for i in range(20)], [b"z%d" % i for i in range(8)]
    own = [*head[:-1], head[-1] + b".", *tail]
    near = [*own[:20], *tail[:2]]  # most words, too little of the answer
    assert decontam.held_at(near, own, [(0, len(near))]) is None
    both = [*near, *[b"f"] * 200, *own]
    assert decontam.held_at(both, own, [(0, 22), (222, 250)]) == 1


def test_decontamination_recall_of_paraphrases(spark):
    """200 given items, with 10, 20 and 30 % of their words replaced, added or taken away, set into other texts."""
    d = "/root/testdata/sf0.01"
    r = random.Random(1)
    flat = lambda t: " ".join((t or "").lower().split())
    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    items = [(x.item_id, x.text) for x in bench.collect()]
    clean = [x.text for x in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect() if x.text and not any(flat(t) in flat(x.text) for _, t in items)]
    other = [w for t in clean[:300] for w in t.split()]

    def changed(text: str, share: float) -> str:
        w = text.split()
        for k in sorted(r.sample(range(len(w)), max(1, round(len(w) * share))), reverse=True):
            kind = r.random()
            if kind < 0.6:
                w[k] = r.choice(other)
            elif kind < 0.8:
                w.insert(k, r.choice(other))
            else:
                del w[k]
        return " ".join(w)

    rows, want = [(100_000 + j, t, "en", "s") for j, t in enumerate(clean)], {}
    for share in (0.1, 0.2, 0.3):
        for i, text in items:
            around = r.choice(clean).split()
            at = r.randrange(len(around) + 1)
            want[len(want)] = (share, i)
            rows.append((len(want) - 1, " ".join([*around[:at], changed(text, share), *around[at:]]), "en", "s"))
    got = {x.doc_id: x.item_ids for x in decontam.decontaminate(docs(spark, rows), bench).collect()}
    for share in (0.1, 0.2, 0.3):
        mine = [k for k, (s, _) in want.items() if s == share]
        assert sum(want[k][1] in got[k] for k in mine) >= 0.9 * len(mine)
    assert not any(got[100_000 + j] for j in range(len(clean)))


def test_decontamination_equals_substring_search(spark):
    d = "/root/testdata/sf0.01"
    flat = lambda t: " ".join((t or "").lower().split())
    items = {r.item_id: flat(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    want = {r.doc_id: sorted(i for i, t in items.items() if t in flat(r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r.item_ids for r in queries.op4_decontamination(spark, d).collect()}
    hit = sum(set(want[i]) <= set(got[i]) for i in want if want[i])
    assert hit >= 0.99 * sum(bool(x) for x in want.values())
    assert sum(bool(got[i]) and not want[i] for i in want) <= 2


# licences


def test_license_scan(spark):
    mit = dict((k, v) for k, v in licenses.KNOWN[::-1])["MIT"]
    rows = [(1, mit.upper().replace(",", " ,"), "en", "s"), (2, "Copyright (c) 2020 Me\n" + licenses.KNOWN[0][1].replace("license", "licence"), "en", "s"), (3, "x\n released under the MIT licence\nLicensed under CC BY-NC 4.0.\n", "en", "s"), (4, None, "en", "s"), (5, "", "en", "s"), (None, "SPDX-License-Identifier: MIT", "en", "s"), (6, LONG, "en", "s"), (6, "Released under the MIT License.", "en", "s"), (None, None, "en", "s")]
    out = licenses.scan(docs(spark, rows))
    got = out.collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[1].license == "MIT" and by[2].license == "MIT"
    assert by[3].license is None and by[3].line_licenses == "CC-BY-NC-4.0,MIT" and by[3].n_license_lines == 2
    assert by[4].line_licenses == "" and by[4].text_digest == by[5].text_digest and [r.license for r in got if r.doc_id is None] in (["MIT", None], [None, "MIT"])
    assert sorted(r.n_license_lines for r in got if r.doc_id == 6) == [0, 1]
    assert licenses.scan(docs(spark, [])).count() == 0


def test_license_forms(spark):
    """Known texts as they are, wrapped to 80 columns, with a copyright statement, and in a line for each paragraph."""
    import textwrap
    from pathlib import Path

    texts = [(k, t) for k, t in licenses.KNOWN if len(t) > 400]
    files = {"Apache-2.0": "Apache-2.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    for file, name in files.items():
        at = Path("/usr/share/common-licenses") / file
        if at.is_file():
            texts.append((name, at.read_text()))
    rows, want = [], []
    for name, t in texts:
        for form in (t, "\n".join(textwrap.fill(x, 80) for x in t.split("\n")), f"Copyright (c) 2020-2024 Some Body <a@b.example>\nAll rights reserved.\n\n{t}", f"  \u00a9 2021 Some Body\r\n{t.replace(chr(10), chr(13) + chr(10))}", f"Copyright Some Body and others\n{t}"):
            want.append(name)
            rows.append((len(rows), form, "en", "s"))
    rows.append((len(rows), "copyright notices and all that", "en", "s"))
    got = {r.doc_id: r.license for r in licenses.scan(docs(spark, rows)).collect()}
    assert [got[i] for i in range(len(want))] == want and got[len(want)] is None


def test_license_scan_stays_in_the_jvm(spark, sf):
    plan = queries.op6_license_scan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Head &amp; line</h1></header><p>One <b>bold</b><br>two&nbsp;three<p>Next &lt;tag&gt;<aside>side</aside><form><input value=x>mail</form><div class="ad">buy</div><script>var x="</p>";</script></article>
<section id="comments"><article><p>First!</p></article></section><footer>foot</footer></body></html>"""


def test_main_text(spark):
    rest = "<html><body><div class=x>{0}</div><p>Shared words that all pages of this host repeat again</p><p>{1}</p></body></html>"
    rows = [(1, "http://a.example/1", PAGE), (2, "http://b.example/1", rest.format("alpha beta gamma delta epsilon", "one two three four five six")), (3, "http://b.example/2", rest.format("zeta eta theta iota kappa", "seven eight nine ten eleven twelve")), (4, "http://c.example/", rest.format("alone here", "by itself")), (5, None, None), (6, "nonsense", ""), (None, "http://d.example", "<p>unclosed &eacute;"), (7, "http://e.example/a", rest.format("m", "n")), (8, "http://e.example/b", rest.format("m", "n"))]
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()}
    assert got[1].text == "Head & line\n\nOne bold two three\n\nNext <tag>"
    assert got[2].text == "alpha beta gamma delta epsilon\n\none two three four five six"
    assert "Shared words" in got[4].text and "Shared words" in got[7].text and got[7].text == got[8].text
    assert got[5].text == got[6].text == "" and got[5].n_chars == 0 and got[None].text == "unclosed é"
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_keeps_versions_and_usual_phrases(spark):
    frame, foot, body = "<html><body><p>{0}</p><p>{1}</p></body></html>", words(40, 400), words(120, 401)
    usual = "as we have said before in this place "
    texts = [body, edited(body, 1, 1), edited(body, 1, 2), edited(body, 1, 3), *(usual + words(7, 410 + i) for i in range(3)), words(90, 420), words(90, 421)]
    rows = [(i, f"http://f.example/{i}", frame.format(t, foot)) for i, t in enumerate(texts)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(texts))


def test_main_text_of_articles_is_whole(spark):
    import html as h
    import re

    d = "/root/testdata/sf0.01"
    got = {r.page_id: r.text for r in queries.op9_html_main_text(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(h.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n\n".join(x for x in parts if x)


def test_suffixes_cover_exactly_what_repeats():
    """Against brute force: every suffix found twice is verbatim twice, and a repeat of LONG tokens is covered up to its edges."""
    r = random.Random(12)
    pool = [[f"w{r.randrange(50)}" for _ in range(n)] for n in (24, 30, 60, 200)]
    streams = [[f"v{r.randrange(10**9)}" for _ in range(r.randrange(90))] + r.choice(pool) + [f"v{r.randrange(10**9)}" for _ in range(r.randrange(90))] for _ in range(60)]
    from talus.llm.common import word_hashes

    ends = np.cumsum([len(x) for x in streams])
    flat = [w for x in streams for w in x]
    starts, stops, own, keys = html.suffixes(word_hashes([w.encode() for w in flat]), ends)
    said: dict = {}
    for s, e, k in zip(starts, stops, keys.tolist(), strict=True):
        assert said.setdefault(k, flat[s:e]) == flat[s:e]
    twice = {k for k in said if len({int(o) for o, x in zip(own, keys.tolist(), strict=True) if x == k}) > 1}
    covered = np.zeros(len(flat), bool)
    for s, e, k in zip(starts, stops, keys.tolist(), strict=True):
        if k in twice:
            covered[s:e] = True
    margin = html.LONG - html.ANCHOR
    for i, x in enumerate(streams):
        at = int(ends[i]) - len(x)
        held = np.array([w.startswith("w") for w in x])
        assert not (covered[at : at + len(x)] & ~held).any()
        inner = np.flatnonzero(held)[margin : held.sum() - margin]
        assert covered[at + inner].all()


def page_of(*blocks, host="g.example", n=0):
    return (n, f"http://{host}/{n}", "<html><body>" + "".join(blocks) + "</body></html>")


def texts_of(spark, rows):
    return {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("small", [True, False])
def test_main_text_of_unmarked_pages(spark, monkeypatch, small):
    monkeypatch.setattr(html, "small_enough", lambda n, b: small)
    frame, disclaimer = "<ul><li>Home</li><li>About us</li><li>Contact</li><li>Terms</li></ul>", words(60, 900)
    bodies = [f"{words(150, 901 + i)}" for i in range(6)]
    rows = [page_of(frame, f"<p>{b}</p><h2>Summary</h2>" if i < 2 else f"<p>{b}</p>", f"<p>{disclaimer}</p>", n=i) for i, b in enumerate(bodies)]
    rows += [page_of(f"<p>{bodies[0]}</p>", f"<p>{disclaimer}</p>", host="mirror.example", n=100), page_of(f"<div><p>{bodies[0]}</p></div>", f"<p>{disclaimer}</p>", host="mirror.example", n=101)]
    got = texts_of(spark, rows)
    assert all(got[i] == (f"{b}\n\nSummary" if i < 2 else b) for i, b in enumerate(bodies))
    assert got[100] == got[101] == f"{bodies[0]}\n\n{disclaimer}"


def test_main_text_class_names_and_teasers(spark):
    rows = [
        page_of('<article><div class="search-theory"><p>One theory</p></div><div class="social-science"><p>Two science</p></div><div class="cookieBanner">We use cookies</div><div id="related-posts">More</div></article>', n=1),
        page_of(f'<article><p>{words(80, 1)}</p></article><article><p>Teaser card</p></article>', n=2),
        page_of("<div><p>Kept</p></div><div class='hidden-figures'><p>Film</p></div><div class='sidebar-left'>Side</div><template>no</template>", n=3),
        page_of("<article><ul><li>" + "</li><li>".join(f"{words(20, 50 + i)}" for i in range(400)) + "</li></ul></article>", n=4),
    ]
    got = texts_of(spark, rows)
    assert got[1] == "One theory\n\nTwo science" and got[2] == f"{words(80, 1)}\n\nTeaser card" and got[3] == "Kept\n\nFilm"
    assert got[4].count("\n\n") == 399


def test_main_text_of_a_hot_host(spark):
    """A notice in all articles of a host goes; passages that some of them share, and whole articles that mirrors share, stay."""
    notice, shared = words(40, 77), words(70, 78)
    rows = [page_of(f"<nav><a>Menu</a></nav><article><p>{words(60, 2000 + i)}</p>", f"<p>{shared}</p>" if i % 3 == 0 else "", f"<p>{notice}</p></article>", host="hot.example", n=i) for i in range(60)]
    rows += [page_of(f"<article><p>{words(60, 3000 + i)}</p><p>{shared}</p></article>", host=f"other{i}.example", n=100 + i) for i in range(12)]
    rows += [page_of(f"<article><p>{words(60, 4000)}</p></article>", host="same.example", n=200 + i) for i in range(15)]
    got = texts_of(spark, rows)
    assert all(notice not in got[i] and (shared in got[i]) == (i % 3 == 0) and words(60, 2000 + i) in got[i] for i in range(60))
    assert all(shared in got[100 + i] for i in range(12)) and all(got[200 + i] == words(60, 4000) for i in range(15))


def test_host_repeats_find_the_frames_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url", "html", F.xxhash64("page_id").alias("row"))
    streams, repeated, _ = html.host_repeats(pages)
    assert streams.agg(F.sum(F.size("keys"))).first()[0] > 10 * streams.count() and repeated.count() > 100


def test_a_task_opens_token_shards_one_by_one(tmp_path):
    import numpy as np
    import pyarrow as pa

    from talus.llm import tokenout

    for n in range(3):
        (tmp_path / tokenout.shard_name(n, 0)).write_bytes(tokenout.pack_shard([n, None], np.array([2, 1]), np.array([n, 1, 1], dtype=np.uint32)))
    paths = pa.RecordBatch.from_arrays([pa.array([f"file:{tmp_path}/{tokenout.shard_name(n, 0)}" for n in range(3)])], names=["path"])
    got = [b.to_pydict() for b in tokenout._read(f"file://{tmp_path}")(iter([paths]))]
    assert [b["doc_id"] for b in got] == [[0, None], [1, None], [2, None]] and all(b["within"] == [0, 2] and b["n_tokens"] == [2, 1] for b in got)


def test_words_asked_for_most_outlast_a_full_memory(monkeypatch):
    from collections import Counter

    asked, parts = Counter(), tokenout.WordIds._parts
    monkeypatch.setattr(tokenout, "REMEMBERED", 300)
    monkeypatch.setattr(tokenout.WordIds, "_parts", lambda self, word: asked.update([word]) or parts(self, word))
    encoder = tokenout.WordIds(queries.vocabulary_path())
    asked.clear()
    for n in range(20):
        texts = [f"The house, {' '.join(f'rare{chr(97 + k % 26)}{chr(97 + n)}{chr(97 + k // 26)}' for k in range(200))} the HOUSE, the house,".encode()]
        assert [x.tolist() for x in encoder.encode(texts)] == [x.tolist() for x in encoder._whole(texts)]
    assert asked[b"the"] == asked[b"house,"] == 1 and not asked[b"The"] and len(encoder.words) < 600


def test_a_remembered_stem_goes_to_the_library_once_whatever_its_tail(monkeypatch):
    from collections import Counter

    asked, by_letters, whole = Counter(), tokenout.WordIds._by_letters, tokenout.WordIds._whole
    encoder = tokenout.WordIds(queries.vocabulary_path())
    text = lambda x: x if isinstance(x, str) else x.decode()
    monkeypatch.setattr(tokenout.WordIds, "_by_letters", lambda self, stems: asked.update(map(text, stems)) or by_letters(self, stems))
    monkeypatch.setattr(tokenout.WordIds, "_whole", lambda self, texts: asked.update(map(text, texts)) or whole(self, texts))
    turns = [["Élqstem, x9y, qstem,"], ["qstem.", "élqstem; x9y?"], ["qstem élqstem x9y"], ["(qstem Qstem!!! élqstem... x9y%"], ["", " \v\f"], ["qstem,"]]
    for some in turns:
        raw = [t.encode() for t in some]
        assert [x.tolist() for x in encoder.encode(raw)] == [x.tolist() for x in whole(encoder, raw)]
    assert [asked[x] for x in ("qstem", "élqstem", "x9y")] == [1, 1, 1]


def test_texts_of_one_call_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(tokenout, "TOGETHER", 10)
    assert list(tokenout._runs([b"x" * n for n in (4, 4, 4, 30, 0, 0, 9)])) == [(0, 3), (3, 4), (4, 7)] and list(tokenout._runs([])) == []


def test_stems_of_letters_and_lower_case_give_the_library_s_ids():
    encoder = tokenout.WordIds(queries.vocabulary_path())
    assert encoder.by_word and encoder.by_letters
    texts = ["Straße, ÉCOLE ÀÉÎÕÜ. señor! Ungewöhnlich; µm ªº", "H\u0331 h\u0331 T\u0308x E\u0301, A\u030A", "ŒUVRE Ēa. ǅ Ǆx İstanbul, K Å", "", " \t\n", "DON'T I'LL x's 'S, A.B. (C)", "x\x00y \x1cAB\x1f a\u0085B\u00a0C", "Αθήνα ΣΊΣΥΦΟΣ, Hello WORLD"]
    for some in (texts, *[[t] for t in texts]):
        got = tokenout.WordIds.encode(encoder, [t.encode() for t in some])
        assert [x.tolist() for x in got] == [x.tolist() for x in encoder._whole([t.encode() for t in some])]


def test_a_worker_s_memory_goes_back_when_a_task_ends():
    import pickle

    import numpy as np
    from pyspark import cloudpickle

    from talus.llm import common

    def resident() -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 >> 20

    def fragments(batches):
        yield from batches
        rows = [np.full(1000 + i % 7, 1.0) for i in range(20_000)]  # 160 MB, below small ones that stay
        return [(r[:1].copy(), bytes(600)) for r in rows]

    def held(batches):
        common.HELD["test", "rest"] = yield from fragments(batches)

    common.HELD["other", "x"] = object()
    before = resident()
    assert list(common.lean(held, "test")(iter([1, 2]))) == [1, 2]
    assert list(common.HELD) == [("test", "rest")] and resident() - before < 80
    shipped = pickle.loads(cloudpickle.dumps(common.lean(iter)))  # as tasks get it
    assert list(shipped(iter([3]))) == [3] and not common.HELD


def test_maps_of_the_pipeline_s_operators_give_memory_back(monkeypatch, spark):
    seen, kind = [], type(spark.range(1))
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **b: seen.append(f.__qualname__) or plain(self, f, *a, **b))
    rows = docs(spark, [(i, f"some words of document {i}", "en", "s") for i in range(4)])
    items = spark.createDataFrame([(1, "words of an item")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    tokenout.token_output(rows, queries.vocabulary_path())
    toxicity.toxicity(rows, labels, F.lit(True), F.lit(False))
    decontam.decontaminate(rows, items)
    minmax.near_duplicates(rows, percent=80)
    assert len(seen) >= 10 and set(seen) == {"lean.<locals>.go"}

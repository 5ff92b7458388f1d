"""Fill-in-middle by a wavelet matrix over character classes.

The UTF-8 bytes of a slice of texts are one sequence of 3-bit classes: whether a byte begins a code point, a word, a line. A wavelet
matrix answers how many bytes of a class stand before a place; such ranks, added up over the classes that begin a unit, count the
unit's boundaries, and bisection on these counts finds the byte where a cut after k units falls. Texts are never decoded."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, ship, spread

#: Bits of a class, and the classes that begin each unit.
CODE_POINT, WORD, LINE = 4, 2, 1
UNITS = {"char": CODE_POINT, "word": WORD, "line": LINE}
#: Bytes of text in one matrix; a longer text has one of its own.
SLICE = 4 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True


def classes_of(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each byte; starts are where texts begin, which begins a word and a line."""
    point = (raw & 0xC0) != 0x80
    blank = _BLANK[raw]
    fresh = np.zeros(len(raw), dtype=bool)
    fresh[starts] = True
    word, line = fresh.copy(), fresh
    word[1:] |= blank[:-1]
    line[1:] |= raw[:-1] == 10
    return (point * CODE_POINT | (word & ~blank) * WORD | line * LINE).astype(np.uint8)


class WaveletMatrix:
    """Ranks over a sequence of small integers: a bit vector a level, from the highest bit, each level sorted stably by the one above."""

    def __init__(self, values: np.ndarray, bits: int = 3):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for shift in reversed(range(bits)):
            on = values >> shift & 1 == 1
            packed = np.packbits(on, bitorder="little")
            words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((shift, words, before, len(values) - int(before[-1])))
            values = np.concatenate([values[~on], values[on]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(words[at >> 6] & low)

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """How often the value occurs before each place."""
        low, high = np.zeros(1, dtype=np.int64), at
        for shift, words, before, zeros in self.levels:
            a, b = self._ones(words, before, low), self._ones(words, before, high)
            low, high = (zeros + a, zeros + b) if value >> shift & 1 else (low - a, high - b)
        return high - low

    def boundaries(self, unit: int, at: np.ndarray) -> np.ndarray:
        """How many units begin before each place."""
        return sum(self.rank(value, at) for value in range(8) if value & unit)

    def cut(self, unit: int, starts: np.ndarray, ends: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place after k units of each text: where unit k + 1 begins, its start for 0, its end if it has no more units."""
        wanted = self.boundaries(unit, starts) + k
        low, high = starts.copy(), ends.copy()
        while (low < high).any():
            mid = (low + high) // 2
            past = self.boundaries(unit, np.minimum(mid + 1, ends)) > wanted
            low, high = np.where(past | (low >= high), low, mid + 1), np.where(past, mid, high)
        return np.where(k == 0, starts, low)


def slices(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Runs of texts of no more than `limit` bytes together, but for one text alone."""
    out, first, held = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and held + n > limit:
            out.append((first, i))
            first, held = i, 0
        held += n
    return [*out, (first, len(sizes))] if len(sizes) else []


def _cut(unit: int, plain_from: int, spm_below: int, marks: tuple[bytes, bytes, bytes]):
    """(doc_id, text, h1 to h4) to the documents' forms and outputs."""

    def run(batches):
        import pyarrow as pa

        p, s, m = marks
        for batch in batches:
            texts = bytes_of(batch.column(1))
            h = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2, 6)]
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            for at, to in slices(sizes, SLICE):
                raw = np.frombuffer(b"".join(texts[at:to]), dtype=np.uint8)
                ends = np.cumsum(sizes[at:to])
                starts = ends - sizes[at:to]
                matrix = WaveletMatrix(classes_of(raw, starts[starts < ends]))
                n = matrix.boundaries(unit, ends) - matrix.boundaries(unit, starts)
                a, b = h[0][at:to] % (n + 1), h[1][at:to] % (n + 1)
                first = matrix.cut(unit, starts, ends, np.minimum(a, b))
                second = matrix.cut(unit, starts, ends, np.maximum(a, b))
                points = [matrix.boundaries(CODE_POINT, x) for x in (starts, first, second)]
                forms, outputs = [], []
                for i, text in enumerate(texts[at:to]):
                    if not text or h[2][at + i] % 100 >= plain_from or any(x in text for x in marks):
                        forms.append("plain")
                        outputs.append(text)
                        continue
                    x, y = first[i] - starts[i], second[i] - starts[i]
                    prefix, middle, suffix = text[:x], text[x:y], text[y:]
                    spm = h[3][at + i] % 100 < spm_below
                    forms.append("spm" if spm else "psm")
                    outputs.append(b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle)))
                plain = np.array([f == "plain" for f in forms])
                out = [batch.column(0).slice(at, to - at), pa.array(n, pa.int64()), pa.array(forms, pa.string())]
                out += [pa.array(points[i + 1] - points[i], pa.int64(), mask=plain) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*out, pa.array(outputs, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", fim_percent: int = 90, spm_percent: int = 20, seed: int = 1, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """Cut each text in prefix, middle and suffix, and put the middle last.

    Returns per row doc_id, n (units of the text), form (plain, psm, spm), prefix_chars, middle_chars (code points; null if plain) and
    output. The cuts follow from the SHA-256 of seed and id alone, so reruns and repeated rows agree; a null id counts as an empty
    one. Null texts are empty; empty texts, and texts that hold a mark, stay plain. Units are code points, words (cut where
    one begins, blanks before the first word belonging to it) or lines; a text without units is all suffix. Other columns are ignored;
    an empty table gives an empty result."""
    if any(a[i:] == b[: len(a) - i] for a in marks for b in marks for i in range(1, len(a))) or len(set(marks)) < 3 or not all(marks):
        raise ValueError("marks must differ, and none may end as one of them begins")
    ship(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), digest.alias("digest"))
    rows = spread(rows).select("doc_id", "text", *[F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)])
    schema = rows.select("doc_id", F.lit(0).cast("long").alias("n"), F.lit("").alias("form"), F.lit(None).cast("long").alias("prefix_chars"), F.lit(None).cast("long").alias("middle_chars"), F.lit("").alias("output")).schema
    return rows.mapInArrow(_cut(UNITS[unit], fim_percent, spm_percent, tuple(x.encode() for x in marks)), schema)


def restore(output: Column | str = "output", form: Column | str = "form", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made of."""
    out, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))

    def behind(c: Column, head: Column, mark: str) -> Column:
        return F.substring(c, F.length(head) + len(mark) + 1, F.length(c))

    def parts(first: str, second: str, third: str) -> tuple[Column, Column, Column]:
        rest = F.substring(out, F.lit(len(first) + 1), F.length(out))
        one = F.substring_index(rest, second, 1)
        rest = behind(rest, one, second)
        two = F.substring_index(rest, third, 1)
        return one, two, behind(rest, two, third)

    prefix, suffix, middle = parts(*marks)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(marks[1], marks[0], marks[2])
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(out)


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT *, CAST(length(x) AS BIGINT) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
      CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
      CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, substr(x, 1, p) AS pre, substr(x, p + 1, q - p) AS mid, substr(x, q + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE x END) AS output_sha256, sha256(x) AS restored_sha256
FROM o
"""

"""License scans by canonical digest lookup: DataFrame functions only.

A text is reduced once to canonical lines (case, equivalent spellings, punctuation, white space, no copyright statements);
the SHA-256 of all of them, and that of each, are hash-joined to the digests of known licence texts and notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread

#: Spellings that count as equal in licence matching, each turned into the second form.
SPELLINGS = [
    ("sublicence", "sublicense"),
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("http:", "https:"),
    ("&", " and "),
    ("©", " copyright "),
]
#: A canonical line is a copyright statement if it matches the first and not the second pattern, which is for lines of
#: licences that begin with the word.
_STATEMENT = r"^(all rights reserved$|copyright( |$)|c (copyright )?[0-9]{4})"
_NO_STATEMENT = r"^copyright (notices?|holders?|owners?|laws?|license|licenses|licensed|statements?|protection|interests?|and|or|in|of|on|is|to|as|for|with|treaty|treaties|disclaimers?|act|grant|the (software|program|library|work|original|covered))( |$)"
_OTHER = r"[^\p{L}\p{N}\n]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_0BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD3 = _BSD2 + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: Known licence texts and notices with their SPDX identifiers.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "The MIT License\n" + _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("0BSD", _0BSD),
    ("BSD-2-Clause", _BSD2 + _BSD_TAIL),
    ("BSD-3-Clause", _BSD3 + _BSD_TAIL),
    ("Zlib", _ZLIB),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]


#: SHA-256 of the canonical forms of long licence texts as their publishers word them.
DIGESTS = [
    ("Apache-2.0", "7dc0ccfedfe9cf9e59c97a3e43eea7b035a0e7a7be84d714acef36eb5c9fb4bc"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.3", "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
    ("GPL-1.0", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "0d3c171c5c43c8ba6cb7c5850249fc6766dd85cca709271b31086b150e91716e"),
    ("LGPL-2.0", "289c8b47fa0ec7e5f22cd33d32feaa06f015b0f2fdb9ad916979b1011ca8c015"),
    ("LGPL-2.1", "5ddd6039d3b090c51328879800301dd19b1ad99e14d00f3c6f221ab45a32db57"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
]


def canonical_lines(text: Column) -> Column:
    x = F.lower(text)
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    lines = F.transform(F.split(F.regexp_replace(x, _OTHER, " "), "\n"), lambda line: F.trim(line))
    return F.filter(lines, lambda line: (line != "") & ~(line.rlike(_STATEMENT) & ~line.rlike(_NO_STATEMENT)))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digest(text: Column) -> Column:
    return sha256(F.array_join(canonical_lines(text), " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, license: one row for each distinct form; of two licences with one form the first by name."""
    rows = spark.createDataFrame(KNOWN if known is None else known, "license string, text string").select(digest(F.col("text")).alias("digest"), "license")
    if known is None:
        rows = rows.union(spark.createDataFrame([(d, x) for x, d in DIGESTS], "digest string, license string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per input row: doc_id, text_digest, license (of the whole text, else null), line_licenses (those of whole
    lines, distinct, sorted, joined by commas; '' if none), n_license_lines.

    A null text counts as empty; the empty form is no licence. Repeated rows, rows that repeat an id and null ids are
    rows of their own. Other columns are ignored. The list of known licences is fixed, so its side of the join is a
    handful of rows and is broadcast. Of a document's digests all but the whole one and those found are gone before
    the only shuffle, which has one row a document."""
    spark = docs.sparkSession
    table = F.broadcast(known_digests(spark, known).where(F.col("digest") != sha256(F.lit(""))))
    base = spread(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    lined = base.select("doc_id", F.monotonically_increasing_id().alias("row"), canonical_lines(F.col("text")).alias("lines"))
    every = F.concat(F.array(sha256(F.array_join("lines", " "))), F.transform("lines", sha256))
    looked = lined.select("doc_id", "row", F.posexplode(every).alias("at", "digest")).join(table, "digest", "left").where("at = 0 or license is not null")
    whole, line = F.col("at") == 0, F.col("at") > 0
    out = looked.groupBy("row", "doc_id").agg(
        F.max(F.when(whole, F.col("digest"))).alias("text_digest"),
        F.max(F.when(whole, F.col("license"))).alias("license"),
        F.array_join(F.array_sort(F.collect_set(F.when(line, F.col("license")))), ",").alias("line_licenses"),
        F.count(F.when(line, F.lit(1))).alias("n_license_lines"),
    )
    return out.select("doc_id", "text_digest", "license", "line_licenses", "n_license_lines")


def _sql_lines(column: str) -> str:
    x = f"lower({column})"
    for a, b in SPELLINGS:
        x = f"replace({x}, '{a}', '{b}')"
    x = f"regexp_replace({x}, '{_OTHER}', ' ', 'g')"
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: trim(l)), lambda l: l <> '' AND NOT (regexp_matches(l, '{_STATEMENT}') AND NOT regexp_matches(l, '{_NO_STATEMENT}')))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = f"""
WITH known AS (
  SELECT digest, min(license) AS license FROM (
    SELECT sha256(array_to_string({_sql_lines("t")}, ' ')) AS digest, license FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN)}) k(license, t)
    UNION ALL SELECT digest, license FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in DIGESTS)}) d(license, digest))
  WHERE digest <> sha256('') GROUP BY digest),
lined AS (SELECT doc_id, row_number() OVER () AS r, {_sql_lines("coalesce(text, '')")} AS lines FROM documents),
whole AS (SELECT doc_id, r, sha256(array_to_string(lines, ' ')) AS text_digest FROM lined),
found AS (
  SELECT l.r, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS line_licenses, count(*) AS n
  FROM (SELECT r, sha256(unnest(lines)) AS digest FROM lined) l JOIN known k USING (digest) GROUP BY l.r)
SELECT w.doc_id, w.text_digest, k.license, coalesce(f.line_licenses, '') AS line_licenses, coalesce(f.n, 0) AS n_license_lines
FROM whole w LEFT JOIN known k ON k.digest = w.text_digest LEFT JOIN found f ON f.r = w.r
"""

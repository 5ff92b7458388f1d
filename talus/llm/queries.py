"""The queries of this subpackage, each over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embeddings, fim, html, langid, licenses, lines, minmax, mixing, phrases, secrets, tokenout, toxicity
from .common import bucket_of_id, table


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = bucket_of_id(F.col("doc_id"), 4)
    model = langid.train(docs, "text", "lang", "doc_id", fold != 2)
    return langid.identify(docs, model, fold == 2)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = bucket_of_id(F.col("doc_id"), 5)
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold != 0, fold == 0)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenout.token_output(table(spark, sf_dir, "documents"), vocabulary_path()).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_repeated_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restore()).alias("restored_sha256"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(secrets.listed(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256)
    return out.select("doc_id", *map(count, base), digest.alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


OP5_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM worded WHERE text_is(w)),
sizes AS (SELECT d.doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n FROM documents d LEFT JOIN shingled s USING (doc_id)),
flat AS (SELECT doc_id, unnest(s) AS sh FROM shingled),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM flat a JOIN flat b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
two AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, t.b FROM reach r JOIN two t ON r.b = t.a)
SELECT s.doc_id, s.n AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM sizes s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.n
""".replace(" WHERE text_is(w)", " WHERE w IS NOT NULL")

OP10_SQL = r"""
WITH lined AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
flat AS (SELECT doc_id, r, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM lined),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM flat),
gone AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(g.k) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE g.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN gone g USING (k) GROUP BY doc_id, r
"""

OP7_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, t.b FROM reach r JOIN links t ON r.b = t.a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(any_value(c.n), 0) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id GROUP BY e.vec_id
"""

QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_mixing, op3_toxicity, op4_decontamination, op5_minmax_near_dedup, op6_license_scan, op7_embedding_near_dedup, op8_token_output, op9_html_main_text, op10_line_dedup, op11_fill_in_middle, op12_phrase_collocations, op13_secret_scan)
}
ORACLE = {"op2_mixing": mixing.ORACLE, "op5_minmax_near_dedup": OP5_SQL, "op6_license_scan": licenses.ORACLE, "op7_embedding_near_dedup": OP7_SQL, "op10_line_dedup": OP10_SQL, "op11_fill_in_middle": fim.ORACLE, "op12_phrase_collocations": phrases.ORACLE, "op13_secret_scan": secrets.ORACLE}

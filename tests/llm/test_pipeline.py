"""The pipeline's stages against plain versions, and its edge rows."""

import corpus_pipeline as cp
from pyspark.sql import functions as F
from talus.llm import mixing, tokenout
from talus.llm.queries import vocabulary_path

SF = "/root/testdata/sf0.01"


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in cp.STAGES[:-1]:
        at = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name.replace(' ', '-')}"
        stage(spark, docs, SF).write.mode("overwrite").parquet(at)
        before, docs = docs, spark.read.parquet(at)
        assert docs.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        kept.append((name, before, docs, ids))
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic & kept[0][3]) <= 0.35 * len(toxic)
    flat = lambda t: " ".join((t or "").lower().split())
    items = [flat(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in kept[2][1].collect() if not any(i in flat(r.text) for i in items)}
    assert clean == kept[2][3]
    plan = {r.doc_id: r.copies for r in mixing.mix(kept[3][1]).collect()}
    assert {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()} == {i: n for i, n in plan.items() if n}
    out = cp.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count()
    assert out.agg(F.sum("n_tokens")).first()[0] == tokenout.token_output(docs, vocabulary_path()).agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0]


def test_edge_rows_pass(spark):
    rows = [(1, None, "en", None), (None, "a b c d e f", "en", "s"), (2, "a b c d e f", "en", "s"), (2, "a b c d e f", "en", "s"), (3, "", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("copies", F.lit(9)).withColumn("kept", F.lit(False))
    for _, stage in cp.STAGES[:3]:
        docs = stage(spark, docs, SF)
    assert sorted(r.doc_id is None or r.doc_id for r in docs.collect()) == [1, 2, 3, True] or docs.count() == 4
    mixed = cp.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns
    assert cp.write_token_ids(spark, mixed, SF).count() == mixed.count()
    empty = docs.where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_null_and_repeated_ids(spark):
    """Null ids are rows of their own, of a repeated id one row stays, the same in each run; the mix takes rows, not ids."""
    texts = [" ".join(f"w{i}x{k}" for k in range(20 + i)) for i in range(12)]
    rows = [(None, t, "en", "a") for t in texts[:4]] + [(7, texts[4], "en", "a"), (7, texts[5], "de", "b"), (8, texts[6], "en", "b"), (9, None, "en", None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    key = lambda df: sorted(map(repr, df.collect()))
    kept = cp.keep_one_of_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == 8 and kept.where("doc_id is null").count() == 5
    assert key(kept) == key(cp.keep_one_of_near_duplicates(spark, docs.orderBy(F.col("text").desc()), SF))
    mixed = cp.mix_sources(spark, docs, SF)
    plan = mixing.mix(docs).collect()
    assert mixed.count() == sum(r.copies for r in plan)
    assert set(key(mixed)) <= set(key(docs))


def test_map_columns_beside_repeated_ids(spark):
    rows = [(1, "a b c d e f g", "en", "s", {"k": 1}, [{"x": 1}]), (1, "h i j k l m n", "en", "s", {"k": 2}, None), (2, "o p q r s t u", "en", "s", None, [{"x": None}]), (2, "o p q r s t u", "en", "s", {}, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, m map<string,int>, a array<map<string,int>>")
    kept = cp.keep_one_of_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, cp.keep_one_of_near_duplicates(spark, docs.orderBy(F.desc("text")), SF).collect()))
    mixed = cp.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in mixing.mix(docs).collect())

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_classifier", "ngram_jaccard_join", "pii", "best_fit_packing"]
    before, labels = docs, spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            assert out.join(before, "doc_id", "left_anti").count() == 0
        if name == "quality_classifier":
            kept = before.join(labels, "doc_id").withColumn("kept", F.col("doc_id").isin([r.doc_id for r in out.select("doc_id").collect()]))
            assert kept.filter(F.col("kept") != (F.col("quality") == 1)).count() <= kept.count() // 50
        if name == "ngram_jaccard_join":
            assert out.select("text").distinct().count() == out.count() < before.count()
        if name == "pii":
            assert out.count() == before.count()
            assert out.filter(F.col("text").rlike(r"[a-z]\.\d\d@mail\d\.example\.com")).count() == 0
        before = out
    assert before.select("doc_id").distinct().count() == spark.read.parquet(str(tmp_path / "pii")).count()


def test_stages_keep_columns_and_null_ids(spark, odd_docs):
    docs = odd_docs.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")).withColumn("_times", F.lit(3))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {r.score for r in out.select("score").collect()} <= {0.5}
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.filter("doc_id = 1").count() == 1
    assert kept.filter("doc_id is null").count() == 2

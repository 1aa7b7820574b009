import random

from pyspark.sql import functions as F

import corpus_pipeline
from sparkseek.llm.common import word_count


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]


def test_run_packs_what_the_stages_keep(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, small).cache()
        assert kept.columns == docs.columns
        assert kept.select("doc_id").subtract(before.select("doc_id")).isEmpty()
        if name != "mixing":
            assert kept.count() <= before.count()
    want = {r["doc_id"]: r["n"] for r in kept.groupBy("doc_id").agg(F.sum(word_count("text")).alias("n")).collect()}
    got = {r["doc_id"]: r["n"] for r in corpus_pipeline.run(spark, small).groupBy("doc_id").agg(F.sum("words").alias("n")).collect()}
    assert got == want


def test_filtering_keeps_clean_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    good = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").select("doc_id").distinct()
    kept = corpus_pipeline.quality(spark, docs, small).join(good, "doc_id", "left_semi").select("doc_id").distinct().count()
    assert kept >= 0.97 * good.count()


def test_awkward_rows_and_clashing_columns(spark, small, awkward):
    rng = random.Random(1)
    rows = [(r[0], r[1], None, r[2], 1, "k", "x", 1.5, "y") for r in awkward] + [(50 + i, f"plain words {rng.random()} of a text.", "en", "s", 2, "k", "x", 2.5, "y") for i in range(20)]
    schema = "doc_id long, text string, lang string, source string, size int, row string, line_dedup string, quality_score double, turn string"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, small)
        if name != "packing":
            assert docs.columns == before.columns
        assert docs.count() > 0
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0

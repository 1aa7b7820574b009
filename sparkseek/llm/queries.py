"""The queries of this subpackage, each over the whole table it is meant for, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linededup, mixing, topk
from .common import fold, read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(read(spark, sf_dir, "documents"), shingle=3, radius=3)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(read(spark, sf_dir, "documents"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import dedup_substrings

    return dedup_substrings(read(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k_products

    return top_k_products(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import learn_profiles, predict_languages

    docs = read(spark, sf_dir, "documents")
    profiles = learn_profiles(docs, fold("doc_id", 5) != 0)
    out = predict_languages(docs, profiles)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spotsigs import edited_fingerprints

    return edited_fingerprints(read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_packing

    return best_fit_packing(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn_toxicity, score_toxicity

    docs = read(spark, sf_dir, "documents")
    model = learn_toxicity(docs, read(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    out = score_toxicity(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import THRESHOLD, learn_quality, score_quality

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn_quality(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    out = score_quality(docs, model, score_col="score").drop("text")
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "line_dedup.n_lines", "line_dedup.removed_lines")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_substring": op3_substring,
    "op4_topk": op4_topk,
    "op5_langid": op5_langid,
    "op6_spotsigs": op6_spotsigs,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_lines": op10_lines,
}

SQL: dict[str, str] = {"op2_mixing": mixing.SQL, "op4_topk": topk.SQL, "op10_lines": linededup.SQL}

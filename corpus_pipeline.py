"""From raw documents to packed training bins: five stages, each written and read again as the next one's input.

Defined cases, for every stage: null and empty texts are kept as their operator defines
them (quality scores them as one empty line; line dedup, near-dedup and mixing see no
words; packing gives them no bin); null ids and sources are values of their own; repeated rows
are scored alike and are one document to near-dedup; very long texts are read whole; all
columns are kept to the last stage but one, whatever their names; an empty table gives an
empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm.common import fold, free_name, read
from sparkseek.llm.linededup import dedup_lines
from sparkseek.llm.mixing import mixed_documents
from sparkseek.llm.packing import best_fit_packing
from sparkseek.llm.quality import THRESHOLD, learn_quality, score_quality
from sparkseek.llm.simhash import drop_near_duplicates
from sparkseek.session import removed, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject; it learns from the labels of folds 1 to 4.

    Without labels of both classes nothing is rejected.
    """
    model = learn_quality(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    score = free_name("quality_score", docs.columns)
    return score_quality(docs, model, score_col=score).where(F.col(score) >= THRESHOLD).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of repeated windows; a document of which nothing is left goes.

    Texts that were empty before stay; ``n_chars`` follows the text that is left.
    """
    report = free_name("line_dedup", docs.columns)
    out = dedup_lines(docs, report_col=report)
    left = out.where((F.col(report).getField("removed_lines") == 0) | (F.trim("text") != "")).drop(report)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id; rows without id all stay."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask; those without words only in whole passes."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its bin; documents without words have none."""
    return best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL cannot express the classifier or the packing; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again.

    A stage's rows are deleted once the next stage's are written; the last stage's are the result.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs

"""Reciprocal rank fusion of ranked lanes, and relevance metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .paging import STABLE, order_by

K = 60


def lane(rows: DataFrame, name: str, depth: int, id_col: str = "candidate_id", order: list | None = None) -> DataFrame:
    """``(id, lane, rank, raw)``: the first ``depth`` distinct ids of a lane; repeats keep their best place."""
    order = order or STABLE
    kept = rows.orderBy(*order_by(order)).limit(depth)
    turn = Window.orderBy(*order_by(order))
    own = Window.partitionBy(id_col).orderBy("__turn")
    first = kept.withColumn("__turn", F.row_number().over(turn)).withColumn("__own", F.row_number().over(own)).where("__own = 1")
    rank = F.row_number().over(Window.orderBy("__turn"))
    return first.select(F.col(id_col).alias("id"), F.lit(name).alias("lane"), rank.alias("rank"), F.col("score").alias("raw"))


def rrf(lanes: list[DataFrame], first: str) -> DataFrame:
    """``(id, score, lanes map<lane, struct<rank, raw>>)``: ties go to ids that are in the first lane, then to the smaller id."""
    rows = reduce(DataFrame.unionByName, lanes)
    return rows.groupBy("id").agg(
        F.sum(F.lit(1.0) / (F.lit(K) + F.col("rank"))).alias("score"),
        F.max((F.col("lane") == first).cast("int")).alias("in_first"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("lane", F.struct("rank", "raw"))))).alias("lanes"),
    )


def fused_page(fused: DataFrame, k: int) -> DataFrame:
    return fused.orderBy(F.col("score").desc(), F.col("in_first").desc(), "id").limit(k)


def reconciled(fused: DataFrame) -> DataFrame:
    """Fused scores beside what their lanes' ranks add up to."""
    again = F.aggregate(F.map_values("lanes"), F.lit(0.0), lambda s, x: s + F.lit(1.0) / (F.lit(K) + x["rank"]))
    return fused.withColumn("recomputed", again).withColumn("agrees", F.abs(F.col("recomputed") - F.col("score")) < 1e-12)


def relevance(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """``ranked(query, id, rank)`` and ``judged(query, id, grade)`` to ``(query, mrr, ndcg, recall)``."""
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    ideal_rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("grade").desc(), "id"))
    ideal = (
        judged.withColumn("r", ideal_rank).groupBy("query")
        .agg(
            F.sum(F.when(F.col("r") <= k, gain / F.log2(F.col("r") + 1.0))).alias("ideal"),
            F.sum((F.col("grade") > 0).cast("int")).alias("relevant"),
        )
    )
    found = ranked.where(F.col("rank") <= k).join(judged.where("grade > 0"), ["query", "id"]).groupBy("query").agg(
        F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("gained"), F.min("rank").alias("best"), F.count(F.lit(1)).alias("hits")
    )
    return ideal.join(found, "query", "left").select(
        "query",
        F.coalesce(F.lit(1.0) / F.col("best"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.when(F.col("ideal") > 0, F.col("gained") / F.col("ideal")), F.lit(0.0)).alias("ndcg"),
        F.coalesce(F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")), F.lit(0.0)).alias("recall"),
    )

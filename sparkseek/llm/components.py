"""Connected components of an undirected graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of any orderable type to ``(node, root)``.

    ``root`` is the smallest node that can be reached; nodes that are their
    own root do not appear. Self loops, nulls and repeated edges are ignored.

    Every round is two grouped minima with map-side combination and two
    equi-joins; no adjacency list is ever gathered. The minima are written
    before they are joined: so each side of a join has a shuffle of its own and
    adaptive execution can split the links of a node that has very many. Rounds are
    cut by checkpoints, so a lost executor costs one round at most.
    """
    now = checkpointed(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        least = checkpointed(least)
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = checkpointed(large.distinct())
        root = checkpointed(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(root, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                )
            ).alias("e")
        )
        now = checkpointed(small.select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))

"""Words near each other, by a join on positions that only meets within windows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.errors import QueryError
from ..session import checkpointed

WINDOW, MOST_WINDOW = 8, 1024


def adjacent(docs: DataFrame, toks: str, a: str, b: str, window: int = WINDOW, id_col: str = "candidate_id") -> DataFrame:
    """``(id, pairs)``: places of ``a`` and ``b`` at a distance of 1 to ``window``, in either order.

    Positions are keyed by blocks of the window's length, so a place of ``a`` meets
    three blocks of ``b`` only; no pair beyond two windows is ever formed.
    """
    if not 1 <= window <= MOST_WINDOW:
        raise QueryError("WORK_BUDGET", f"a window is 1 to {MOST_WINDOW}")
    both = docs.where(F.array_contains(toks, a) & F.array_contains(toks, b))
    places = both.select(F.col(id_col).alias("id"), F.posexplode(toks).alias("pos", "term"))
    block = F.floor(F.col("pos") / F.lit(window))
    left = places.where(F.col("term") == a).select("id", F.col("pos").alias("p"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    right = places.where(F.col("term") == b).select("id", F.col("pos").alias("r"), block.alias("block"))
    near = left.join(right, ["id", "block"]).where(F.abs(F.col("p") - F.col("r")).between(1, window))
    return near.groupBy("id").agg(F.count(F.lit(1)).alias("pairs"))


#: Pairs of a tile that are tried together; rows of heavy keys that are broadcast at most, and partitions of a join.
TILE_PAIRS, MOST_HEAVY, MOST_PARTS = 1 << 24, 100_000, 20_000


def span_overlaps(spans: DataFrame, chunks: DataFrame, width: int = 64) -> DataFrame:
    """``spans(path, s, e)`` joined to ``chunks(path, start_line, end_line)`` they overlap.

    Both sides are keyed by blocks of lines; a pair that shares several blocks
    is kept at the first one. Pairs can grow with the square of a path's rows, so the pairs of
    every block are counted first: a block of more than ``TILE_PAIRS`` is cut into
    tiles of parts of both sides, and partitions are as many as the pairs need, whatever the bytes are.
    """
    key = ["path", "block"]

    def blocks(a, b):
        return F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))).alias("block")

    left = spans.select("*", blocks("s", "e"))
    right = chunks.select("*", blocks("start_line", "end_line"))
    counts = left.groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("l")).join(right.groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("r")), key)
    counts = checkpointed(counts)
    pairs = F.col("l") * F.col("r")
    work, rows, n = counts.agg(F.sum(pairs), F.sum(F.col("l") + F.col("r")), F.sum((pairs > TILE_PAIRS).cast("long"))).first()
    parts = max(1, min(MOST_PARTS, math.ceil((work or 0) / TILE_PAIRS + (rows or 0) / 1e6)))
    if n:
        tiles = F.ceil(pairs / TILE_PAIRS)
        a = F.greatest(F.lit(1), F.least(tiles, F.round(F.sqrt(tiles * F.col("l") / F.col("r"))).cast("long")))
        heavy = counts.where(pairs > TILE_PAIRS).select(*key, a.alias("__a"), F.ceil(tiles / a).alias("__b"))
        heavy = F.broadcast(heavy) if n <= MOST_HEAVY else heavy

        def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
            """Each row in one part of its side, once for each part of the other."""
            names = side.columns
            cut = side.join(heavy, key, "left").select(*names, F.coalesce(own, F.lit(1)).alias("own"), F.coalesce(other, F.lit(1)).alias("other"))
            part = F.pmod(F.xxhash64(*names), F.col("own")).alias(own)
            return cut.select(*names, part, F.explode(F.sequence(F.lit(0).cast("long"), F.col("other") - 1)).alias(other))

        left, right = dealt(left, "__a", "__b"), dealt(right, "__b", "__a")
        key = [*key, "__a", "__b"]
    both = left.repartition(parts, *key).join(right.repartition(parts, *key).hint("merge"), key).where("s <= end_line and e >= start_line")
    first = F.greatest(F.floor(F.col("s") / width), F.floor(F.col("start_line") / width))
    return both.where(F.col("block") == first).drop("block", "__a", "__b")

"""Helpers that several operators share: words, folds, checkpoints, samples."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BATCH_BYTES as BATCH_BYTES
from ..session import arrow_map as arrow_map
from ..session import checkpointed as checkpointed

#: A word is a maximal run of bytes other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
_GAP = re.compile(rb"[\x20\x09-\x0d]")
#: Largest piece of one text that is split into words at a time.
SLAB = 1 << 22


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids fall in fold 0 of the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def word_count(text: Column | str) -> Column:
    """Number of words of a text; 0 for null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def word_slabs(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists that stay small however long the text is."""
    at, size = 0, len(text)
    while at < size:
        end = min(at + SLAB, size)
        if end < size:
            gap = _GAP.search(text, end)
            end = gap.start() if gap else size
        yield text[at:end].split()
        at = end


def hash_sample(df: DataFrame, key: str, limit: int, salt: int = 0) -> DataFrame:
    """At most ``limit`` rows of ``df``, those of the smallest hash of ``key``; reruns agree.

    Of many rows only those below a bound that leaves some two times ``limit``
    are ordered, so that no task sends ``limit`` rows of its own.
    """
    unit = 1 << 40
    rows = df.count()
    ranked = df.withColumn("__place", F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(unit)))
    if rows > 4 * limit:
        ranked = ranked.where(F.col("__place") < int(unit * 2 * limit / rows))
    return ranked.orderBy("__place", F.col(key)).limit(limit).drop("__place")


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def maybe_broadcast(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Broadcast a side whose row count has been taken and lies within the bound."""
    return F.broadcast(df) if rows <= bound else df

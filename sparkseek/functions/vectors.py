"""Vector expressions in the JVM, and the built-in hash embedder."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import fold_text, nfc, query_tokens

DIMENSION = 64


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def literal_vector(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def cosine_with(v: Column, query: list[float]) -> Column:
    """Cosine with a fixed vector, whose length is taken on the driver; 0 for a zero vector."""
    size = math.sqrt(math.fsum(float(x) ** 2 for x in query))
    product = dot(v, literal_vector(query))
    length = norm(v) * F.lit(size)
    return F.when(length > 0, product / length).otherwise(F.lit(0.0))


def unit(v: Column, dimension: int) -> Column:
    """The vector divided by its length; the query fails on one of another dimension, without length or with parts that are not finite."""
    wide = doubles(v)
    bad = v.isNull() | (F.size(v) != dimension) | F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | (norm(wide) <= 0)
    fail = F.raise_error(F.lit(f"NOT_NORMALIZED: a vector to be stored is not finite, has no length or has not {dimension} parts"))
    return F.when(bad, fail.cast("array<double>")).otherwise(F.transform(wide, lambda x: x / norm(wide)))


def fnv1a64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def hash_embed(text: str, dimension: int = DIMENSION) -> list[float]:
    """A unit vector: each token adds 1 at its hash's slot and takes 0.5 at the slot of the hash rotated by 32 bits."""
    out = [0.0] * dimension
    try:
        words = query_tokens(text)
    except ValueError:
        words = []
    for w in words:
        h = fnv1a64(fold_text(nfc(w)).encode())
        out[h % dimension] += 1.0
        out[((h >> 32) | (h << 32)) % (1 << 64) % dimension] -= 0.5
    size = math.sqrt(math.fsum(x * x for x in out))
    return [x / size for x in out] if size else out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embed_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: hash_embed(x or ""))

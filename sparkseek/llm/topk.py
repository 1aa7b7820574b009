"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are scaled to integers, so that products are exact. Within each block of
candidates they are ordered by length and cut into buckets. For a query whose
k-th best product so far is ``t``, a bucket of greatest length ``m`` can only help
if the cosine reaches ``t / (|q| m)``: above 1 the bucket is skipped, near
1 candidates are pruned on the query's largest coordinates (a cosine bounds how
far a unit vector's coordinate lies from the query's), and otherwise only
candidates of length ``t / |q|`` or more are multiplied. Products of what
remains are then verified on the integers.

Queries are taken in blocks of bounded size. A block is broadcast, its rows are
written and its broadcast is given up before the next one comes, so that neither the driver
nor an executor ever holds more than one; each partition returns at most k rows for each query.

Defined cases: null vectors, empty ones and those with a null or non-finite
component take no part; only vectors of one dimension meet; rows that share
the query's id are its own; a repeated candidate row counts each time, a repeated query
row once; the vectors of one query id are ranked together; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed

SCALE = 1024
QUERY_BLOCK = 4096
BUCKET = 1024
#: Local cosine threshold from which coordinates are pruned, and how many of them.
COORDINATE_FROM, FOCUS = 0.6, 3


def scaled_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(vec_id, v array<long>)`` of the vectors that take part."""
    v = F.col(vector_col)
    double = F.transform(v, lambda x: x.cast("double"))
    odd = F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(double, lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    return vectors.where(v.isNotNull() & (F.size(v) > 0)).where(~odd).where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), whole.alias("v")
    )


class Block:
    """Queries of one dimension with the state of a top-k search."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, v, k
        self.norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        unit = v / np.maximum(self.norm, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        self.at = np.take_along_axis(unit, self.focus, axis=1)
        self.least = np.full(len(ids), -np.inf)
        self.pool = [np.zeros(0, np.int64)] * 3  # row of the query, id, score

    def seed(self) -> None:
        """The other queries are candidates too: their k-th best product bounds the answer from below."""
        for s in range(0, len(self.ids), 512):
            products = _products(self.v[s : s + 512], self.v).astype(np.float64)
            products[self.ids[s : s + 512][:, None] == self.ids[None, :]] = -np.inf
            if products.shape[1] >= self.k:
                self.least[s : s + 512] = np.partition(products, products.shape[1] - self.k, axis=1)[:, products.shape[1] - self.k]

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-norm, kind="stable")
        for s in range(0, len(order), BUCKET):
            part = order[s : s + BUCKET]
            self._bucket(ids[part], v[part], norm[part])

    def _bucket(self, ids, v, norm) -> None:
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(self.norm * norm[0] > 0, self.least / (self.norm * norm[0]), np.where(self.least > 0, np.inf, -1.0))
        live = local <= 1 + 1e-9
        sharp = live & (local >= COORDINATE_FROM)
        found = []
        for rows in (np.flatnonzero(live & ~sharp)[i : i + 512] for i in range(0, int((live & ~sharp).sum()), 512)):
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(self.norm[rows] > 0, self.least[rows] / self.norm[rows], -np.inf).min()
            n = int(np.searchsorted(-norm, -(need - 1e-6 * abs(need) - 1e-6), "right")) if np.isfinite(need) else len(norm)
            if n:
                found += self._multiply(rows, ids[:n], v[:n])
        if sharp.any():
            unit = (v / np.maximum(norm, 1e-300)[:, None]).T.copy()
            for rows in (np.flatnonzero(sharp)[i : i + 512] for i in range(0, int(sharp.sum()), 512)):
                t = np.minimum(local[rows], 1.0)
                keep = np.ones((len(rows), len(ids)), bool)
                for f in range(self.focus.shape[1]):
                    q = self.at[rows, f]
                    wide = np.sqrt(np.maximum(0, (1 - t * t) * (1 - q * q))) + 1e-7
                    c = unit[self.focus[rows, f]]
                    # The allowed band widens towards the query's own coordinate as the cosine grows from t to 1.
                    low = np.where(-q >= t, -1.0, q * t - wide)
                    high = np.where(q >= t, 1.0, q * t + wide)
                    keep &= (c >= low[:, None] - 1e-7) & (c <= high[:, None] + 1e-7)
                r, c = np.nonzero(keep)
                for s in range(0, len(r), 1 << 16):
                    q, p = rows[r[s : s + (1 << 16)]], c[s : s + (1 << 16)]
                    score = (self.v[q] * v[p]).sum(axis=1)
                    good = (score >= self.least[q]) & (ids[p] != self.ids[q])
                    found.append((q[good], ids[p[good]], score[good]))
        if found:
            self._merge(found)

    def _multiply(self, rows, ids, v):
        scores = _products(self.v[rows], v)
        own = self.ids[rows][:, None] == ids[None, :]
        least = self.least[rows]
        if scores.shape[1] > self.k:
            shown = np.where(own, np.iinfo(np.int64).min, scores)
            least = np.maximum(least, np.partition(shown, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k])
        r, c = np.nonzero((scores >= least[:, None]) & ~own)
        return [(rows[r], ids[c], scores[r, c])]

    def _merge(self, found) -> None:
        q, i, s = (np.concatenate([a, *b]) for a, b in zip(self.pool, zip(*found, strict=True), strict=True))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        begins = np.searchsorted(q, np.arange(len(self.ids)))
        rank = np.arange(len(q)) - begins[q] if len(q) else np.zeros(0, np.int64)
        top = rank < self.k
        last = rank == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], s[last])
        self.pool = [q[top], i[top], s[top]]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products; in floating point where it is exact."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _by_dimension(ids: pa.Array, lists: pa.Array):
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    ids = ids.to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield int(d), ids[rows], flat[starts[rows][:, None] + np.arange(d)]


def top_k_products(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = SCALE, block: int = QUERY_BLOCK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k highest products, ties to the smaller id.

    ``is_query`` is a condition on ``vec_id``.
    """
    spark = vectors.sparkSession
    rows = scaled_vectors(vectors, id_col, vector_col, scale)
    asked = rows.where(is_query).dropDuplicates(["vec_id", "v"])
    asked = checkpointed(asked)
    blocks = max(1, -(-asked.count() // block))
    parts = []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b).toArrow()
        held: dict[int, Block] = {}
        if own.num_rows:
            own = own.combine_chunks()
            for d, ids, v in _by_dimension(own.column("vec_id").chunk(0), own.column("v").chunk(0)):
                held[d] = Block(ids, v, k)
                held[d].seed()
        sent = spark.sparkContext.broadcast(held)

        def run(batches, sent=sent):
            import copy

            state = copy.deepcopy(sent.value)
            for batch in batches:
                for d, ids, v in _by_dimension(batch.column(0), batch.column(1)):
                    if d in state:
                        state[d].add(ids, v)
            for x in state.values():
                q, i, s = x.pool
                yield pa.RecordBatch.from_arrays([pa.array(x.ids[q]), pa.array(i), pa.array(s)], ["query_id", "vec_id", "score"])

        part = arrow_map(rows, run, "query_id long, vec_id long, score long")
        if blocks > 1:
            part = checkpointed(part)
            sent.destroy()
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024::DOUBLE * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM (SELECT DISTINCT * FROM whole) q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

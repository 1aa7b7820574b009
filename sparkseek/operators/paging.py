"""Total orders, keyset pages, group projections and counts."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.errors import QueryError

MOST_ROWS = 10_000
#: (column, descending) in order; each list is a total order.
RANKED = [("score", True), ("repo", False), ("path", False), ("start_line", False), ("end_line", False), ("candidate_id", False)]
STABLE = [("score", True), ("path", False), ("start_line", False), ("end_line", False), ("candidate_id", False)]
RECENT = [("committer_time_ms", True), ("sha", False), ("path", False)]
BY_ID = [("candidate_id", False)]


def check_top_k(k: int) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= MOST_ROWS:
        raise QueryError("INVALID_TOP_K", f"top_k is 1 to {MOST_ROWS}")
    return k


def order_by(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc() if down else F.col(c).asc() for c, down in order]


def after(order: list[tuple[str, bool]], key: list) -> Column:
    """Rows strictly after a key in the order."""
    out = F.lit(False)
    same = F.lit(True)
    for (c, down), value in zip(order, key, strict=True):
        v = F.lit(value)
        out = out | (same & ((F.col(c) < v) if down else (F.col(c) > v)))
        same = same & (F.col(c) == v)
    return out


def page(rows: DataFrame, order: list[tuple[str, bool]], k: int, key: list | None = None) -> DataFrame:
    """At most ``k`` rows in order, after the key if there is one: a bounded top-k, not a sort of everything."""
    check_top_k(k)
    if key is not None:
        rows = rows.where(after(order, key))
    return rows.orderBy(*order_by(order)).limit(k)


def group_first(rows: DataFrame, by: list[str], order: list[tuple[str, bool]]) -> DataFrame:
    """The best row of each group, by an aggregation with map-side combination instead of a window over the group."""
    names = rows.columns
    rank = F.struct(*[(-F.col(c)).alias(f"k{i}") if down else F.col(c).alias(f"k{i}") for i, (c, down) in enumerate(order)])
    best = rows.groupBy(*by).agg(F.min_by(F.struct(*names), rank).alias("__row"))
    return best.select("__row.*")


def projected_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"))


def boosted(rows: DataFrame, millis: int) -> DataFrame:
    return rows if millis == 1000 else rows.withColumn("score", F.col("score") * F.lit(millis) / F.lit(1000.0))


class Cursors:
    """Opaque signed tokens of a page's last key, bound to the query, the order and the generation."""

    def __init__(self, secret: bytes):
        self.secret = secret

    def _mac(self, body: bytes) -> str:
        return hmac.new(self.secret, body, hashlib.sha256).hexdigest()

    def issue(self, route: str, query: str, pin: str, key: list) -> str:
        body = json.dumps([route, query, pin, key], ensure_ascii=False).encode()
        return base64.urlsafe_b64encode(self._mac(body).encode() + body).decode()

    def read(self, token: str, route: str, query: str, pin: str) -> list:
        try:
            raw = base64.urlsafe_b64decode(token)
            mac, body = raw[:64].decode(), raw[64:]
            if not hmac.compare_digest(mac, self._mac(body)):
                raise ValueError
            got = json.loads(body)
        except (ValueError, UnicodeDecodeError) as e:
            raise QueryError("INVALID_CURSOR", "the cursor is not one of ours") from e
        if got[:3] != [route, query, pin]:
            raise QueryError("INVALID_CURSOR", "the cursor belongs to another query or generation")
        return got[3]


def percentiles(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Nearest-rank p50, p95 and p99."""
    each = [F.expr(f"percentile_disc({p}) within group (order by {value})").alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)]
    return rows.groupBy(*(by or [])).agg(*each)

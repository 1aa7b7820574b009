"""Runtime metadata: chunks by the state of an overlay, a catalog and its edges. Semi-joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cased, tokens
from ..functions.timeref import parse_history_timeref
from ..plans.ast import Query
from ..plans.errors import QueryError
from ..sources.snapshot import Snapshot
from .history import _condition, content_leaf, holds_text
from .paging import BY_ID, page

RUNTIME = frozenset("dirty changed stale snapshot meta.owner meta.service meta.layer meta.surface affected invalidated_by".split())
BESIDE = frozenset(("repo", "file", "lang", "content"))


def search(s: Snapshot, q: Query, k: int, now_ms: int, key: list | None = None) -> DataFrame:
    """At least one runtime filter; score 1; in order of candidate id."""
    if not any(f.name in RUNTIME for f in q.filters):
        raise QueryError("UNSUPPORTED_COMBO", "the runtime route needs a runtime filter")
    rows = s.need("chunks").withColumn("__text", cased(F.col("text"), q.options.case)).withColumn("__tokens", tokens(F.col("__text")))
    for f in q.filters:
        if f.name not in RUNTIME | BESIDE:
            raise QueryError("UNSUPPORTED_FILTER", f"{f.name}: is not a filter of the runtime route")
        rows = _filtered(s, rows, f, now_ms, q.options.case)
    rows = rows.where(_condition(q.expr, F.col("__text"), F.col("__tokens"), q.options.case))
    return page(rows.withColumn("score", F.lit(1.0)).drop("__text", "__tokens"), BY_ID, k, key)


def _filtered(s: Snapshot, rows: DataFrame, f, now_ms: int, case: bool) -> DataFrame:
    if f.name == "content":
        return rows.where(_condition(content_leaf(f), F.col("__text"), F.col("__tokens"), case))
    if f.name == "repo":
        return rows.where(F.col("repo").rlike(f"^(?:{f.value})$"))
    if f.name == "file":
        return rows.where(holds_text("path", f.value, case))
    if f.name == "lang":
        return rows.where(holds_text("lang", f.value.strip(), case))
    if f.name == "dirty":
        ids = s.need("dirty").select("candidate_id").distinct()
        return rows if f.value == "yes" else rows.join(ids, "candidate_id", "left_semi" if f.value == "only" else "left_anti")
    if f.name == "changed":
        t = parse_history_timeref(f.value.removeprefix("since="), now_ms)
        return rows.join(s.need("changed").where(F.col("applied_at_ms") >= t).select("path").distinct(), "path", "left_semi")
    if f.name == "stale":
        t = parse_history_timeref(f.value.removeprefix("before="), now_ms)
        head = s.need("head").where((F.col("head_ms") > F.col("materialized_ms")) & (F.col("materialized_ms") < t))
        return rows.where(head.agg((F.count(F.lit(1)) > 0).alias("stale")).select("stale").scalar())
    if f.name == "snapshot":
        ids = s.need("snapshots").where(F.col("name") == f.value)
        if ids.isEmpty():
            raise QueryError("UNKNOWN_SNAPSHOT", f.value)
        return rows.join(ids.select("candidate_id").distinct(), "candidate_id", "left_semi")
    if f.name.startswith("meta."):
        ids = s.need("facets").where(F.col(f.name.removeprefix("meta.")) == f.value)
        return rows.join(ids.select("candidate_id").distinct(), "candidate_id", "left_semi")
    edges = s.need("affected" if f.name == "affected" else "invalidated").where(F.col("key") == f.value)
    return rows.join(edges.select("candidate_id").distinct(), "candidate_id", "left_semi")

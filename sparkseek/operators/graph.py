"""The repository graph and the repository map."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_tokens
from ..plans.errors import QueryError
from .paging import check_top_k

#: Rows that a walk of the repository map fetches at a time.
PAGE = 1000


def neighbours(edges: DataFrame, ids: list[str], direction: str = "out", kinds: list[str] | None = None, limit: int = 1000) -> DataFrame:
    """Bounded adjacency of some nodes, in order of kind and neighbour."""
    if direction not in ("out", "in"):
        raise QueryError("UNSUPPORTED_COMBO", "a direction is out or in")
    own, other = ("source", "target") if direction == "out" else ("target", "source")
    rows = edges.where(F.col(own).isin(ids))
    if kinds:
        rows = rows.where(F.col("kind").isin(kinds))
    return rows.select(F.col(own).alias("node"), "kind", F.col(other).alias("neighbour")).orderBy("node", "kind", "neighbour").limit(limit)


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("target", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def delta_applied(contributions: DataFrame, affected: DataFrame, fresh: DataFrame, key: str = "owner") -> DataFrame:
    """Contributions of affected owners replaced; all others kept as they are."""
    return contributions.join(affected.select(key).distinct(), key, "left_anti").unionByName(fresh)


def ranked_entries(entries: DataFrame, text: str, focus: list[str] = (), focus_paths: list[str] = ()) -> DataFrame:
    """Entries with their order keys: in focus, of a focused owner, query words contained, score, identity."""
    words = query_tokens(text) if text.strip() else []
    hits = sum((F.contains(F.lower("search_text"), F.lit(w)).cast("int") for w in words), F.lit(0))
    return entries.select(
        "*", F.col("identity").isin(list(focus)).alias("in_focus"), F.col("owner_path").isin(list(focus_paths)).alias("near_focus"), hits.alias("hits")
    )


_KEYS = (("in_focus", True), ("near_focus", True), ("hits", True), ("score_millis", True), ("identity", False))


def _beyond(last) -> Column:
    """Rows after ``last`` in the order of ``_KEYS``."""
    out, tie = F.lit(False), F.lit(True)
    for name, falling in _KEYS:
        c, v = F.col(name), F.lit(last[name])
        out = out | (tie & ((c < v) if falling else (c > v)))
        tie = tie & (c == v)
    return out


@dataclass
class Selection:
    """What the map takes, in order, and the codes of the whole answer."""

    taken: list
    dropped: int
    drop_codes: list[str]
    degrade_codes: list[str]


def select_entries(entries: DataFrame, text: str, k: int, budget: int, focus: list[str] = (), focus_paths: list[str] = (), page: int = PAGE) -> Selection:
    """The greedy walk down the ranked entries: what does not fit the budget is skipped, and the first is always taken.

    Unmatched entries are ranked lower, not dropped. An entry costs one token at least.
    The walk fetches pages by key, and of the rows behind the first page only those
    that still fit: so every page but the last adds to the selection, and however many
    entries there are, the driver sees a few pages of them.
    """
    check_top_k(k)
    rows = ranked_entries(entries, text, focus, focus_paths).withColumn("cost", F.greatest(F.col("tokens"), F.lit(1)).cast("long"))
    universe, matched = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("hits"), F.lit(0)) > 0).first()
    order = [F.col(c).desc() if falling else F.col(c).asc() for c, falling in _KEYS]
    shown = rows.select("identity", "in_focus", "near_focus", "hits", "score_millis", "cost")
    taken, used, floor, last, before = [], 0, False, None, 0
    while len(taken) < k:
        left = shown if last is None else shown.where(_beyond(last) & (F.col("cost") <= budget - used))
        got = left.orderBy(*order).limit(page).collect()
        for r in got:
            if len(taken) >= k:
                break
            last = r
            if used + r["cost"] <= budget or not taken:
                floor |= used + r["cost"] > budget
                used += r["cost"]
                taken.append(r)
        if len(got) < page:
            break
    if taken and len(taken) >= k:
        before = shown.where(_beyond(taken[-1])).count()
    skipped = universe - before - len(taken)
    drops = ["token_budget_exhausted"] * (skipped > 0) + ["top_k_exhausted"] * (before > 0)
    degraded = ["query_terms_unmatched"] * bool(text.strip() and not matched) + ["token_budget_floor_applied"] * floor
    return Selection(taken, universe - len(taken), sorted(drops), sorted(degraded))


def repo_map(entries: DataFrame, text: str, k: int, budget: int, focus: list[str] = (), focus_paths: list[str] = ()) -> DataFrame:
    """``(rank, identity, score_millis, tokens)`` of the selected entries; tokens are what each costs."""
    got = select_entries(entries, text, k, budget, focus, focus_paths)
    out = [(i, r["identity"], r["score_millis"], r["cost"]) for i, r in enumerate(got.taken, 1)]
    return entries.sparkSession.createDataFrame(out, "rank int, identity string, score_millis long, tokens long")

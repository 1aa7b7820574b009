"""Commits and diff hunks: filters, text, both orders, and revisions by time."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cased, has_words, query_literal, query_tokens, tokens
from ..functions.timeref import parse_history_timeref
from ..plans.ast import All, Any, Empty, Keyword, Not, Phrase, Query, Raw, positive_leaves
from ..plans.errors import QueryError
from ..session import arrow_map, checkpointed
from ..sources.snapshot import Snapshot
from .bm25 import Scorer
from .paging import RECENT, page

COMMIT_FILTERS = frozenset("author committer message content before after since until rev type".split())
DIFF_FILTERS = COMMIT_FILTERS | {"file", "diff.added", "diff.removed", "diff.touched"}


def snippet(row_cols: tuple[str, ...] = ("touched", "added", "removed", "header")) -> Column:
    """The first of the columns that is not empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in row_cols])


def _condition(e, text: Column, toks: Column, case: bool = False) -> Column:
    """``text`` is in the case mode already, and ``toks`` are its tokens."""
    if isinstance(e, Empty):
        return F.lit(True)
    if isinstance(e, Not):
        return ~_condition(e.of, text, toks, case)
    if isinstance(e, (All, Any)):
        parts = [_condition(x, text, toks, case) for x in e.of]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(e, All) else out | p
        return out
    if isinstance(e, (Keyword, Phrase)):
        return has_words(text, toks, query_tokens(e.text, case))
    if isinstance(e, Raw):
        return F.contains(text, F.lit(query_literal(e.text, case)))
    raise QueryError("UNSUPPORTED_LEAF", "the history route takes words, phrases and raw text")


def content_leaf(f) -> Keyword | Phrase | Raw:
    """The leaf of a ``content:`` filter; these routes have no patterns."""
    kinds = {"keyword": Keyword, "phrase": Phrase, "raw": Raw}
    if f.scope not in kinds:
        raise QueryError("UNSUPPORTED_LEAF", "content: takes words, phrases and raw text on this route")
    return kinds[f.scope](f.value)


def holds_text(column: str, pattern: str, case: bool) -> Column:
    """A filter's text stands in a column, in the query's case mode."""
    return F.contains(cased(F.col(column), case), F.lit(query_literal(pattern, case)))


#: First parents are followed for at most so many doublings; a history of 2**40 commits would need more.
DOUBLINGS = 40
#: Commits of a bucket, which a Python worker holds at once, and shas at which links enter a bucket that the driver holds at most.
BUCKET, MOST_ENTRIES = 250_000, 500_000


class _Bucket:
    """Commits next to each other in time, in memory: their shas and, for each, its parents."""

    def __init__(self, rows: list[pa.RecordBatch]):
        self.table = pa.Table.from_batches(rows).combine_chunks()
        self.shas = self.table.column("sha").to_pylist()
        lists = self.table.column("parents").chunk(0)
        self.ends = [0, *np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()]
        self.links = lists.flatten().to_pylist()
        self.place = {x: i for i, x in enumerate(self.shas)}

    def parents(self, i: int) -> list[str]:
        return self.links[self.ends[i] : self.ends[i + 1]]

    def exits(self, starts: list[int]) -> list[str | None]:
        """For each start the first commit of another bucket on its way along first parents, none if the way ends before."""
        known: dict[int, str | None] = {}
        for start in starts:
            at, way, out = start, [], None
            while at not in known:
                known[at] = None  # also ends a circle
                way.append(at)
                up = self.parents(at)[:1]
                if not up:
                    break
                if up[0] not in self.place:
                    out = up[0]
                    break
                at = self.place[up[0]]
            else:
                out = known[at]
            for i in way:
                known[i] = out
        return [known[i] for i in starts]

    def reached(self, starts: list[int]) -> tuple[list[int], set[str]]:
        """The starts' ancestors by ways inside this bucket, starts included, and the shas to which ways lead out."""
        seen, out, stack = set(starts), set(), list(starts)
        while stack:
            for to in self.parents(stack.pop()):
                i = self.place.get(to)
                if i is None:
                    out.add(to)
                elif i not in seen:
                    seen.add(i)
                    stack.append(i)
        return sorted(seen), out


def _of_buckets(stored: DataFrame, run: Callable[[int, list[pa.RecordBatch]], pa.Table | None], schema: str, active: set[int] | None = None) -> DataFrame:
    """``run`` on each partition as a whole; where only some are active, the others are not read."""

    def whole(batches):
        bucket = TaskContext.get().partitionId()
        if active is None or bucket in active:
            held = [b for b in batches if b.num_rows]
            out = run(bucket, held) if held else None
            if out is not None:
                yield from out.to_batches()

    return arrow_map(stored, whole, schema)


def reachable(commits: DataFrame, anchor: str) -> DataFrame:
    """``(sha, committer_time_ms)`` of the anchor and all its ancestors.

    Commits are dealt in order of time to buckets of bounded size, so that nearly all links
    stay in one bucket and are followed in memory there. The driver holds only the shas at
    which links enter a bucket and where the way along first parents leaves it; along these all first
    parents are followed at once. The other parents of merges that lead to another bucket start
    further rounds, which read only the buckets that are newly entered. A history whose
    order of time says nothing of its links has too many such shas and is walked by jumps.
    """
    spark = commits.sparkSession
    links = F.filter(F.coalesce("parents", F.array().cast("array<string>")), lambda x: x.isNotNull())
    each = commits.where("sha is not null").groupBy("sha").agg(
        F.array_distinct(F.flatten(F.collect_list(links))).alias("parents"), F.collect_list(F.struct("committer_time_ms")).alias("times"), F.min("committer_time_ms").alias("first")
    )
    buckets = max(1, -(-commits.count() // BUCKET))
    stored = checkpointed(each.repartitionByRange(buckets, "first", "sha").select("sha", "parents", "times"))

    def entered(_, rows):
        b = _Bucket(rows)
        return pa.table({"sha": pa.array(sorted({x for x in b.links if x not in b.place}), pa.string())})

    light = stored.select("sha", "parents")
    targets = _of_buckets(light, entered, "sha string").distinct().limit(MOST_ENTRIES + 1).toArrow().column("sha").to_pylist()
    if len(targets) > MOST_ENTRIES:
        return _by_jumps(commits, anchor)
    wanted = spark.sparkContext.broadcast({*targets, anchor})

    def led(bucket, rows):
        b = _Bucket(rows)
        starts = [i for i, x in enumerate(b.shas) if x in wanted.value]
        return pa.table({"sha": pa.array([b.shas[i] for i in starts], pa.string()), "bucket": pa.array([bucket] * len(starts), pa.int32()), "to": pa.array(b.exits(starts), pa.string())})

    places = _of_buckets(light, led, "sha string, bucket int, to string").toArrow()  # a row for each target at most
    entries = {s: (b, to) for s, b, to in zip(*(places.column(c).to_pylist() for c in ("sha", "bucket", "to")), strict=True)}
    reached: dict[int, set[str]] = {}
    new = [anchor]
    while new:
        active = set()
        for sha in new:
            while sha in entries and sha not in reached.setdefault(entries[sha][0], set()):
                reached[entries[sha][0]].add(sha)
                active.add(entries[sha][0])
                sha = entries[sha][1]
        sent = spark.sparkContext.broadcast({b: reached[b] for b in active})

        def left(bucket, rows, sent=sent):
            b = _Bucket(rows)
            out = b.reached([b.place[x] for x in sent.value[bucket]])[1]
            return pa.table({"sha": pa.array(sorted(out), pa.string())})

        found = _of_buckets(light, left, "sha string", active).distinct().toArrow().column("sha").to_pylist() if active else []  # of the targets
        new = [x for x in found if x in entries and x not in reached.get(entries[x][0], ())]
    everything = spark.sparkContext.broadcast(reached)

    def taken(bucket, rows):
        b = _Bucket(rows)
        rows = b.table.take(pa.array(b.reached([b.place[x] for x in everything.value[bucket]])[0], pa.int64()))
        return rows.select(["sha", "times"])

    schema = f"sha string, times {stored.schema['times'].dataType.simpleString()}"
    return _of_buckets(stored, taken, schema, {b for b, x in reached.items() if x}).select("sha", F.explode("times").alias("t")).select("sha", F.col("t.committer_time_ms").alias("committer_time_ms"))


def _by_jumps(commits: DataFrame, anchor: str) -> DataFrame:
    """``reachable`` for histories in no order of time.

    First parents are a function, so jumps along them can be doubled and every table of
    jumps has a row for each commit at most, however histories merge; a set is closed
    under first parents in as many joins as the logarithm of the depth. The other parents
    of merges then start further sets, until none is new: as many rounds as
    side branches nest. All joins are equi-joins, cut by checkpoints.
    """
    first = commits.select("sha", F.get("parents", F.lit(0)).alias("to")).where("to is not null").distinct()
    merged = commits.where(F.size("parents") > 1).select("sha", F.explode(F.slice("parents", F.lit(2), F.size("parents") - 1)).alias("to")).distinct()
    jumps: list[DataFrame] = []
    complete = False
    seen = new = checkpointed(commits.where(F.col("sha") == anchor).select("sha").distinct())
    while not new.isEmpty():
        level = 0
        while True:
            if level == len(jumps) and not complete:
                jump = first if not jumps else jumps[-1].join(jumps[-1].select(F.col("sha").alias("to"), F.col("to").alias("far")), "to").select("sha", F.col("far").alias("to"))
                jump = checkpointed(jump)
                complete = jump.isEmpty() or level >= DOUBLINGS
                if not complete:
                    jumps.append(jump)
            if level == len(jumps):
                break
            new = new.unionAll(new.join(jumps[level], "sha").select("to")).distinct()
            new = checkpointed(new) if level % 2 else new
            level += 1
        new = checkpointed(new)
        seen = checkpointed(seen.unionAll(new).distinct())
        new = checkpointed(new.join(merged, "sha").select(F.col("to").alias("sha")).distinct().join(seen, "sha", "left_anti"))
    return commits.select("sha", "committer_time_ms").join(seen, "sha", "left_semi")


def at_time(commits: DataFrame, anchor: str, at_ms: int) -> DataFrame:
    """The newest reachable commit not after a time; ties to the greater sha. Empty if there is none."""
    rows = reachable(commits, anchor).where(F.col("committer_time_ms") <= at_ms)
    newest = rows.agg(F.max(F.struct("committer_time_ms", "sha")).alias("m")).where("m is not null")
    return newest.select("m.sha", "m.committer_time_ms")


def search(s: Snapshot, q: Query, k: int, now_ms: int, order: str = "recency", key: list | None = None) -> DataFrame:
    """``type:commit`` or ``type:diff`` queries; recency, or BM25 of the kind's text and then recency."""
    kinds = q.values("type")
    if kinds not in (["commit"], ["diff"]):
        raise QueryError("UNSUPPORTED_COMBO", "the history route needs type:commit or type:diff")
    diff = kinds == ["diff"]
    commits = s.need("commits")
    if diff:
        hunks = s.need("hunks")
        rows = hunks.join(commits, "sha").withColumn("search_text", F.concat_ws("\n", "header", "added", "removed", "touched"))
    else:
        rows = commits.withColumn("path", F.lit("")).withColumn("search_text", F.col("message"))
    case = q.options.case
    rows = rows.withColumn("__text", cased(F.col("search_text"), case)).withColumn("__tokens", tokens(F.col("__text")))
    everything = rows
    for f in q.filters:
        if f.name not in (DIFF_FILTERS if diff else COMMIT_FILTERS):
            raise QueryError("UNSUPPORTED_FILTER", f"{f.name}: is not a filter of this history query")
        if f.name == "content":
            rows = rows.where(_condition(content_leaf(f), F.col("__text"), F.col("__tokens"), case))
        elif f.name != "type":
            rows = _filtered(s, rows, f, now_ms, case)
    rows = rows.where(_condition(q.expr, F.col("__text"), F.col("__tokens"), case))
    if order == "recency":
        rows = rows.withColumn("score", F.lit(None).cast("double"))
        sort = RECENT
    elif order == "relevance":
        words = [e for e in positive_leaves(q.expr) if isinstance(e, (Keyword, Phrase))]
        if not words:
            raise QueryError("UNSCORABLE", "relevance needs a word or phrase that is not negated")
        scorer = Scorer(everything, "__text", "__tokens")
        for e in words:
            scorer.want(query_tokens(e.text, case))
        score = scorer.score(query_tokens(words[0].text, case))
        for e in words[1:]:
            score = score + scorer.score(query_tokens(e.text, case))
        rows = rows.withColumn("score", F.round(score, 6))
        sort = [("score", True), *RECENT]
    else:
        raise QueryError("UNSUPPORTED_COMBO", f"unknown order {order}")
    if diff:
        rows = rows.withColumn("snippet", snippet())
    return page(rows, sort, k, key).drop("__text", "__tokens", "search_text")


def _filtered(s: Snapshot, rows: DataFrame, f, now_ms: int, case: bool) -> DataFrame:
    if f.name in ("author", "committer", "message"):
        return rows.where(holds_text(f.name, f.value, case))
    if f.name.startswith("diff."):
        return rows.where(holds_text(f.name.removeprefix("diff."), f.value, case))
    if f.name == "file":
        return rows.where(holds_text("path", f.value, case))
    if f.name in ("before", "after", "until"):
        t = parse_history_timeref(f.value, now_ms)
        c = F.col("committer_time_ms")
        return rows.where({"before": c < t, "after": c > t, "until": c <= t}[f.name])
    if f.name == "since":
        if f.value.startswith("commit:"):
            name = f.value.removeprefix("commit:")
            named = _names(s).where(F.col("name") == name).select("sha").union(s.need("commits").where(F.col("sha") == name).select("sha"))
            low = s.need("commits").join(named.distinct(), "sha", "left_semi").agg(F.max("committer_time_ms").alias("t")).select("t").scalar()
            return rows.where(F.col("committer_time_ms") >= low)
        return rows.where(F.col("committer_time_ms") >= parse_history_timeref(f.value.removeprefix("time:"), now_ms))
    if f.name == "rev":
        if m := re.fullmatch(r"at\.time\((.*?)(?:,\s*(.*))?\)", f.value, re.S):
            anchor = (m[2] or "HEAD").strip().strip("\"'")
            found = _names(s).where(F.col("name") == anchor).select("sha").first()
            sha = found["sha"] if found else anchor
            return rows.join(at_time(s.need("commits"), sha, parse_history_timeref(m[1], now_ms)).select("sha"), "sha", "left_semi")
        named = _names(s).where(F.col("name") == f.value).select("sha").distinct().withColumn("__named", F.lit(True))
        return rows.join(named, "sha", "left").where((F.col("sha") == f.value) | F.coalesce("__named", F.lit(False))).drop("__named")
    raise QueryError("UNSUPPORTED_FILTER", f"{f.name}: is not a filter of the history route")


def _names(s: Snapshot) -> DataFrame:
    refs = s.need("refs").select("name", "sha")
    return refs.unionByName(s.tags.select("name", "sha")) if s.tags is not None else refs

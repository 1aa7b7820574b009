"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

A source's target is met by whole passes over it and, for what remains, by the
documents whose hash lies below a threshold. The threshold is found on
histograms: words are summed by source and the hash's top bits, the bucket in
which the budget runs out is found on cumulative sums, and only that bucket
is summed again on finer bits, down to the whole hash. Nothing is sorted but
histograms. What the threshold leaves of the budget (less than one document) is
the budget of another, nested threshold over the documents that still fit.

Defined cases: a null text has no words; null is a source of its own, the last;
documents are dealt by id and text, so those of equal or null id part, and only rows that
repeat both are taken or left together; a source without words has target 0; a very long
text counts whole; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, maybe_broadcast, word_count

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: Bits of the 60-bit hash by which each level of the histogram is finer.
LEVELS = (12, 12, 36)
ROUNDS = 3
_BITS = 60
#: Sources (a row of some 100 bytes each) up to which their table is broadcast.
BROADCAST_SOURCES = 200_000


def _hash(doc_id: Column, text: Column) -> Column:
    """60 bits of a document's id and text."""
    own = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(own.cast("binary")), 1, 15), 16, 10).cast("long")


def _targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size)`` to targets: shares by weight, no source above ``CAP`` times its size."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") - 1) % len(WEIGHTS) + 1)
    rows = sizes.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", weight)
    rows = rows.withColumn("cap", F.lit(CAP) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    filling = Window.orderBy("ratio", "sid")
    everything = Window.partitionBy()
    rows = rows.select(
        "*",
        F.row_number().over(filling).alias("turn"),
        (F.sum("cap").over(filling) - F.col("cap")).alias("full_before"),
        (F.sum("weight").over(everything) - F.sum("weight").over(filling) + F.col("weight")).alias("weight_left"),
        F.sum("source_size").over(everything).alias("total"),
    )
    level = (F.lit(SHARE) * F.col("total") - F.col("full_before")) / F.col("weight_left")
    rows = rows.withColumn("level", level)
    settled = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("turn", "level"))).over(everything)
    rows = rows.withColumn("settled", settled)
    target = F.when(F.col("turn") < F.col("settled.turn"), F.col("cap").cast("double")).otherwise(F.col("settled.level") * F.col("weight"))
    rows = rows.withColumn("target", target)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return rows.select("sid", "source", "source_size", "target", passes.alias("passes"))


def _threshold(rows: DataFrame, budgets: DataFrame, n_sources: int) -> DataFrame:
    """``rows(sid, size, h)`` and ``budgets(sid, budget)`` to ``(sid, bound, spent)``.

    ``bound`` is the smallest hash at which the running sum exceeds the
    budget (null if it never does); ``spent`` is the sum below it.
    """
    state = budgets.select("sid", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("spent"), F.lit(True).alias("open"))
    shift, depth = _BITS, 0
    for bits in LEVELS:
        small = maybe_broadcast(state, n_sources, BROADCAST_SOURCES)
        inside = rows.join(small, "sid").where(F.col("open") & (F.shiftright("h", shift) == F.col("prefix")))
        shift -= bits
        depth += bits
        sums = inside.groupBy("sid", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        running = F.sum("n").over(Window.partitionBy("sid").orderBy("bucket"))
        levels = sums.select("sid", "bucket", "n", running.alias("upto"))
        levels = levels.join(maybe_broadcast(state.select("sid", "budget", F.col("spent").alias("before")), n_sources, BROADCAST_SOURCES), "sid")
        over = F.col("before") + F.col("upto") > F.col("budget")
        found = levels.groupBy("sid").agg(
            F.min(F.when(over, F.struct("bucket", (F.col("before") + F.col("upto") - F.col("n")).alias("spent")))).alias("edge"),
            F.max(F.col("before") + F.col("upto")).alias("all"),
        )
        state = state.join(found, "sid", "left").select(
            "sid",
            "budget",
            F.coalesce("edge.bucket", F.shiftleft("prefix", bits)).alias("prefix"),
            F.coalesce("edge.spent", F.when(F.col("open"), F.col("all")), F.col("spent")).alias("spent"),
            F.col("edge").isNotNull().alias("open"),
        )
        state = checkpointed(state)
    return state.select("sid", F.when(F.col("open"), F.col("prefix")).alias("bound"), "spent")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, int]:
    """The documents' ``(doc_id, source, size, h)``, each source's plan, and the number of sources."""
    raw = checkpointed(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), _hash(F.col(id_col), F.col(text_col)).alias("h"))
    )
    plan = checkpointed(_targets(raw.groupBy("source").agg(F.sum("size").alias("source_size"))))
    n = plan.count()
    slim = plan.select("sid", F.col("source").alias("name"))
    sized = raw.join(maybe_broadcast(slim, n, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("name"))).where("size > 0").select("sid", "size", "h")
    budgets = plan.select("sid", (F.col("target") - F.col("passes") * F.col("source_size")).alias("budget"))
    bounds = []
    for k in range(ROUNDS):
        left = sized
        for j, bound in enumerate(bounds):
            left = left.join(maybe_broadcast(bound, n, BROADCAST_SOURCES), "sid").where(~_taken(j)).drop(f"bound{j}", f"fit{j}")
        small = maybe_broadcast(budgets, n, BROADCAST_SOURCES)
        fits = left.join(small, "sid").where("size <= budget").drop("budget")
        found = _threshold(fits, budgets, n)
        bounds.append(
            checkpointed(budgets.join(found, "sid").select("sid", F.col("bound").alias(f"bound{k}"), F.col("budget").alias(f"fit{k}")))
        )
        budgets = checkpointed(budgets.join(found, "sid").select("sid", (F.col("budget") - F.col("spent")).alias("budget")))
    for bound in bounds:
        plan = plan.join(bound, "sid")
    return raw, checkpointed(plan), n


def _taken(k: int) -> Column:
    """Whether round ``k`` takes a document: it fits the budget and its hash lies below the bound."""
    return (F.col("size") <= F.col(f"fit{k}")) & F.coalesce(F.col("h") < F.col(f"bound{k}"), F.lit(True)) & (F.col("size") > 0)


def apply_plan(rows: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """``rows`` with ``source``, ``size`` and ``h`` to the same with ``source_size``, ``target`` and ``copies``."""
    named = maybe_broadcast(plan.withColumnRenamed("source", "name"), n_sources, BROADCAST_SOURCES)
    picked = F.lit(False)
    for k in range(ROUNDS):
        picked = picked | (~picked & _taken(k))
    copies = F.col("passes") + picked.cast("long")
    joined = rows.join(named, F.col("source").eqNullSafe(F.col("name")))
    return joined.select(*[F.col(c) for c in rows.columns], "source_size", "target", copies.alias("copies"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for each row of ``docs``."""
    raw, plan, n = mix_plan(docs, id_col, text_col, source_col)
    out = apply_plan(raw, plan, n)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; the texts are never shuffled."""
    _, plan, n = mix_plan(docs, id_col, text_col, source_col)
    keyed = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), _hash(F.col(id_col), F.col(text_col)).alias("h"))
    out = apply_plan(keyed, plan, n).where("copies > 0")
    return out.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


_ROUND = """
r{k} AS (
  SELECT sid, doc_id, size, h,
         sum(size) OVER (PARTITION BY sid ORDER BY h RANGE UNBOUNDED PRECEDING) <= budget AS took
  FROM (SELECT l.*, b.budget FROM l{k} l JOIN b{k} b USING (sid) WHERE l.size <= b.budget)
),
t{k} AS (SELECT sid, doc_id, size, h FROM r{k} WHERE took),
b{n} AS (SELECT b.sid, b.budget - coalesce((SELECT sum(size) FROM t{k} t WHERE t.sid = b.sid), 0) AS budget FROM b{k} b),
l{n} AS (SELECT l.* FROM l{k} l ANTI JOIN t{k} t ON t.sid = l.sid AND t.h = l.h),
"""
SQL = (
    r"""
WITH raw AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents
),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM raw GROUP BY 1),
named AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sizes),
weighed AS (
  SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM named
),
filling AS (
  SELECT *, cap::DOUBLE / weight AS ratio, row_number() OVER w AS turn, sum(cap) OVER w - cap AS full_before,
         sum(weight) OVER () - sum(weight) OVER w + weight AS weight_left, sum(source_size) OVER () AS total
  FROM weighed WINDOW w AS (ORDER BY cap::DOUBLE / weight, sid)
),
levels AS (SELECT *, (1.5::DOUBLE * total::DOUBLE - full_before::DOUBLE) / weight_left::DOUBLE AS level FROM filling),
settled AS (SELECT turn, level FROM levels WHERE level <= ratio ORDER BY turn LIMIT 1),
plan AS (
  SELECT l.sid, l.source, l.source_size,
         CASE WHEN l.turn < s.turn THEN l.cap::DOUBLE ELSE s.level * l.weight::DOUBLE END AS target
  FROM levels l, settled s
),
passed AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS passes FROM plan
),
l0 AS (SELECT p.sid, r.doc_id, r.size, r.h FROM raw r JOIN passed p ON r.source IS NOT DISTINCT FROM p.source WHERE r.size > 0),
b0 AS (SELECT sid, target - passes * source_size AS budget FROM passed),
"""
    + "".join(_ROUND.format(k=k, n=k + 1) for k in range(ROUNDS))
    + " picked AS ("
    + " UNION ALL ".join(f"SELECT sid, h FROM t{k}" for k in range(ROUNDS))
    + """)
SELECT r.doc_id, r.source, r.size, p.source_size, p.target,
       (r.size * (p.passes + CASE WHEN EXISTS (SELECT 1 FROM picked x WHERE x.sid = p.sid AND x.h = r.h AND r.size > 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM raw r JOIN passed p ON r.source IS NOT DISTINCT FROM p.source
"""
)

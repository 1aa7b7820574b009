"""Line dedup on overlapping windows of consecutive lines, in DataFrame operations only.

Each window of three lines is hashed to 128 bits; windows that occur more than
once anywhere are found by one grouped minimum, and every line that a
non-first occurrence covers is removed. The first occurrence is the one of the
smallest (doc_id, position), so reruns agree.

Defined cases: a null text stays null and an empty one empty; a text of fewer
lines than the window has no window; a window of blank lines only is never a
repeat; rows that repeat an id and text count as one document, so each keeps
what the others keep; null ids sort before all others; further columns are
kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

WINDOW = 3


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """``(h1, h2, at struct<id, print, pos>)`` for each window that is not blank."""

    def of(i: Column) -> Column:
        part = F.slice(F.col("lines"), i + 1, window)
        return F.struct(
            i.alias("pos"),
            F.xxhash64(part).alias("h1"),
            F.xxhash64(F.lit(window), F.reverse(part)).alias("h2"),
            (F.trim(F.array_join(part, "")) != "").alias("told"),
        )

    many = F.when(F.size("lines") >= window, F.sequence(F.lit(0), F.size("lines") - window))
    return (
        rows.select("id", "print", F.explode(F.transform(many, of)).alias("w"))
        .where("w.told")
        .select("w.h1", "w.h2", F.struct("id", "print", F.col("w.pos").alias("pos")).alias("at"))
    )


def line_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(id, print, covered array<int>)``: the lines of each document that later occurrences cover."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("print"), F.split(F.col(text_col), "\n", -1).alias("lines")
    )
    windows = _windows(rows, window)
    firsts = windows.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Written, so that the join below has a shuffle of its own on each side and a hot window's rows can be split.
    firsts = checkpointed(firsts.drop("n"))
    later = windows.join(firsts, ["h1", "h2"]).where(F.col("at") > F.col("first"))
    lines = later.select("at.id", "at.print", F.explode(F.sequence(F.col("at.pos"), F.col("at.pos") + window - 1)).alias("line"))
    return lines.groupBy("id", "print").agg(F.collect_set("line").alias("covered"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, report_col: str = "line_dedup") -> DataFrame:
    """All rows and columns of ``docs`` with repeated windows' lines cut from the text,
    and ``n_lines``, ``removed_lines`` (0 for a null text) in a struct ``report_col``,
    which takes the place of an input column of that name."""
    covered = line_repeats(docs, id_col, text_col, window)
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("print"))
    joined = packed.join(
        covered.select(F.col("id").alias("cid"), F.col("print").alias("cprint"), "covered"),
        F.col("id").eqNullSafe(F.col("cid")) & (F.col("print") == F.col("cprint")),
        "left",
    )
    # The lines are a column of their own: within the lambda below the text would be split again for each line.
    text = F.col("row").getField(text_col)
    split = joined.select("row", "covered", F.split(text, "\n", -1).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    cut = F.array_join(F.transform(left, lambda i: F.element_at("lines", i + 1)), "\n")
    new = F.when(F.col("covered").isNull(), text).otherwise(cut)
    report = F.struct(
        F.when(text.isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")).cast("long").alias("removed_lines"),
    )
    others = [new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c != report_col]
    return split.select(*others, report.alias(report_col))


SQL = """
WITH rows AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
windows AS (
  SELECT doc_id, p AS pos, lines[p] || chr(10) || lines[p + 1] || chr(10) || lines[p + 2] AS w
  FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines) - 2)) AS p FROM rows)
),
told AS (SELECT * FROM windows WHERE trim(replace(w, chr(10), '')) <> ''),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS r FROM told),
covered AS (SELECT DISTINCT doc_id, pos + d AS line FROM ranked, (VALUES (0), (1), (2)) v(d) WHERE r > 1),
each AS (SELECT doc_id, unnest(lines) AS l, unnest(generate_series(1, len(lines))) AS line FROM rows),
kept AS (
  SELECT e.doc_id, string_agg(e.l, chr(10) ORDER BY e.line) AS text
  FROM each e LEFT JOIN covered c ON c.doc_id = e.doc_id AND c.line = e.line
  WHERE c.line IS NULL GROUP BY 1
),
lost AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY 1)
SELECT r.doc_id, CASE WHEN r.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(len(r.lines), 0)::BIGINT AS n_lines, coalesce(l.n, 0)::BIGINT AS removed_lines
FROM rows r LEFT JOIN kept k USING (doc_id) LEFT JOIN lost l USING (doc_id)
"""

"""Texts to chunks: whole, in windows of fixed size, at line ends, or at blank lines."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..session import arrow_map


def whole_file(files: DataFrame) -> DataFrame:
    """``files(repo, path, lang, text)`` to one chunk each."""
    return files.select("repo", "path", "lang", F.lit(0).alias("ord"), F.lit(0).alias("start_char"), F.length("text").alias("end_char"), "text")


def fixed_windows(files: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Windows of ``size`` characters that begin every ``size - overlap``; the last one may be short."""
    if not 0 <= overlap < size:
        raise ValueError("an overlap is smaller than the window")
    step = size - overlap
    last = F.greatest(F.lit(0), F.length("text") - 1 - overlap)
    starts = F.sequence(F.lit(0), last - last % step, F.lit(step))
    rows = files.where(F.length("text") > 0).select("repo", "path", "lang", "text", F.posexplode(starts).alias("ord", "start_char"))
    return rows.select(
        "repo", "path", "lang", "ord", "start_char", F.least(F.col("start_char") + size, F.length("text")).alias("end_char"),
        F.substr("text", F.col("start_char") + 1, F.lit(size)).alias("text"),
    )


def cut_lines(text: str, size: int) -> list[tuple[int, int]]:
    """Character spans of whole lines of at most ``size`` characters together; a longer line is a chunk alone."""
    out, start, at = [], 0, 0
    for line in text.splitlines(keepends=True):
        if at > start and at + len(line) - start > size:
            out.append((start, at))
            start = at
        at += len(line)
    if at > start:
        out.append((start, at))
    return out


def cut_blocks(text: str, size: int) -> list[tuple[int, int]]:
    """Spans of blocks between blank lines, joined up to ``size`` characters."""
    spans, start, at, blank = [], 0, 0, False
    for line in text.splitlines(keepends=True):
        if blank and line.strip() and at > start:
            spans.append((start, at))
            start = at
        blank = not line.strip()
        at += len(line)
    if at > start:
        spans.append((start, at))
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and e - out[-1][0] <= size:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _line_ends(raw: bytes) -> list[int]:
    return [m.end() for m in re.finditer(rb"\r\n|\r|\n", raw)]


def byte_windows(text: str, size: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Byte spans of windows that begin every ``size - overlap`` bytes (at the next whole character) and reach to the end of
    the line in which ``size`` bytes end (at the last whole character). The window that reaches the text's end is the last."""
    if not 0 <= overlap < size:
        raise ValueError("an overlap is smaller than the window")
    raw = text.encode("utf-8", "surrogatepass")
    n, ends = len(raw), _line_ends(raw)

    def inside(at: int) -> bool:
        return at < n and raw[at] & 0xC0 == 0x80

    out, start = [], 0
    while start < n:
        reach = min(start + size, n)
        while reach > start and inside(reach):
            reach -= 1
        line = bisect_right(ends, min(reach, n - 1))
        end = ends[line] if line < len(ends) else n
        out.append((start, end))
        if end >= n:
            break
        start += size - overlap
        while inside(start):
            start += 1
    return out


#: Characters of text in a batch that Python gives back; one longer chunk is a batch of its own.
OUT_CHARS = 4 << 20


def _cut_files(files: DataFrame, each: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    """``each`` of a file's text, as rows ``(ord, ..., text, ...)`` after the file's repository, path and language.

    A file at a time, in batches of bounded size both ways.
    """

    def run(batches):
        names, out, size = pa.schema([(c.name, to_arrow_type(c.dataType)) for c in kinds]), [], 0
        for batch in batches:
            for repo, path, lang, text in zip(*(_values(c) for c in batch.columns), strict=True):
                for row in each(text):
                    out.append((repo, path, lang, *row))
                    size += 100 + max(len(x) for x in row if isinstance(x, str))
                    if size >= OUT_CHARS:
                        yield _batch(out, names)
                        out, size = [], 0
        if out:
            yield _batch(out, names)

    kinds = StructType.fromDDL(schema).fields
    return arrow_map(files.select("repo", "path", "lang", "text"), run, schema)


def _values(column: pa.Array) -> Iterator:
    """One value at a time, so that a batch's texts are not all copied."""
    return (x.as_py() for x in column)


def _batch(rows: list[tuple], names: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, c.type) for x, c in zip(zip(*rows, strict=True), names, strict=True)], schema=names)


def line_windows(files: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """``byte_windows`` of each file, with bytes, lines and text."""

    def each(text):
        raw = (text or "").encode("utf-8", "surrogatepass")
        ends = _line_ends(raw)
        for i, (s, e) in enumerate(byte_windows(text or "", size, overlap)):
            yield i, s, e, raw[s:e].decode("utf-8", "replace"), bisect_right(ends, s) + 1, bisect_right(ends, e - 1) + 1

    return _cut_files(files, each, "repo string, path string, lang string, ord int, start_byte int, end_byte int, text string, start_line int, end_line int")


def cut(files: DataFrame, size: int, how: str = "lines") -> DataFrame:
    """Line-aligned or block-aligned chunks, a file at a time."""
    cutter = {"lines": cut_lines, "blocks": cut_blocks}[how]

    def each(text):
        for i, (s, e) in enumerate(cutter(text or "", size)):
            yield i, s, e, text[s:e], text.count("\n", 0, s) + 1, text.count("\n", 0, max(s, e - 1)) + 1

    return _cut_files(files, each, "repo string, path string, lang string, ord int, start_char int, end_char int, text string, start_line int, end_line int")


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """Ids that depend on the place and the text only, so a rerun gives the same."""
    identity: Column = F.sha2(F.concat_ws("\0", "repo", "path", "ord", "text"), 256)
    return chunks.withColumn("candidate_id", identity)

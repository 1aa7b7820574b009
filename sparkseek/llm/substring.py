"""Substring dedup by sliding spans of sentences.

From every sentence a span runs over the next ones, and another over the ones
before it, until it has at least ``MIN_SENTENCES`` sentences and ``MIN_WORDS``
words: so the spans inside a run of so many sentences and words cover all of it.
A single sentence of ``LONG_SENTENCE`` words is a span by itself. Spans are hashed to 128 bits and
joined globally; sentences that a non-first occurrence covers are removed. The
first occurrence has the smallest (doc_id, position).

A span's extent depends on its own words only, so a passage that two documents
share yields the same spans in both, whatever stands around it.

Defined cases: null texts are empty; fewer words than a span make no span;
rows that repeat an id and text count as one document; null ids sort before
all others; an empty table gives an empty result; of a very long text all sentences are
in memory at once, several times its size; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed

MIN_SENTENCES, MIN_WORDS, LONG_SENTENCE = 2, 8, 25
_END = re.compile(r"[.!?]+(?=\s|$)\s*|\s*\n\s*")


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence, the space after it included."""
    out, at = [], 0
    for m in _END.finditer(text):
        if m.end() > at:
            out.append((at, m.end()))
            at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def spans(text: str, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, long_sentence: int = LONG_SENTENCE) -> Iterator[tuple[int, int, int, int]]:
    """``(hash 1, hash 2, start, end)`` of each span, hashes of its lower-cased words."""
    import xxhash

    cuts = sentences(text)
    words = [text[s:e].lower().split() for s, e in cuts]
    sizes = [len(w) for w in words]
    joined = [" ".join(w).encode("utf-8", "surrogatepass") for w in words]
    n, j, total = len(cuts), 0, 0
    runs: set[tuple[int, int]] = set()
    for i in range(n):
        if sizes[i] >= long_sentence:
            runs.add((i, i + 1))
        while j < n and (j - i < min_sentences or total < min_words):
            total += sizes[j]
            j += 1
        if j - i >= min_sentences and total >= min_words:
            runs.add((i, j))
        total -= sizes[i]
    i, total = n, 0
    for j in range(n, 0, -1):
        while i > 0 and (j - i < min_sentences or total < min_words):
            i -= 1
            total += sizes[i]
        if j - i >= min_sentences and total >= min_words:
            runs.add((i, j))
        total -= sizes[j - 1]
    for i, j in sorted(runs):
        x = xxhash.xxh3_128_intdigest(b"\n".join(joined[i:j]))
        yield x >> 64, x & 0xFFFFFFFFFFFFFFFF, cuts[i][0], cuts[j - 1][1]


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _span_rows(batches):
    for batch in batches:
        got: list[list] = [[], [], [], []]
        counts = []
        for text in batch.column(2):
            before = len(got[0])
            for row in spans(text.as_py() or ""):
                for column, x in zip(got, row, strict=True):
                    column.append(x)
            counts.append(len(got[0]) - before)
        at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
        hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in got[:2]]
        places = [pa.array(np.array(x, np.int32)) for x in got[2:]]
        yield pa.RecordBatch.from_arrays(
            [*hashes, batch.column(0).take(at), batch.column(1).take(at), *places], ["h1", "h2", "id", "print", "s", "e"]
        )


def _cut(batches):
    for batch in batches:
        text, removed, chars, spans_out = [], [], [], []
        for t, cover in zip(batch.column("text"), batch.column("cover"), strict=True):
            t, cover = t.as_py(), cover.as_py()
            if not cover:
                text.append(t)
                removed.append(0)
                chars.append(0)
                spans_out.append([])
                continue
            gone = merged([(x["s"], x["e"]) for x in cover])
            starts = [s for s, _ in sentences(t)]
            text.append("".join(t[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(t)], strict=True)))
            removed.append(int(sum(np.searchsorted(starts, e) - np.searchsorted(starts, s) for s, e in gone)))
            chars.append(sum(e - s for s, e in gone))
            spans_out.append([{"s": s, "e": e} for s, e in gone])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(text, pa.string()), pa.array(removed, pa.int32()), pa.array(chars, pa.int64()),
             pa.array(spans_out, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))],
            ["doc_id", "text", "removed_sentences", "removed_chars", "removed_spans"],
        )


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, removed_sentences, removed_chars, removed_spans)`` of each row:
    the text that is left, and the code-point spans that were cut."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("print"), F.col(text_col).cast("string").alias("text")
    )
    found = arrow_map(rows, _span_rows, "h1 long, h2 long, id long, print long, s int, e int")
    place = F.struct("id", "print", "s")
    firsts = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Written, so that the join below has a shuffle of its own on each side and a hot span's rows can be split.
    firsts = checkpointed(firsts.drop("n"))
    later = found.join(firsts, ["h1", "h2"]).where(place > F.col("first"))
    cover = later.groupBy("id", "print").agg(F.collect_set(F.struct("s", "e")).alias("cover"))
    joined = rows.join(
        cover.select(F.col("id").alias("cid"), F.col("print").alias("cprint"), "cover"),
        F.col("id").eqNullSafe(F.col("cid")) & (F.col("print") == F.col("cprint")),
        "left",
    )
    return arrow_map(
        joined.select("id", "text", "cover"),
        _cut, "doc_id long, text string, removed_sentences int, removed_chars long, removed_spans array<struct<s:int,e:int>>",
    )

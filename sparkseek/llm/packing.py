"""Conflict-constrained best-fit packing of documents into bins of fixed size.

Documents are dealt into shards of bounded size by hash; within a shard they
are placed in descending order of size. Open bins are kept in order of what they have
left; each carries a bitmap of its sources and one of its duplicate clusters. A
document goes to the tightest bin that it fits and that has neither its source
nor its cluster: the search starts at the first bin with room enough and goes
on to its successors until one is compatible. A document longer than a bin
fills bins of its own and only its remainder is packed with others.

Defined cases: a document without words (null or empty text) takes no bin: its
``bin_id`` is null; a null source or cluster is a value like any other; repeated rows are
separate copies of one cluster; documents of one id and size follow one another by source
and cluster; a very long text fills bins of its own; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, word_count

CAPACITY = 2048
#: Documents in a shard, about, and the most partitions that shards are dealt to.
SHARD_ROWS, MOST_PARTITIONS = 4096, 4000


def pack(items: list[tuple[int, int, int | None]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """``(size, source, cluster)`` in order of placement to ``(item, piece, words, bin)``.

    Sources and clusters are small numbers, the positions of their bits; no cluster is
    None.
    """
    left: list[tuple[int, int]] = []  # (what is left, bin), in order
    sources: dict[int, int] = {}
    clusters: dict[int, int] = {}
    out, n = [], 0
    for at, (size, source, cluster) in enumerate(items):
        piece = 0
        while size > capacity:
            out.append((at, piece, capacity, n))
            n, piece, size = n + 1, piece + 1, size - capacity
        if not size:
            continue
        s, c = 1 << source, 0 if cluster is None else 1 << cluster
        i = bisect_left(left, (size, -1))
        while i < len(left) and (sources[left[i][1]] & s or clusters[left[i][1]] & c):
            i += 1
        if i < len(left):
            room, b = left.pop(i)
        else:
            room, b, n = capacity, n, n + 1
            sources[b] = clusters[b] = 0
        sources[b] |= s
        clusters[b] |= c
        if room > size:
            insort(left, (room - size, b))
        out.append((at, piece, size, b))
    return out


def _pack_shards(capacity: int):
    schema = ["doc_id", "copy", "piece", "words", "bin_id", "bin_words", "bin_documents"]

    def of(shard: int, rows: list[tuple]) -> pa.RecordBatch:
        # Rows that agree in all of this have the same columns throughout, but for the number of the copy, which is last.
        rows.sort(key=lambda r: (-r[1], r[0] is None, r[0] or 0, r[2] is None, r[2] or "", r[3] is None, r[3] or 0, r[4]))
        source: dict = {}
        shared: dict = {}
        for r in rows:
            shared[r[3]] = shared.get(r[3], 0) + 1
        bits: dict = {}
        items = [
            (r[1], source.setdefault(r[2], len(source)), bits.setdefault(r[3], len(bits)) if shared[r[3]] > 1 else None)
            for r in rows
        ]
        placed = pack(items, capacity)
        words: dict[int, int] = {}
        documents: dict[int, int] = {}
        for _, _, w, b in placed:
            words[b] = words.get(b, 0) + w
            documents[b] = documents.get(b, 0) + 1
        empty = [(r[0], r[4], 0, 0, None, 0, 0) for r in rows if not r[1]]
        full = [(rows[i][0], rows[i][4], p, w, (shard << 32) | b, words[b], documents[b]) for i, p, w, b in placed]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*(empty + full), strict=True), kinds, strict=True)], schema)

    def run(batches):
        shard, rows = None, []
        for batch in batches:
            for s, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    if rows:
                        yield of(shard, rows)
                    shard, rows = s, []
                rows.append(tuple(row))
        if rows:
            yield of(shard, rows)

    return run


def best_fit_packing(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    cluster: Column | None = None, capacity: int = CAPACITY,
) -> DataFrame:
    """``(doc_id, copy, piece, words, bin_id, bin_words, bin_documents)``: a row for each piece of each document.

    No bin holds two pieces of one source or of one cluster. By default texts
    that agree but for the case of letters and the space around words are a
    cluster.
    """
    text = F.col(text_col)
    same = F.xxhash64(F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))) if cluster is None else cluster
    items = docs.select(F.col(id_col).cast("long").alias("doc_id"), word_count(text).alias("size"), F.col(source_col).cast("string").alias("source"), same.alias("cluster"))
    copies = items.groupBy("doc_id", "size", "source", "cluster").agg(F.count(F.lit(1)).alias("n"))
    each = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
    shards = max(1, -(-docs.select(F.lit(1)).count() // SHARD_ROWS))
    dealt = each.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "cluster"), F.lit(shards)))
    dealt = dealt.repartition(min(shards, MOST_PARTITIONS), "shard").sortWithinPartitions("shard")
    return arrow_map(
        dealt.select("shard", "doc_id", "size", "source", "cluster", "copy"),
        _pack_shards(capacity), "doc_id long, copy long, piece int, words long, bin_id long, bin_words long, bin_documents int",
    )

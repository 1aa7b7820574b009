"""SpotSigs fingerprints: chains of content words that follow common words.

Every common word of the text is an anchor; the anchor and the next ``CHAIN``
content words form a signature of 32 bits. The set of a text's signatures,
sorted and written as hexadecimal digits, is its fingerprint, and two texts are
alike as their sets are by Jaccard.

Defined cases: a null text is empty; an empty text has the empty fingerprint
and likeness 1 to itself, 0 to others; a text without a whole chain has the
signatures of its neighbouring words, of its one word, or of the whole text if
it has no word, so equal texts always have equal fingerprints; documents of
equal id follow one another by text; a null id is the smallest; the only
document is its own next; an empty table gives an empty result; a very long text is cut at
white space into parts whose chains run on from one to the next; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed

CHAIN = 2
ANCHORS = frozenset(
    "a an and are as at be by for from had has have he her his i in is it its not of on or that the their there they this to was were which with you "
    "au aux ce ces dans de des du elle en est et il la le les leur ne ou par pas pour que qui sa se son sur un une vous "
    "aber auch auf das dem den der des die ein eine einer er es für im ist mit nicht sich sie sind und von war wie zu zum zur über "
    "al como con del el ella era las los lo más no para pero por su sus una y".split()
)
_WORD = re.compile(r"\w+")
_GAP = re.compile(r"\s")
_SLAB = 1 << 21
#: Documents a range of ids holds, about, and the most and fewest ranges there are; so many ranges meet in a
#: partition that chance and some very long texts even out.
RANGE_ROWS, MOST_RANGES, LEAST_RANGES, RANGES_TOGETHER = 512, 20_000, 512, 8


def _slabs(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = min(at + _SLAB, len(text))
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def signatures(text: str, chain: int = CHAIN, anchors: frozenset = ANCHORS) -> np.ndarray:
    """The sorted distinct signatures of a whole text."""
    crc, out = zlib.crc32, set()
    content: list[str] = []
    waiting: list[tuple[str, int]] = []
    first_words: list[str] = []
    for slab in _slabs(text.lower()):
        words = _WORD.findall(slab)
        if not out and len(first_words) < 2:
            first_words += words[:2]
        n = len(content)
        for w in words:
            if w in anchors:
                waiting.append((w, n))
            else:
                content.append(w)
                n += 1
        ready = len(waiting)
        while ready and waiting[ready - 1][1] + chain > n:
            ready -= 1
        out.update(crc(" ".join([a, *content[c : c + chain]]).encode()) for a, c in waiting[:ready])
        waiting = waiting[ready:]
        base = waiting[0][1] if waiting else n
        content = content[base:]
        waiting = [(a, c - base) for a, c in waiting]
    if not out:
        previous = None
        for slab in _slabs(text.lower()):
            for w in _WORD.findall(slab):
                if previous is not None:
                    out.add(crc(f"\0 {previous} {w}".encode()))
                previous = w
        if not out and (previous or text):
            out.add(crc(("\1" + (previous or text)).encode("utf-8", "surrogatepass")))
    return np.sort(np.fromiter(out, np.uint32, len(out)))


def fingerprint_text(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two sorted sets; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _string(x: pa.Scalar) -> str:
    return x.as_buffer().to_pybytes().decode("utf-8", "replace") if x.is_valid else ""


class _Shown:
    """One document with what is computed of it once."""

    __slots__ = ("doc_id", "text", "sigs")

    def __init__(self, doc_id, text):
        self.doc_id, self.text, self.sigs = doc_id, text, signatures(text)

    def row(self, following: _Shown):
        text, other = self.text, following.text
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        sigs = signatures(edited)
        return (
            self.doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint_text(self.sigs),
            fingerprint_text(sigs), jaccard(self.sigs, sigs), jaccard(self.sigs, following.sigs),
        )


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _walk(batches):
    """Rows sorted by range, then the range's own rows, then the first of the next one."""
    last: _Shown | None = None
    at = None
    for batch in batches:
        rows: list[tuple] = []
        for where, tail, doc_id, text in zip(*(batch.column(i) for i in range(4)), strict=True):
            where = where.as_py()
            if where != at:
                last, at = None, where
            elif last is None:
                continue  # further rows of the next range
            now = _Shown(doc_id.as_py(), _string(text))
            if last is not None:
                rows.append(last.row(now))
            last = None if tail.as_py() else now
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, with the likenesses.

    The edited form of a document ends in the beginning of the next one by
    descending id. Ids are cut into ranges at ids that occur; each text is
    shuffled once, to its range, and the first document of a range also to the
    range before, which needs it as its end.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(key.alias("key"))
    n = ids.count()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, n // RANGE_ROWS))
    cuts = F.percentile_approx("key", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), max(10_000, 10 * ranges))
    row = ids.agg(F.max("key").alias("most"), cuts.alias("cuts")).first()
    bounds = sorted({row["most"], *(row["cuts"] or [])} - {None}, reverse=True)
    width = 128
    fine = F.lit(bounds).cast("array<bigint>")
    coarse = F.lit(bounds[::width]).cast("array<bigint>")
    block = F.size(F.filter(coarse, lambda b: b >= F.col("key"))) - 1
    inside = F.size(F.filter(F.slice(fine, F.col("block") * width + 1, width), lambda b: b >= F.col("key"))) - 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("block", block).withColumn("at", F.col("block") * width + inside)
    first = F.element_at(fine, F.col("at") + 1) == F.col("key")
    before = F.pmod(F.col("at") - 1, F.lit(max(1, len(bounds))))
    own = F.struct(F.col("at").alias("at"), F.lit(0).alias("tail"))
    places = F.when(first, F.array(own, F.struct(before.alias("at"), F.lit(1).alias("tail")))).otherwise(F.array(own))
    dealt = rows.select(F.explode(places).alias("place"), "key", "doc_id", "text").select("place.at", "place.tail", "key", "doc_id", "text")
    dealt = dealt.repartition(max(1, len(bounds) // RANGES_TOGETHER), "at").sortWithinPartitions("at", "tail", F.col("key").desc(), "text")
    return arrow_map(
        dealt.select("at", "tail", "doc_id", "text"),
        _walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def _partitions(size, tau: float):
    """Number of the length partition: sets of one pair lie in one or in neighbouring partitions."""
    return F.floor(F.log(size) / F.lit(float(-np.log(tau))))


def spotsigs_pairs(docs: DataFrame, tau: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``pairs(a, b, similarity)`` of class representatives alike by ``tau`` or more, and ``classes(doc_id, class_id)``.

    Equal signature sets form a class, named by its smallest id. Representatives
    meet on a signature of their prefix (their rarest ones: at ``tau`` two sets
    must share one) within a length partition or its neighbour; pairs whose
    lengths rule ``tau`` out are pruned before the sets are compared.
    """

    def run(batches):
        for batch in batches:
            sets = [signatures(_string(t)).astype(np.int64).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "sigs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    rows = checkpointed(arrow_map(rows, run, "doc_id long, sigs array<long>"))
    name = F.sha2(F.concat_ws(",", F.transform("sigs", lambda x: x.cast("string"))), 256)
    named = rows.select("doc_id", name.alias("name"), "sigs")
    reps = checkpointed(named.groupBy("name").agg(F.min("doc_id").alias("rep"), F.first("sigs").alias("sigs")))
    classes = named.select("doc_id", "name").join(reps.select("name", F.col("rep").alias("class_id")), "name").drop("name")
    sized = reps.select("rep", "sigs", F.size("sigs").alias("n")).where("n > 0")
    terms = sized.select("rep", "n", F.explode("sigs").alias("sig"))
    frequency = terms.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    rare = F.row_number().over(Window.partitionBy("rep").orderBy("df", "sig"))
    prefix = terms.join(frequency.where("df > 1"), "sig").withColumn("turn", rare)
    spare = terms.join(frequency.where("df = 1"), "sig").groupBy("rep").agg(F.count(F.lit(1)).alias("spare"))
    prefix = prefix.join(spare, "rep", "left").withColumn("turn", F.col("turn") + F.coalesce("spare", F.lit(0)))
    prefix = prefix.where(F.col("turn") <= F.col("n") - F.ceil(F.lit(tau) * F.col("n") - 1e-9) + 1)
    part = _partitions(F.col("n"), tau)
    left = prefix.select("sig", F.col("rep").alias("a"), F.col("n").alias("na"), part.alias("part"))
    right = prefix.select("sig", F.col("rep").alias("b"), F.col("n").alias("nb"), F.explode(F.array(part, part - 1, part + 1)).alias("part"))
    near = (F.col("na") <= F.col("nb") / tau + 1e-9) & (F.col("nb") <= F.col("na") / tau + 1e-9)
    candidates = left.join(right, ["sig", "part"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    sets = sized.select("rep", "sigs", "n")
    pairs = (
        candidates.join(sets.toDF("a", "sa", "na"), "a").join(sets.toDF("b", "sb", "nb"), "b")
        .withColumn("both", F.size(F.array_intersect("sa", "sb")))
        .select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("similarity"))
        .where(F.col("similarity") >= tau)
    )
    return pairs, classes

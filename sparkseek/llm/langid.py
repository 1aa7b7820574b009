"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1; a trigram is the product of
its letters' vectors, rotated by 2, 1 and 0 places; a text is the sum of its
trigrams and a language the sum of its texts' directions. A text gets the
language of the nearest profile by cosine.

Profiles are sums of integers, so they do not depend on the partitioning. They are
learnt from at most ``SAMPLE`` texts of each language, those whose hash lies below
a bound.

Defined cases: a text that is null or has no letters is ``und`` with score 0;
without learnt languages so are all; a text of one or two letters has its
trigrams with the space around it; an empty table gives an empty result; repeated
rows are predicted alike; equal cosines go to the name that sorts first; a very long
text is counted in pieces that overlap, so that each trigram counts once, with memory
that grows beyond the text itself neither with its length nor with its alphabet;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, maybe_broadcast

DIMENSIONS, SEED = 512, 20
#: Largest number of texts of one language that its profile is learnt from (about; by hash).
SAMPLE = 4000
#: Languages up to which their counts are broadcast.
BROADCAST_LANGUAGES = 100_000
_UNIT = 1 << 20
#: Letters that are counted at once, rows whose sums are held at once, and cells of a block of trigrams by rows.
_PIECE, _ROWS, _BLOCK = 1 << 17, 512, 1 << 20
#: Trigrams whose vectors are held at once: 2 MB for each of the few arrays of them.
_GRAMS = 1024


@functools.cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each code point: the bits of a mixed counter, so that none has to be remembered."""
    words = DIMENSIONS // 64
    x = codes.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(1, words + 1, dtype=np.uint64) + np.uint64(SEED << 32)
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.unpackbits(x.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def _short(texts: list[str], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of whole texts, each run of others a space, and a space around the text; and the row of each."""
    padded = [f" {t} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(rows, [len(t) for t in padded])
    letter = _is_letter()[codes]
    begin = np.ones(len(doc), bool)
    begin[1:] = doc[1:] != doc[:-1]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep |= begin
    return np.where(letter, codes, 32)[keep], doc[keep]


def _long(text: str) -> Iterator[np.ndarray]:
    """The same of one long text, in pieces that begin with the last two of the piece before: no trigram is lost."""
    tail, after = np.array([32], np.uint32), False
    for s in range(0, len(text), _PIECE):
        codes = np.frombuffer((text[s : s + _PIECE] + (" " if s + _PIECE >= len(text) else "")).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= after
        shown = np.concatenate([tail, np.where(letter, codes, 32)[keep]])
        yield shown
        tail, after = shown[-2:], bool(letter[-1])


def _vectors(codes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums of the trigram vectors of texts, added up by row; without letters, zeros."""
    out = np.zeros((n, DIMENSIONS))
    if len(codes) < 3:
        return out
    letter = codes != 32
    whole = (doc[2:] == doc[:-2]) & (letter[2:] | letter[1:-1] | letter[:-2])
    x = codes.astype(np.uint64)
    key = ((x[:-2] << np.uint64(42)) | (x[1:-1] << np.uint64(21)) | x[2:])[whole]
    of = doc[2:][whole]
    if not len(key):
        return out
    order = np.argsort(key, kind="stable")
    key, of = key[order], of[order]
    change = np.ones(len(key), bool)
    change[1:] = key[1:] != key[:-1]
    starts = np.append(np.flatnonzero(change), len(key))
    present = key[change]
    step = max(1, min(_GRAMS, _BLOCK // n))
    for s in range(0, len(present), step):
        part = present[s : s + step]
        lo, hi = starts[s], starts[min(s + step, len(present))]
        letters = np.stack([part >> np.uint64(42), (part >> np.uint64(21)) & np.uint64(0x1FFFFF), part & np.uint64(0x1FFFFF)])
        used, at = np.unique(letters, return_inverse=True)
        table, at = letter_vectors(used), at.reshape(3, -1)
        grams = np.roll(table, 2, axis=1)[at[0]]
        grams *= np.roll(table, 1, axis=1)[at[1]]
        grams *= table[at[2]]
        local = np.repeat(np.arange(len(part)), np.diff(np.append(starts[s : s + len(part)], hi)))
        counts = np.bincount(of[lo:hi] * len(part) + local, minlength=n * len(part)).reshape(n, len(part))
        out += counts.astype(np.float32) @ grams
    return out


def text_vectors(texts: list[str | None]) -> np.ndarray:
    """A row for each text; whole texts, in pieces of bounded size."""
    out = np.zeros((len(texts), DIMENSIONS))
    pieces: list[str] = []
    rows: list[int] = []
    size = 0

    def flush():
        nonlocal pieces, rows, size
        if pieces:
            out[rows] = _vectors(*_short(pieces, np.arange(len(rows))), len(rows))
        pieces, rows, size = [], [], 0

    for i, text in enumerate(texts):
        text = (text or "").lower()
        if len(text) > _PIECE:
            for codes in _long(text):
                out[i] += _vectors(codes, np.zeros(len(codes), np.int64), 1)[0]
        elif text:
            pieces.append(text)
            rows.append(i)
            size += len(text)
            if size >= _PIECE:
                flush()
    flush()
    return out


def _directions(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    return vectors / np.where(norm > 0, norm, 1)


def _strings(column: pa.Array) -> list[str | None]:
    return [x.as_buffer().to_pybytes().decode("utf-8", "replace") if x.is_valid else None for x in column.cast(pa.large_binary())]


def learn_profiles(docs: DataFrame, learns: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Language to profile, from the rows on which ``learns`` holds."""
    told = docs.where(learns & F.col(lang_col).isNotNull())
    counts = told.groupBy(F.col(lang_col).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    bound = (F.lit(float(sample)) / F.col("n") * F.lit(float(_UNIT))).cast("long")
    counts = counts.select("name", bound.alias("bound"))
    n = counts.count()
    chosen = told.select(F.col(lang_col).alias("name"), F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(_UNIT)).alias("h"))
    chosen = chosen.join(maybe_broadcast(counts, n, BROADCAST_LANGUAGES), "name").where("h < bound").select("name", "text")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for s in range(0, batch.num_rows, _ROWS):
                names = np.array(batch.column(0)[s : s + _ROWS].to_pylist(), object)
                vectors = np.rint(_directions(text_vectors(_strings(batch.column(1)[s : s + _ROWS]))) * _UNIT).astype(np.int64)
                for name in set(names):
                    sums[name] = sums.get(name, 0) + vectors[names == name].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], ["name", "v"])

    parts = arrow_map(chosen, run, "name string, v array<long>")
    sums = parts.select("name", F.posexplode("v").alias("i", "x")).groupBy("name", "i").agg(F.sum("x").alias("x"))
    profiles: dict[str, np.ndarray] = {}
    for name, i, x in sums.toArrow().to_pandas().itertuples(index=False):
        profiles.setdefault(name, np.zeros(DIMENSIONS))[i] = x
    return {k: v for k, v in sorted(profiles.items()) if np.any(v)}


def predict_languages(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, lang_pred, score)`` for each row; the score is the cosine, 0 at least."""
    names = np.array([*profiles, "und"], object)
    matrix = _directions(np.stack(list(profiles.values()))).T if profiles else np.zeros((DIMENSIONS, 0))

    def run(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(s, _ROWS)
                vectors = _directions(text_vectors(_strings(batch.column(1))))
                cosine = np.c_[vectors @ matrix, np.full(len(vectors), -2.0)]
                best = cosine.argmax(axis=1)
                best[~vectors.any(axis=1)] = len(names) - 1
                score = np.where(best < len(names) - 1, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, lang_pred string, score double")

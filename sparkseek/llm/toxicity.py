"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over a text's words and how they begin is trained with numpy from
confirmed toxic examples and unlabelled texts. The risk is that of positives,
weighted by the class prior, plus that of unlabelled texts as negatives less what
positives among them add; where that difference falls below zero the step goes
the other way, so that the classifier cannot profit from fitting noise.

The unlabelled texts are drawn from all documents that may be learnt from, the
labelled ones with their labels hidden among them: so the share of toxic texts is
the prior, and no class has to be corrected for rows that were taken out.

A word or beginning is a feature if it is at least ``LIFT`` times as frequent among
positives and a likelihood ratio test tells the two rates apart; near copies of a
text are one text in these counts. Weights start at the prior-corrected log odds
of a feature, are drawn back towards them, and are never negative: a feature can
only speak for toxicity, so one sure word in a long text is not outvoted.

Training uses at most ``POSITIVES`` labelled and ``UNLABELLED`` further rows, those of
the smallest hashes: at 20,000 rows a feature's rate is known to within 0.35 of a
hundredth, whatever the corpus' size. All else reads all rows and whole texts.

Defined cases: a null text is empty; a text without features, the empty one among
them, has the score of the intercept; without positive examples, in an empty table too,
every score is 0; a document that is labelled twice is toxic if any label says so;
repeated rows are scored alike; a very long text is cut at white space into parts whose
words are gathered; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed, hash_sample

#: Bounds on the training rows.
POSITIVES, UNLABELLED = 3000, 20_000
#: A feature is in so many texts and positives at least, so many times as frequent among positives, and its
#: likelihood ratio is beyond ``STRICTNESS`` times what the best of so many chance features would reach.
LEAST_TEXTS, LEAST_POSITIVES, LIFT, STRICTNESS = 4, 3, 2.0, 0.6
#: Features that are kept at most, those of the largest likelihood ratios.
FEATURES = 20_000
#: Partitions of the training texts, which are read several times.
SPREAD = 32
EPOCHS, RATE, DECAY = 100, 0.02, 2e-3
#: Letters of a longer word's beginnings, features of their own: inflected and compounded words share them.
PREFIXES = range(3, 10)
_WORD = re.compile(r"\w+")
_SLAB = 1 << 21
#: Longer words are features by digest; words whose features a worker remembers; counts that it gathers.
_LONG, _REMEMBERED, _GATHER = 64, 100_000, 200_000


def words(text: str) -> set[str]:
    """The distinct lower-cased words of a whole text."""
    out: set[str] = set()
    for part in _parts(text):
        out.update(_WORD.findall(part.lower()))
    return out


def features(word: str) -> list[str]:
    """A word itself and how it begins, marked by a star."""
    own = word if len(word) <= _LONG else hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest() + "#"
    return [own, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def _parts(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = min(at + _SLAB, len(text))
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


def _string(x: pa.Scalar) -> str:
    return x.as_buffer().to_pybytes().decode("utf-8", "replace") if x.is_valid else ""


def _mark(text: str) -> int:
    """The least hash of the text's runs of three words: near copies mostly share it."""
    least, tail = 1 << 40, []
    for part in _parts(text):
        run = tail + _WORD.findall(part.lower())
        for x in zip(run, run[1:], run[2:]):  # noqa: B905
            h = zlib.crc32(" ".join(x).encode("utf-8", "surrogatepass"))
            if h < least:
                least = h
        tail = run[-2:]
    return least if least < 1 << 40 else (1 << 41) + zlib.crc32(" ".join(tail).encode("utf-8", "surrogatepass"))


class Linear:
    """Weights by feature; the score is the logistic of their sum over a text's distinct features."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._known: dict[str, tuple[str, ...]] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "_known": {}}

    def present(self, text: str) -> set[str]:
        """The weighted features of a text."""
        known, found = self._known, set()
        for w in words(text):
            own = known.get(w)
            if own is None:
                if len(known) >= _REMEMBERED:
                    known.clear()
                own = known[w] = tuple(f for f in features(w) if f in self.weights)
            if own:
                found.update(own)
        return found

    def score(self, text: str) -> float:
        total = self.bias + sum(sorted(self.weights[f] for f in self.present(text)))
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def fit_nnpu(rows: list[list[int]], positive: np.ndarray, n_features: int, prior: float, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Non-negative PU risk with the sigmoid loss, minimised by full-batch Adam over non-negative weights."""
    sizes = np.array([len(r) for r in rows], np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    column = np.fromiter((c for r in rows for c in r), np.int64, int(sizes.sum()))
    pos, unl = positive, ~positive
    np_, nu = int(pos.sum()), int(unl.sum())
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    b = float(np.log(prior / (1 - prior)))
    if not np_ or not nu:
        return np.zeros(n_features), b
    among = np.bincount(column, pos[row], minlength=n_features)
    beside = np.bincount(column, unl[row], minlength=n_features)
    clean = np.maximum((beside / nu - prior * among / np_) / (1 - prior), 0) + 0.5 / nu
    start = np.maximum(np.log((among + 0.5) / (np_ + 1) / clean), 0)
    w = start.copy()
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, epochs + 1):
        z = b + np.bincount(row, w[column], minlength=len(rows))
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        slope = s * (1 - s)
        negative = s[unl].mean() - prior * s[pos].mean()  # risk of unlabelled as negatives, less that of positives
        g = np.zeros(len(rows))
        if negative >= 0:
            g[pos] = -2 * prior * slope[pos] / np_
            g[unl] = slope[unl] / nu
        else:
            g[unl] = -slope[unl] / nu
            g[pos] = prior * slope[pos] / np_
        grad = np.append(np.bincount(column, g[row], minlength=n_features) + DECAY * prior * (w - start), g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = np.maximum(w - step[:-1], 0), float(b - step[-1])
    return w, b


def _training_texts(docs: DataFrame, told: DataFrame, learns: Column, id_col: str, text_col: str, positives: int, unlabelled: int) -> DataFrame:
    """``(id, positive, text)`` of the bounded sample, one text of those whose marks agree, written."""
    sure = hash_sample(told.where("y = 1").select("id"), "id", positives).withColumn("positive", F.lit(True))
    everyone = docs.where(learns).select(F.col(id_col).cast("long").alias("id")).where("id is not null")
    rest = hash_sample(everyone, "id", unlabelled, salt=1).dropDuplicates(["id"]).withColumn("positive", F.lit(False))
    # At most POSITIVES + UNLABELLED rows of two small columns: a broadcast of bounded size.
    chosen = F.broadcast(checkpointed(sure.unionByName(rest)))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(chosen, "id")
    texts = checkpointed(texts.select("id", "positive", "text").repartition(SPREAD, "id"))

    def run(batches):
        for batch in batches:
            marks = pa.array([_mark(_string(t)) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), marks], ["id", "positive", "mark"])

    marked = arrow_map(texts, run, "id long, positive boolean, mark long")
    firsts = checkpointed(marked.groupBy("positive", "mark").agg(F.min("id").alias("id")).select("id", "positive").distinct())
    return texts.join(F.broadcast(firsts), ["id", "positive"]).select("id", "positive", "text")


def _counts(texts: DataFrame) -> DataFrame:
    """``(f, a, c)``: in how many positive and unlabelled texts each feature is."""

    def run(batches):
        a, c = Counter(), Counter()

        def out():
            names = list(a.keys() | c.keys())
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array([a[f] for f in names], pa.int64()), pa.array([c[f] for f in names], pa.int64())], ["f", "a", "c"])

        for batch in batches:
            for positive, text in zip(batch.column(1), batch.column(2), strict=True):
                found: set[str] = set()
                for w in words(_string(text)):
                    found.update(features(w))
                (a if positive.as_py() else c).update(found)
                if len(a) + len(c) >= _GATHER:
                    yield out()
                    a.clear()
                    c.clear()
        if a or c:
            yield out()

    return arrow_map(texts, run, "f string, a long, c long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))


def _ratio(a: Column, c: Column, np_: int, nu: int) -> Column:
    """The likelihood ratio statistic of two rates, ``a`` of ``np_`` and ``c`` of ``nu``."""

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    both, n = a + c, float(np_ + nu)
    return 2 * (part(a, both * np_ / n) + part(c, both * nu / n) + part(np_ - a, (n - both) * np_ / n) + part(nu - c, (n - both) * nu / n))


def learn_toxicity(
    docs: DataFrame, labels: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED,
) -> Linear:
    """Learn from the rows of ``docs`` and ``labels`` on which ``learns`` (a condition on the id) holds."""
    told = labels.where(learns).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).alias("y")).where("id is not null and y is not null")
    n, toxic = told.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not toxic:
        return Linear({}, -40.0)
    texts = _training_texts(docs, told, learns, id_col, text_col, positives, unlabelled)
    sizes = {r["positive"]: r["n"] for r in texts.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    np_, nu = sizes.get(True, 0), sizes.get(False, 0)
    if not np_:
        return Linear({}, -40.0)
    counts = checkpointed(_counts(texts).where(F.col("a") + F.col("c") >= LEAST_TEXTS))
    among = max(2, counts.count())
    sharp = counts.where((F.col("a") >= LEAST_POSITIVES) & (F.col("a") * nu >= LIFT * np_ * F.col("c")))
    sharp = sharp.withColumn("g", _ratio(F.col("a"), F.col("c"), np_, nu)).where(F.col("g") >= STRICTNESS * 2 * float(np.log(among)))
    kept = [r["f"] for r in sharp.orderBy(F.col("g").desc(), "f").limit(FEATURES).select("f").collect()]
    probe = Linear(dict.fromkeys(kept, 0.0), 0.0)

    def run(batches):
        for batch in batches:
            found = [sorted(probe.present(_string(t))) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["id", "positive", "found"])

    table = arrow_map(texts, run, "id long, positive boolean, found array<string>").toArrow().sort_by([("id", "ascending"), ("positive", "ascending")])
    sets = table.column("found").to_pylist()
    place = _columns(kept, sets)
    rows = [sorted({place[f] for f in s if f in place}) for s in sets]
    names = {k: f for f, k in place.items()}
    w, b = fit_nnpu(rows, table.column("positive").to_numpy(zero_copy_only=False).astype(bool), len(place), toxic / n)
    return Linear({names[k]: float(x) for k, x in enumerate(w) if x > 0}, b)


def _columns(kept: list[str], sets: list[list[str]]) -> dict[str, int]:
    """A column for each feature; of features that the same texts have, the shortest speaks for all."""
    at: dict[str, list[int]] = {f: [] for f in kept}
    for i, s in enumerate(sets):
        for f in s:
            at[f].append(i)
    best: dict[tuple, str] = {}
    for f in kept:
        own = tuple(at[f])
        if own and (own not in best or (len(f), f) < (len(best[own]), best[own])):
            best[own] = f
    return {f: k for k, f in enumerate(sorted(best.values()))}


def score_toxicity(docs: DataFrame, model: Linear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for each row of ``docs``."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(_string(t)) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, score double")

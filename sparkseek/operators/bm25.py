"""BM25 as an aggregation: over scanned tokens, or over a postings table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN, fold, has_words, phrase_count, token_count, tokens
from ..session import checkpointed

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Policy:
    k1: float = K1
    b: float = B


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def term_score(tf: Column, df: Column, n: Column, length: Column, mean: Column, weight: Column | None = None, policy: Policy = Policy()) -> Column:
    """Score of a term, or of a phrase with ``weight`` the sum of its words' idf."""
    w = idf(n, df) if weight is None else weight
    bound = F.lit(policy.k1) * (F.lit(1 - policy.b) + F.lit(policy.b) * length / mean)
    return F.when(tf > 0, w * F.lit(policy.k1 + 1) * tf / (tf + bound)).otherwise(F.lit(0.0))


def population(docs: DataFrame, text: str, toks: str, terms: list[str]) -> DataFrame:
    """One row: live documents, mean length and, for each term, the documents that have it."""
    return docs.select(
        token_count(F.col(text)).alias("length"), *[has_words(F.col(text), F.col(toks), [t]).cast("long").alias(f"has{i}") for i, t in enumerate(terms)]
    ).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        (F.sum("length") / F.count(F.lit(1))).alias("mean"),
        *[F.sum(f"has{i}").cast("double").alias(f"df{i}") for i in range(len(terms))],
    )


class Scorer:
    """Scores keyword clauses against the whole live population, whatever the filters keep.

    The statistics are scalar subqueries of the one plan: they are computed
    once, beside the scan, and nothing is collected.
    """

    def __init__(self, docs: DataFrame, text: str, toks: str, policy: Policy = Policy()):
        self.docs, self.text, self.toks, self.policy = docs, text, toks, policy
        self.terms: list[str] = []
        self._stats: DataFrame | None = None

    def want(self, words: list[str]) -> None:
        self.terms += [w for w in words if w not in self.terms]

    def _stat(self, name: str) -> Column:
        if self._stats is None:
            self._stats = population(self.docs, self.text, self.toks, self.terms)
        return self._stats.select(name).scalar()

    def score(self, words: list[str]) -> Column:
        """Of one word its term score; of several that of their phrase. All words must have been ``want``-ed."""
        toks = F.col(self.toks)
        n, mean = self._stat("n"), self._stat("mean")
        dfs = [self._stat(f"df{self.terms.index(w)}") for w in words]
        tf = phrase_count(toks, words).cast("double")
        weight = idf(n, dfs[0])
        for df in dfs[1:]:
            weight = weight + idf(n, df)
        return term_score(tf, dfs[0], n, F.size(toks).cast("double"), mean, weight, self.policy)


def _less(places: Column, k: int) -> Column:
    return F.transform(places, lambda p: p - k)


class IndexScorer:
    """The same scores from postings: a clause's occurrences come from the positions of its words, and no text is read.

    The statistics are the number of a term's postings and the one row of ``totals``.
    """

    def __init__(self, index: DataFrame, totals: DataFrame, policy: Policy = Policy()):
        self.index, self.totals, self.policy = index, totals, policy
        self.terms: list[str] = []
        self._dfs: DataFrame | None = None

    def want(self, words: list[str]) -> None:
        self.terms += [w for w in words if w not in self.terms]

    def joined(self, rows: DataFrame, key: str = "candidate_id") -> DataFrame:
        """``rows`` with a column ``__hit<i>`` of the i-th term's positions, and the length of those that have any term."""
        if not self.terms:
            return rows
        found = self.index.where(F.col("term").isin(*self.terms)).groupBy(key).agg(
            F.max("length").alias("__length"), *[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"__hit{i}") for i, t in enumerate(self.terms)]
        )
        return rows.join(found, key, "left")

    def count(self, words: list[str]) -> Column:
        """How often the words stand side by side."""
        runs = [F.col(f"__hit{self.terms.index(w)}") for w in words]
        starts = runs[0]
        for k, places in enumerate(runs[1:], 1):
            starts = F.array_intersect(starts, _less(places, k))
        return F.when(starts.isNotNull(), F.size(starts)).otherwise(0)

    def match(self, words: list[str]) -> Column:
        return self.count(words) > 0

    def score(self, words: list[str]) -> Column:
        n, mean = self.totals.select("n").scalar(), self.totals.select("mean").scalar()
        if self._dfs is None:  # one pass over the terms' postings, whatever their number
            counts = [F.count(F.when(F.col("term") == t, 1)).cast("double").alias(f"df{i}") for i, t in enumerate(self.terms)]
            self._dfs = self.index.where(F.col("term").isin(*self.terms)).agg(*counts)
        dfs = [self._dfs.select(f"df{self.terms.index(w)}").scalar() for w in words]
        weight = idf(n, dfs[0])
        for df in dfs[1:]:
            weight = weight + idf(n, df)
        length = F.coalesce(F.col("__length"), F.lit(0)).cast("double")
        return term_score(self.count(words).cast("double"), dfs[0], n, length, mean, weight, self.policy)


def totals(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """``(n, mean)``: the chunks there are and their mean length in tokens."""
    return _totals(chunks.select(token_count(fold(F.coalesce(F.col(text_col), F.lit("")))).alias("length")))


def _totals(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).cast("double").alias("n"), (F.sum("length") / F.count(F.lit(1))).alias("mean"))


def postings(chunks: DataFrame, text_col: str = "text", id_col: str = "candidate_id") -> DataFrame:
    """``(term, candidate_id, tf, length, positions)``: the index that publication writes, clustered by term."""
    rows = chunks.select(F.col(id_col).alias("candidate_id"), tokens(fold(F.col(text_col))).alias("t"))
    each = rows.select("candidate_id", F.size("t").alias("length"), F.posexplode("t").alias("pos", "term")).where("term is not null")
    return each.groupBy("term", "candidate_id").agg(
        F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"), F.sort_array(F.collect_list("pos")).alias("positions")
    )


def index_of(chunks: DataFrame, terms: list[str], text_col: str = "text", id_col: str = "candidate_id") -> tuple[DataFrame, DataFrame]:
    """The rows of ``postings`` that have one of ``terms``, and ``totals``: of one pass over the texts, whose lengths and places are kept.

    A text without the letters of any term is counted and not cut into tokens.
    """
    terms = list(dict.fromkeys(terms))
    shown = fold(F.coalesce(F.col(text_col), F.lit("")))
    rows = chunks.select(F.col(id_col).alias("candidate_id"), shown.alias("shown"))
    near = F.lit(False)
    for t in terms:
        near = near | F.contains("shown", F.lit(t))
    rows = rows.select("candidate_id", "shown", F.when(near, F.regexp_extract_all("shown", F.lit(TOKEN), F.lit(0))).alias("t"))
    length = F.when(F.col("t").isNull(), token_count(F.col("shown"))).otherwise(F.size("t"))
    places = F.when(F.size("t") > 0, F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.get("t", i).isin(*terms))) if terms else F.lit(None).cast("array<int>")
    rows = rows.select("candidate_id", length.alias("length"), "t", places.alias("places"))
    known = F.array(*map(F.lit, terms)).cast("array<string>")
    which = F.transform("places", lambda i: F.array_position(known, F.get("t", i)).cast("tinyint" if len(terms) < 128 else "int"))
    cut = checkpointed(rows.select("candidate_id", "length", "places", which.alias("which")))
    each = cut.where(F.size("places") > 0).select("candidate_id", "length", "places", "which", F.explode(F.array_distinct("which")).alias("w"))
    own = F.transform(F.filter(F.arrays_zip("places", "which"), lambda x: x["which"] == F.col("w")), lambda x: x["places"])
    each = each.select("candidate_id", "length", F.get(known, F.col("w") - 1).alias("term"), own.alias("positions"))
    index = each.groupBy("term", "candidate_id").agg(
        F.sum(F.size("positions")).alias("tf"), F.first("length").alias("length"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")
    )
    return index, _totals(cut)


def score_postings(index: DataFrame, lengths: DataFrame, terms: list[str], policy: Policy = Policy()) -> DataFrame:
    """``(candidate_id, score)`` of the OR of ``terms``; only the terms' postings are read.

    ``lengths(candidate_id, length)`` is the live population.
    """
    hits = index.where(F.col("term").isin(*terms)).join(lengths.select("candidate_id"), "candidate_id", "left_semi")
    stats = lengths.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("length").alias("mean"))
    dfs = hits.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    n, mean = stats.select("n").scalar(), stats.select("mean").scalar()
    scored = hits.join(F.broadcast(dfs), "term")  # a row for each query term at most
    one = term_score(F.col("tf").cast("double"), F.col("df"), n, F.col("length").cast("double"), mean, policy=policy)
    return scored.groupBy("candidate_id").agg(F.sum(one).alias("score"))

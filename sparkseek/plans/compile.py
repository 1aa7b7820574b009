"""From a normalized query to conditions, scores and semi-joins over chunks.

Leaves become column expressions. Predicates become key sets: those that stand
in the top conjunction restrict by semi-join (negated, by anti-join); those below
OR or NOT become an existence flag by a left join on distinct keys. Filters are
conditions; statistics are those of the whole population. Where a generation has
postings and totals, words and phrases become conditions on positions that are
joined from the postings of the query's terms; else on the tokens of the text. Both give the same rows.
What is read from the text is computed beside the scan, so that no join carries texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regexes import check_scope_regex, check_text_regex
from ..functions.text import has_words, query_literal, query_tokens
from ..functions.timeref import parse_timeref
from ..operators.bm25 import IndexScorer, Scorer
from ..sources.snapshot import Snapshot, analysed
from .ast import All, Any, Empty, Keyword, Not, Phrase, Predicate, Query, Raw, Regex
from .errors import QueryError

LEXICAL_FILTERS = frozenset("repo file lang fork archived visibility context type select content".split())
#: A side of a semi-join is broadcast by Spark where its measured size allows it; no hint is given.


@dataclass
class Compiled:
    rows: DataFrame
    match: Column
    score: Column
    parts: list[Column] = field(default_factory=list)

    def result(self) -> DataFrame:
        return self.rows.where(self.match).withColumn("score", self.score)


class Compiler:
    def __init__(self, snapshot: Snapshot, q: Query, now_ms: int):
        self.s, self.q, self.now_ms = snapshot, q, now_ms
        self.case = q.options.case
        self.base = analysed(snapshot.need("chunks"), self.case)
        self.body, self.paths = Scorer(self.base, "__text", "__tokens"), Scorer(self.base, "__path", "__path_tokens")
        # Postings hold folded tokens: with them, words and phrases of a folded query are answered without the text.
        self.index = None
        if snapshot.postings is not None and snapshot.totals is not None and not self.case:
            self.index = self.body = IndexScorer(snapshot.postings, snapshot.totals)
        self.flags: list[tuple[str, DataFrame, list[str]]] = []
        self.kept: dict[tuple, tuple[str, Column]] = {}

    # leaves

    def keep(self, what: tuple, made: Column) -> Column:
        """A column that is computed before all joins; the same one for the same leaf."""
        name, _ = self.kept.setdefault(what, (f"__kept{len(self.kept)}", made))
        return F.col(name)

    def regexp(self, leaf):
        if self.q.options.pattern_type == "regexp" and isinstance(leaf, (Keyword, Raw)):
            return Regex(check_text_regex(leaf.text))
        return leaf

    def want(self, e, lone: bool) -> None:
        if isinstance(e, (All, Any)):
            for x in e.of:
                self.want(x, False)
        elif isinstance(e, Not):
            self.want(e.of, False)
        elif isinstance(self.regexp(e), (Keyword, Phrase)):
            words = query_tokens(e.text, self.case)
            if self.index is not None:
                self.body.want(words)
            if isinstance(self.regexp(e), Keyword) and self.q.options.index != "no":
                self.body.want(words)
                if lone:
                    self.paths.want(words)

    def leaf_match(self, e, text: str = "__text", toks: str = "__tokens") -> Column:
        e = self.regexp(e)
        if isinstance(e, (Keyword, Phrase)):
            return has_words(F.col(text), F.col(toks), query_tokens(e.text, self.case))
        if isinstance(e, Raw):
            return F.contains(F.col(text), F.lit(query_literal(e.text, self.case)))
        if isinstance(e, Regex):
            return F.col("text" if text == "__text" else text).rlike(("" if self.case else "(?iu)") + e.pattern)
        if isinstance(e, Predicate):
            raise QueryError("UNSUPPORTED_PREDICATE", e.name)
        raise QueryError("UNSUPPORTED_LEAF", "structural blocks belong to the structural route")

    def condition(self, e, lone: bool = False) -> Column:
        if isinstance(e, Empty):
            return F.lit(True)
        if isinstance(e, Not):
            return ~self.condition(e.of)
        if isinstance(e, All):
            return _fold([self.condition(x) for x in e.of], Column.__and__)
        if isinstance(e, Any):
            return _fold([self.condition(x) for x in e.of], Column.__or__)
        if isinstance(e, Predicate):
            keys, on = self.key_set(e)
            flag = f"__flag{len(self.flags)}"
            self.flags.append((flag, keys, on))
            return F.col(flag)
        if self.index is not None and isinstance(self.regexp(e), (Keyword, Phrase)):
            got = self.index.match(query_tokens(e.text, self.case))
        else:
            got = self.keep(("match", e), self.leaf_match(e))
        if lone and isinstance(self.regexp(e), Keyword):
            got = got | self.keep(("path", e), has_words(F.col("__path"), F.col("__path_tokens"), query_tokens(e.text, self.case)))
        return got

    def points(self, e, lone: bool = False) -> Column:
        """Sum of BM25 over keyword clauses, and 1 for each other leaf that holds; negations add nothing."""
        if isinstance(e, Empty):
            return F.lit(1.0)
        if isinstance(e, (Not, Predicate)):
            return F.lit(0.0)
        if isinstance(e, (All, Any)):
            return _fold([self.points(x) for x in e.of], Column.__add__)
        if isinstance(self.regexp(e), Keyword):
            words = query_tokens(e.text, self.case)
            own = self.body.score(words)
            if self.index is None:  # only texts with the words are cut into tokens
                own = self.keep(("score", e), F.when(self.leaf_match(e), own).otherwise(F.lit(0.0)))
            return own + self.keep(("path score", e), self.paths.score(words)) if lone else own
        return F.when(self.condition(e), F.lit(1.0)).otherwise(F.lit(0.0))

    # predicates

    def _scoped(self, args, allowed: dict) -> DataFrame:
        """Chunks on which every matcher holds."""
        rows = self.base
        for kind, value in args:
            if kind in ("phrase", "raw", "regex", "keyword"):
                leaf = {"phrase": Phrase, "raw": Raw, "regex": Regex, "keyword": Raw if allowed.get("bare") == "raw" else Keyword}[kind](value)
                rows = rows.where(self.leaf_match(leaf))
            elif kind == "content":
                rows = rows.where(self.leaf_match(Regex(value[1:-1]) if value[:1] == "/" else Raw(value)))
            elif kind == "lang":
                rows = rows.where(F.col("lang") == value.strip().lower())
            else:
                pattern = value[1:-1] if value[:1] == "/" and value[-1:] == "/" else value
                column = "__name" if kind == "name" else "path"
                rows = rows.where(F.col(column).rlike(check_text_regex(pattern)))
        return rows

    def key_set(self, e: Predicate) -> tuple[DataFrame, list[str]]:
        name, args = e.name, e.args
        one = args[0][1] if args else ""
        if name == "repo.has.file":
            return self._scoped(args, {"bare": "raw"}).select("repo").distinct(), ["repo"]
        if name == "repo.has.content":
            return self._scoped(args, {"bare": "raw"}).select("repo").distinct(), ["repo"]
        if name == "file.contains":
            return self._scoped(args, {"bare": "raw"}).select("repo", "path").distinct(), ["repo", "path"]
        if name == "file.has.owner":
            rows = self.s.need("owners")
            want = one.strip().lower().lstrip("@")
            test = F.size("owners") > 0 if not args else F.exists("owners", lambda o: F.ltrim(F.lower(F.trim(o)), F.lit("@")) == want)
            return rows.where(test).select("repo", "path").distinct(), ["repo", "path"]
        if name == "file.has.contributor":
            rows = self.s.need("contributors")
            if args and args[0][0] == "regex":
                pattern = "(?i)" + check_text_regex(one)
                test = F.exists("contributors", lambda c: F.coalesce(c["name"].rlike(pattern), F.lit(False)) | F.coalesce(c["email"].rlike(pattern), F.lit(False)))
            else:
                test = F.exists("contributors", lambda c: F.lower(c["canonical"]) == one.strip().lower())
            return rows.where(test).select("repo", "path").distinct(), ["repo", "path"]
        repos = self.s.need("repos")
        if name == "repo.has.commit.after":
            test = F.col("latest_commit_ms") > parse_timeref(one, self.now_ms)
        elif name == "repo.has.topic":
            test = F.array_contains(F.transform("topics", lambda t: F.lower(F.trim(t))), one.strip().lower())
        elif name == "repo.has.description":
            test = F.col("description").rlike("(?i)" + check_text_regex(one))
        elif name == "repo.has.meta":
            test = self._meta(one if args[0][0] != "regex" else f"/{one}/")
        else:
            raise QueryError("UNSUPPORTED_PREDICATE", f"{name} belongs to the symbol route")
        return repos.where(F.coalesce(test, F.lit(False))).select("repo").distinct(), ["repo"]

    def _meta(self, text: str) -> Column:
        def side(raw: str):
            raw = raw.strip()
            if raw[:1] == "/" and raw[-1:] == "/" and len(raw) > 1:
                pattern = "(?i)^(?:" + check_text_regex(raw[1:-1]) + ")$"
                return lambda c: c.rlike(pattern)
            return lambda c: F.lower(c) == raw.lower()

        cut = text.rfind("/:") + 1 if text[:1] == "/" and "/:" in text else text.find(":")
        key, value = (text[:cut], text[cut + 1 :]) if cut > 0 else (text, "")
        k = side(key)
        if not value.strip():
            return F.exists(F.map_keys("meta"), k)
        v = side(value)
        return F.exists(F.map_entries("meta"), lambda x: k(x["key"]) & v(x["value"]))

    # filters

    def filters(self) -> tuple[list[Column], list[Column]]:
        """Conditions on chunks, and on repositories."""
        rows, repos = [], []
        for f in self.q.filters:
            if f.name not in LEXICAL_FILTERS:
                raise QueryError("UNSUPPORTED_FILTER", f"{f.name}: is not a filter of the lexical route")
            if f.name == "repo":
                rows.append(F.col("repo").rlike(check_scope_regex(f.value)))
            elif f.name == "file":
                pattern = check_scope_regex(f.value)
                either = {"path": ["path"], "name": ["__name"], "either": ["path", "__name"]}[f.scope]
                rows.append(_fold([F.col(c).rlike(pattern) for c in either], Column.__or__))
            elif f.name == "lang":
                rows.append(F.col("lang") == f.value.strip().lower())
            elif f.name == "content":
                kind = {"keyword": Keyword, "phrase": Phrase, "raw": Raw, "regex": Regex}[f.scope]
                rows.append(self.leaf_match(kind(f.value)))
            elif f.name in ("fork", "archived"):
                if f.value != "yes":
                    repos.append(F.col(f.name) == (f.value == "only"))
            elif f.name == "visibility":
                if f.value != "any":
                    repos.append(F.col("visibility") == f.value)
            elif f.name == "context":
                repos.append(F.array_contains("contexts", f.value))
            elif f.name == "type" and f.value not in ("file", "path"):
                raise QueryError("UNSUPPORTED_COMBO", f"type:{f.value} is not answered by the lexical route")
        return rows, repos

    def compile(self, named: tuple = ()) -> Compiled:
        """The plan of the query; ``parts`` are the points of the ``named`` leaves."""
        e, rows = self.q.expr, self.base
        conditions, repo_conditions = self.filters()
        for c in conditions:
            rows = rows.where(c)
        joins = []
        if repo_conditions:
            joins.append((self.s.need("repos").where(_fold(repo_conditions, Column.__and__)).select("repo").distinct(), "repo", "left_semi"))
        rest = []
        for x in e.of if isinstance(e, All) else [e]:
            inner = x.of if isinstance(x, Not) else x
            if isinstance(inner, Predicate):
                keys, on = self.key_set(inner)
                joins.append((keys, on, "left_anti" if isinstance(x, Not) else "left_semi"))
            else:
                rest.append(x)
        lone = len(rest) == 1 and rest[0] is e
        e = Empty() if not rest else rest[0] if len(rest) == 1 else All(tuple(rest))
        self.want(e, lone)
        match = self.condition(e, lone)
        score = F.lit(1.0) if self.q.options.index == "no" else self.points(e, lone)
        parts = [self.points(x, isinstance(self.q.expr, Keyword)) for x in named]
        # From here on rows have no text: joins on few keys, as repositories are, deal them unevenly.
        rows = rows.select(*[c for c in self.s.chunks.columns if c != "text"], *[made.alias(name) for name, made in self.kept.values()])
        for keys, on, how in joins:
            rows = rows.join(keys, on, how)
        if self.index is not None:
            rows = self.index.joined(rows)
        for flag, keys, on in self.flags:
            rows = rows.join(keys.withColumn(flag, F.lit(True)), on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
        return Compiled(rows, match, score, parts)


def query_words(e, case: bool = False) -> list[str]:
    """The words of all keywords and phrases of an expression, negated ones too: what an index is asked for."""
    if isinstance(e, (All, Any)):
        return sorted({w for x in e.of for w in query_words(x, case)})
    if isinstance(e, Not):
        return query_words(e.of, case)
    return sorted(set(query_tokens(e.text, case))) if isinstance(e, (Keyword, Phrase)) else []


def _fold(parts: list[Column], op) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = op(out, p)
    return out

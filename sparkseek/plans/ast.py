"""The query tree, its normal form and its hash."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace

from ..functions.regexes import check_text_regex, split_case_flag
from .errors import QueryError

MOST_DEPTH, MOST_FANOUT = 32, 64


@dataclass(frozen=True)
class Empty:
    """Matches everything."""


@dataclass(frozen=True)
class Keyword:
    text: str


@dataclass(frozen=True)
class Phrase:
    text: str


@dataclass(frozen=True)
class Raw:
    text: str


@dataclass(frozen=True)
class Regex:
    pattern: str


@dataclass(frozen=True)
class Structural:
    body: str


@dataclass(frozen=True)
class Predicate:
    name: str
    args: tuple[tuple[str, str], ...]  # (kind or matcher name, value)


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class All:
    of: tuple


@dataclass(frozen=True)
class Any:
    of: tuple


Leaf = Keyword | Phrase | Raw | Regex | Structural | Predicate


@dataclass(frozen=True)
class Filter:
    name: str
    value: str
    scope: str = ""


@dataclass(frozen=True)
class Options:
    case: bool = False
    count: int | str | None = None
    pattern_type: str = "standard"
    index: str = "yes"
    boost_millis: int = 1000
    timeout: str | None = None


@dataclass(frozen=True)
class Query:
    expr: object = field(default_factory=Empty)
    filters: tuple[Filter, ...] = ()
    options: Options = Options()
    directives: tuple[str, ...] = ()

    def values(self, name: str) -> list[str]:
        return [f.value for f in self.filters if f.name == name]


def encoded(e) -> list:
    """A tree as nested lists, for sorting and hashing."""
    if isinstance(e, (All, Any)):
        return [type(e).__name__, [encoded(x) for x in e.of]]
    if isinstance(e, Not):
        return ["Not", encoded(e.of)]
    if isinstance(e, Predicate):
        return ["Predicate", e.name, [list(a) for a in e.args]]
    return [type(e).__name__, *vars(e).values()]


def _key(e) -> str:
    return json.dumps(encoded(e), ensure_ascii=False)


def normal(e, depth: int = 0):
    """Flat, sorted, without repeats, single children or double negation."""
    if depth > MOST_DEPTH:
        raise QueryError("LIMIT_EXCEEDED_DEPTH", "the query is nested too deeply")
    if isinstance(e, Not):
        inner = normal(e.of, depth + 1)
        return inner.of if isinstance(inner, Not) else Not(inner)
    if isinstance(e, (All, Any)):
        parts = []
        for x in e.of:
            x = normal(x, depth + 1)
            parts += x.of if isinstance(x, type(e)) else [x]
        if len(parts) > MOST_FANOUT:
            raise QueryError("LIMIT_EXCEEDED_FANOUT", "too many clauses side by side")
        unique = {_key(x): x for x in parts if not isinstance(x, Empty)}
        if not unique:
            return Empty()
        if isinstance(e, Any) and len(parts) > sum(not isinstance(x, Empty) for x in parts):
            return Empty()
        ordered = tuple(unique[k] for k in sorted(unique))
        return ordered[0] if len(ordered) == 1 else type(e)(ordered)
    return e


def leaves(e):
    if isinstance(e, (All, Any)):
        for x in e.of:
            yield from leaves(x)
    elif isinstance(e, Not):
        yield from leaves(e.of)
    elif not isinstance(e, Empty):
        yield e


def positive_leaves(e, sign: bool = True):
    """Leaves under an even number of negations."""
    if isinstance(e, (All, Any)):
        for x in e.of:
            yield from positive_leaves(x, sign)
    elif isinstance(e, Not):
        yield from positive_leaves(e.of, not sign)
    elif sign and not isinstance(e, Empty):
        yield e


def _mapped(e, f):
    if isinstance(e, (All, Any)):
        return type(e)(tuple(_mapped(x, f) for x in e.of))
    if isinstance(e, Not):
        return Not(_mapped(e.of, f))
    return f(e)


def normalize(q: Query) -> Query:
    """The canonical query. A leading ``(?i)`` of any pattern becomes the option ``case:no``."""
    folded = False

    def regex(leaf):
        nonlocal folded
        if not isinstance(leaf, Regex):
            return leaf
        pattern, flag = split_case_flag(leaf.pattern)
        folded |= flag
        return Regex(check_text_regex(pattern))

    expr = normal(_mapped(q.expr, regex))
    filters = tuple(sorted(set(q.filters), key=lambda f: (f.name, f.scope, f.value)))
    options = replace(q.options, case=False) if folded else q.options
    out = Query(expr, filters, options, tuple(sorted(set(q.directives))))
    if isinstance(expr, Empty) and not filters:
        raise QueryError("EMPTY_QUERY", "the query has no clause")
    return out


def query_hash(q: Query) -> str:
    body = [encoded(q.expr), [list(vars(f).values()) for f in q.filters], list(vars(q.options).values()), list(q.directives)]
    return hashlib.sha256(json.dumps(body, ensure_ascii=False).encode()).hexdigest()

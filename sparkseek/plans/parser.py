"""Lexer and parser of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from .ast import All, Any, Empty, Filter, Keyword, Not, Options, Phrase, Predicate, Query, Raw, Regex, Structural
from .errors import QueryError

MOST_BYTES = 16 * 1024
_SPACE = " \t\r\n"
_HEAD = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*(?:\.[A-Za-z_][A-Za-z0-9_-]*)+(?=\()")
_MATCH = re.compile(r"match\s*\{")
_FILTERS = frozenset(
    """repo file path name lang rev author committer message before after since until since.time since.commit
    diff.added diff.removed diff.touched type select dirty changed stale snapshot meta.owner meta.service meta.layer
    meta.surface affected invalidated_by fork archived visibility context content""".split()
)
_ALIASES = {"r": "repo", "f": "file", "l": "lang", "language": "lang", "revision": "rev", "until.time": "until"}
_OPTIONS = frozenset("case count patterntype index boost timeout".split())
_DIRECTIVES = frozenset(("into:codeql", "scope:results", "with:lexical"))
_CLOSED = {
    "fork": ("yes", "no", "only"), "archived": ("yes", "no", "only"), "dirty": ("yes", "no", "only"), "visibility": ("any", "public", "private"),
    "type": ("file", "path", "symbol", "repo", "commit", "diff"), "select": ("content", "file", "path", "symbol", "repo", "file.owners"),
    "index": ("yes", "no", "only"), "case": ("yes", "no"),
    "patterntype": ("literal", "keyword", "standard", "regexp", "structural", "code_search"),
}
_ONCE = ("type", "select", "rev", "fork", "archived", "visibility", "dirty")


@dataclass(frozen=True)
class Token:
    kind: str
    text: str = ""
    at: int = 0
    args: str = ""


def _quoted(text: str, at: int, quote: str, decode: bool) -> tuple[str, int]:
    out, i = [], at + 1
    while i < len(text):
        c = text[i]
        if c == quote:
            return "".join(out), i + 1
        if c == "\\" and i + 1 < len(text):
            following = text[i + 1]
            if decode:
                known = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", quote: quote}
                if following not in known:
                    raise QueryError("TOKEN_INVALID", f"unknown escape \\{following}", i)
                out.append(known[following])
                i += 2
                continue
            if following == quote and quote == "/":
                out.append("/")
                i += 2
                continue
            if quote == "/":
                out.append(c + following)
                i += 2
                continue
        out.append(c)
        i += 1
    raise QueryError("UNCLOSED_QUOTE", f"no closing {quote}", at)


def _balanced(text: str, at: int, left: str, right: str) -> int:
    """The end of a bracketed part that starts at ``at``; quotes inside are skipped."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c in "\"'":
            _, i = _quoted(text, i, c, False)
            continue
        depth += (c == left) - (c == right)
        i += 1
        if not depth:
            return i
    raise QueryError("SYNTAX_ERROR", f"no closing {right}", at)


def tokenize(text: str) -> list[Token]:
    if len(text.encode()) > MOST_BYTES:
        raise QueryError("LIMIT_EXCEEDED_BYTES", "a query has at most 16 KiB", MOST_BYTES)
    out: list[Token] = []
    i = 0
    while True:
        gap = i
        while i < len(text) and text[i] in _SPACE:
            i += 1
        if i >= len(text):
            return [*out, Token("end", at=i)]
        spaced, c, last = i > gap, text[i], out[-1].kind if out else None
        if c in "()":
            out.append(Token(c, at=i))
            i += 1
        elif c == "-" and (last in (None, "and", "or", "not", "(", ":") or spaced):
            out.append(Token("dash", at=i))
            i += 1
        elif c == ":" and last is not None:
            out.append(Token(":", at=i))
            i += 1
        elif last == ":" and not spaced and c not in "\"'/":
            if head := _HEAD.match(text, i) or re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*(?=\()").match(text, i):
                end = _balanced(text, head.end(), "(", ")")
                out.append(Token("predicate", head[0], i, text[head.end() + 1 : end - 1]))
                i = end
            else:
                end = i
                while end < len(text) and text[end] not in _SPACE + ")":
                    end = _balanced(text, end, "(", ")") if text[end] == "(" else end + 1
                out.append(Token("value", text[i:end], i))
                i = end
        elif c == '"':
            body, end = _quoted(text, i, c, True)
            out.append(Token("phrase", body, i))
            i = end
        elif c == "'":
            body, end = _quoted(text, i, c, False)
            out.append(Token("raw", body, i))
            i = end
        elif c == "/":
            body, end = _quoted(text, i, c, False)
            out.append(Token("regex", body, i))
            i = end
        elif m := _MATCH.match(text, i):
            end = _balanced(text, m.end() - 1, "{", "}")
            out.append(Token("structural", text[m.end() : end - 1], i))
            i = end
        elif head := _HEAD.match(text, i):
            end = _balanced(text, head.end(), "(", ")")
            out.append(Token("predicate", head[0], i, text[head.end() + 1 : end - 1]))
            i = end
        else:
            end = i
            while end < len(text) and text[end] not in _SPACE + "():\"":
                end += 1
            if end == i:
                raise QueryError("TOKEN_INVALID", f"unexpected {c!r}", i)
            word = text[i:end]
            if "~" in word or "@" in word:
                raise QueryError("FORBIDDEN_SYNTAX", "fuzzy and @ operators are not accepted", i)
            out.append(Token({"AND": "and", "OR": "or", "NOT": "not"}.get(word, "word"), word, i))
            i = end


def predicate_args(raw: str) -> tuple[tuple[str, str], ...]:
    """Arguments divided at commas outside quotes and patterns; ``name:value`` ones keep their name."""
    parts, part, i = [], "", 0
    while i < len(raw):
        c = raw[i]
        if c in "\"'" or (c == "/" and (not part.strip() or part.rstrip().endswith(":"))):
            _, end = _quoted(raw, i, c, False)
            part += raw[i:end]
            i = end
            continue
        if c == ",":
            parts.append(part)
            part = ""
        else:
            part += c
        i += 1
    parts.append(part)
    out = []
    for p in (p.strip() for p in parts):
        if not p:
            continue
        if m := re.match(r"(path|name|file|lang|content):(.*)$", p, re.S):
            name, value = m[1], m[2].strip()
            out.append((name, value if value[:1] == "/" else value.strip("\"'")))
        elif p[0] == '"' and p[-1] == '"':
            out.append(("phrase", _quoted(p, 0, '"', True)[0]))
        elif p[0] == "'" and p[-1] == "'":
            out.append(("raw", p[1:-1]))
        elif p[0] == "/" and p[-1] == "/" and len(p) > 1 and "/:/" not in p:
            out.append(("regex", p[1:-1]))
        else:
            out.append(("keyword", p))
    return tuple(out)


_PREDICATE_ALIASES = {
    "repo.contains.file": "repo.has.file", "repo.contains.path": "repo.has.path", "repo.contains.content": "repo.has.content",
    "repo.contains.commit.after": "repo.has.commit.after", "file.has.content": "file.contains", "file.contains.content": "file.contains",
    "repo.has.tag": "repo.has.meta", "repo.has.key": "repo.has.meta",
}
PREDICATES = frozenset(
    """repo.has.file repo.has.path repo.has.content repo.has.commit.after repo.has.meta repo.has.topic repo.has.description
    file.contains file.has.owner file.has.contributor symbol.has.name symbol.local_name.exact symbol.qualified_name.exact""".split()
)


def predicate(name: str, raw: str, at: int = 0) -> Predicate:
    name = _PREDICATE_ALIASES.get(name, name)
    if name not in PREDICATES:
        raise QueryError("SYNTAX_ERROR", f"unknown predicate {name}", at)
    args = predicate_args(raw)
    if name == "repo.has.path":
        name, args = "repo.has.file", tuple(("path", v) for _, v in args)
    return Predicate(name, args)


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.i = tokenize(text), 0
        self.filters: list[Filter] = []
        self.options = Options()
        self.directives: list[str] = []
        self.seen: set[str] = set()

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def take(self) -> Token:
        self.i += 1
        return self.tokens[self.i - 1]

    def query(self) -> Query:
        expr = self.any_of(0, True)
        if self.now.kind != "end":
            raise QueryError("SYNTAX_ERROR", f"unexpected {self.now.kind}", self.now.at)
        return Query(expr, tuple(self.filters), self.options, tuple(self.directives))

    def any_of(self, depth: int, top: bool):
        if depth > 32:
            raise QueryError("LIMIT_EXCEEDED_DEPTH", "the query is nested too deeply", self.now.at)
        parts = [self.all_of(depth, top)]
        while self.now.kind == "or":
            self.take()
            parts.append(self.all_of(depth, top))
        if len(parts) == 1:
            return parts[0]
        if any(isinstance(p, Empty) for p in parts):
            raise QueryError("SYNTAX_ERROR", "OR needs a clause on both sides", self.now.at)
        return Any(tuple(parts))

    def all_of(self, depth: int, top: bool):
        parts = []
        while True:
            if self.now.kind == "and":
                if not parts:
                    raise QueryError("SYNTAX_ERROR", "AND needs a clause before it", self.now.at)
                self.take()
                if self.now.kind in ("end", ")", "or", "and"):
                    raise QueryError("SYNTAX_ERROR", "AND needs a clause after it", self.now.at)
            if self.now.kind in ("end", ")", "or"):
                break
            parts.append(self.one(depth, top))
        if not parts:
            if self.now.kind == "end" and top:
                return Empty()
            raise QueryError("SYNTAX_ERROR", "a clause is missing", self.now.at)
        real = [p for p in parts if not isinstance(p, Empty)]
        return Empty() if not real else real[0] if len(real) == 1 else All(tuple(real))

    def one(self, depth: int, top: bool):
        t = self.take()
        if t.kind in ("not", "dash"):
            if self.now.kind in ("end", ")", "and", "or"):
                raise QueryError("SYNTAX_ERROR", "nothing to negate", t.at)
            before = len(self.filters)
            inner = self.one(depth + 1, False)
            if len(self.filters) > before or isinstance(inner, Empty):
                raise QueryError("UNSUPPORTED_COMBO", "a filter cannot be negated", t.at)
            return Not(inner)
        if t.kind == "(":
            inner = self.any_of(depth + 1, False)
            if self.now.kind != ")":
                raise QueryError("SYNTAX_ERROR", "no closing )", self.now.at)
            self.take()
            return inner
        if t.kind == "phrase":
            return Phrase(t.text)
        if t.kind == "raw":
            return Raw(t.text)
        if t.kind == "regex":
            return Regex(t.text)
        if t.kind == "structural":
            return Structural(t.text)
        if t.kind == "predicate":
            return predicate(t.text, t.args, t.at)
        if t.kind == "word":
            if self.now.kind == ":" and self.now.at == t.at + len(t.text):
                return self.filter(t)
            return Keyword(t.text)
        raise QueryError("SYNTAX_ERROR", f"unexpected {t.kind}", t.at)

    def filter(self, t: Token):
        self.take()
        v = self.now
        if v.kind not in ("value", "phrase", "raw", "regex", "predicate") or (v.kind == "value" and not v.text):
            raise QueryError("INVALID_FILTER_VALUE", f"{t.text}: needs a value", t.at)
        self.take()
        name = _ALIASES.get(t.text, t.text)
        if v.kind == "predicate":
            if name in ("repo", "file", "symbol"):
                return predicate(f"{name}.{v.text}", v.args, t.at)
            if name == "rev" and v.text == "at.time":
                self.add(Filter("rev", f"at.time({v.args})"), t)
                return Empty()
            if name not in _FILTERS | _OPTIONS:
                raise QueryError("UNKNOWN_FILTER", f"unknown filter {t.text}", t.at)
            self.add(Filter(name, f"{v.text}({v.args})"), t)
            return Empty()
        if f"{name}:{v.text}" in _DIRECTIVES:
            self.directives.append(f"{name}:{v.text}")
            return Empty()
        if name in _OPTIONS:
            self.option(name, v.text, t)
            return Empty()
        if name not in _FILTERS:
            raise QueryError("UNKNOWN_FILTER", f"unknown filter {t.text}", t.at)
        if name in _CLOSED and v.text not in _CLOSED[name]:
            raise QueryError("INVALID_FILTER_VALUE", f"{name}: takes {', '.join(_CLOSED[name])}", t.at)
        if name == "content":
            self.add(Filter("content", v.text, v.kind if v.kind != "value" else "keyword"), t)
        elif name in ("file", "path", "name"):
            self.add(Filter("file", v.text, {"file": "either", "path": "path", "name": "name"}[name]), t)
        elif name == "repo" and v.kind == "value" and "@" in v.text:
            raise QueryError("UNSUPPORTED_COMBO", "revisions in repo: are refused; use rev:", t.at)
        elif name in ("since.time", "since.commit"):
            self.add(Filter("since", name.removeprefix("since.") + ":" + v.text), t)
        else:
            self.add(Filter(name, v.text), t)
        return Empty()

    def add(self, f: Filter, t: Token) -> None:
        if f.name in _ONCE and f.name in self.seen:
            raise QueryError("INVALID_FILTER_VALUE", f"{f.name}: may stand once", t.at)
        self.seen.add(f.name)
        self.filters.append(f)

    def option(self, name: str, value: str, t: Token) -> None:
        if name == "patterntype":
            if value not in _CLOSED[name]:
                raise QueryError("INVALID_PATTERN_TYPE", f"unknown pattern type {value}", t.at)
            self.options = replace(self.options, pattern_type=value)
            return
        if name in _CLOSED and value not in _CLOSED[name]:
            raise QueryError("INVALID_FILTER_VALUE", f"{name}: takes {', '.join(_CLOSED[name])}", t.at)
        if name == "case":
            self.options = replace(self.options, case=value == "yes")
        elif name == "index":
            self.options = replace(self.options, index=value)
        elif name == "timeout":
            if not re.fullmatch(r"\d+(?:ms|s|m)", value):
                raise QueryError("INVALID_FILTER_VALUE", "timeout: takes a duration", t.at)
            self.options = replace(self.options, timeout=value)
        elif name == "count":
            if value != "all" and (not value.isdigit() or not int(value)):
                raise QueryError("INVALID_FILTER_VALUE", "count: takes a positive number or all", t.at)
            self.options = replace(self.options, count=value if value == "all" else int(value))
        else:
            try:
                millis = round(float(value) * 1000)
            except ValueError:
                millis = -1
            if not 0 < millis <= 1_000_000:
                raise QueryError("INVALID_FILTER_VALUE", "boost: takes a factor of 0.001 to 1000", t.at)
            self.options = replace(self.options, boost_millis=millis)


def parse(text: str) -> Query:
    """Query text to a raw tree; ``ast.normalize`` makes it canonical."""
    return _Parser(text).query()

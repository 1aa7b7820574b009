"""Two further syntaxes, translated to the query tree: web code-search filters, and plain code-search terms."""

from __future__ import annotations

import re

from .ast import All, Keyword, Not, Phrase, Query, Raw, Regex, Structural, _mapped, normalize
from .errors import QueryError
from .parser import parse

MOST_TERMS, MOST_TERM_BYTES = 32, 256
_RENAMED = (
    (r"(?<![\w.:])r:", "repo:"), (r"(?<![\w.:])f:", "file:"), (r"(?<![\w.:])l:", "lang:"), (r"(?<![\w.:])language:", "lang:"),
    (r"(?<![\w.:])rev(?:ision)?:", "rev:"), (r"(?<![\w.:])(?:message|msg|m):", "message:"), (r"(?<![\w.:])case:(?:true|yes)\b", "case:yes"),
    (r"(?<![\w.:])count:0*(\d)", r"count:\1"),
)


def from_web_syntax(text: str) -> Query:
    """Keyword text with ``name:value`` filters. Words are keywords, quoted text a phrase,
    ``/x/`` a pattern; ``content:x`` alone is its leaf; ``patterntype:regexp`` makes words patterns."""
    for pattern, to in _RENAMED:
        text = re.sub(pattern, to, text)
    q = parse(text)
    content = [f for f in q.filters if f.name == "content"]
    kinds = {"keyword": Keyword, "phrase": Phrase, "raw": Raw, "regex": Regex}
    expr, filters = q.expr, [f for f in q.filters if f.name != "content"]
    for f in content:
        leaf = kinds[f.scope](f.value)
        expr = All((expr, leaf))
    if q.options.pattern_type == "regexp":
        expr = _mapped(expr, lambda x: Regex(x.text) if isinstance(x, (Keyword, Phrase)) else x)
    elif q.options.pattern_type == "structural":
        expr = _mapped(expr, lambda x: Structural(x.text) if isinstance(x, (Keyword, Phrase, Raw)) else x)
    return normalize(Query(expr, tuple(filters), q.options, q.directives))


class CodeSearch:
    """Plain terms that must all occur in one file, with ``typo:`` and ``components:`` forms."""

    def __init__(self, text: str):
        self.typo: list[str] = []
        self.components: list[list[str]] = []

        def typo(m):
            word = m[1]
            if not (word.isascii() and 3 <= len(word) <= 64 and word.isidentifier()):
                raise QueryError("INVALID_FILTER_VALUE", "typo: takes an identifier of 3 to 64 ASCII letters")
            self.typo.append(word)
            return " "

        def parts(m):
            self.components.append((m[1] or m[2]).lower().split())
            return " "

        text = re.sub(r"(?<!\S)typo:(\S+)", typo, text)
        text = re.sub(r'(?<!\S)components:(?:"([^"]*)"|(\S+))', parts, text)
        q = parse(text) if text.strip() else Query()
        self.query = q
        self.terms, self.without = [], []
        for e in q.expr.of if isinstance(q.expr, All) else [q.expr]:
            kind, to = (e.of, self.without) if isinstance(e, Not) else (e, self.terms)
            if isinstance(kind, (Keyword, Phrase, Raw)):
                to.append(kind.text)
            elif type(kind).__name__ != "Empty":
                raise QueryError("UNSUPPORTED_LEAF", "code search takes plain terms")
        every = self.terms + self.without
        if len(every) > MOST_TERMS or any(len(t.encode()) > MOST_TERM_BYTES for t in every):
            raise QueryError("LIMIT_EXCEEDED_FANOUT", "at most 32 terms of 256 bytes")
        if not self.terms and not self.typo and not self.components:
            raise QueryError("EMPTY_QUERY", "code search needs a term")

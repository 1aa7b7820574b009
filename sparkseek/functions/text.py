"""The text contract: NFC, context-free folding, tokens; and the column expressions built on it."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import QueryError

#: A token is a maximal run of letters, digits, marks and underscores.
TOKEN = r"[\p{IsAlphabetic}\p{N}\p{M}_]+"
TERM_BYTES = 256


def nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


def fold_text(text: str) -> str:
    """Lower case letter by letter: no rule looks at neighbours."""
    return "".join(c.lower() for c in text)


@F.pandas_udf(T.StringType())
def nfc_udf(s: pd.Series) -> pd.Series:
    """NFC of whole texts; for publication, where it runs once for each text."""
    return s.map(lambda x: x if x is None or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x))


def fold(column: Column) -> Column:
    """The same folding in the JVM: with capital sigma replaced first, no context rule is left."""
    return F.lower(F.replace(column, F.lit("Σ"), F.lit("σ")))


def cased(column: Column, case: bool) -> Column:
    return column if case else fold(column)


def tokens(column: Column) -> Column:
    """Tokens in order, repeats included; runs of over 256 bytes keep their place as null terms."""
    found = F.regexp_extract_all(column, F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.when(F.octet_length(t) <= TERM_BYTES, t))


def token_count(column: Column) -> Column:
    """Number of tokens, without making them."""
    return F.regexp_count(column, F.lit(TOKEN))


def _is_token(c: str) -> bool:
    return c == "_" or c.isalnum() or unicodedata.category(c)[0] in "MN"


def query_tokens(text: str, case: bool = False) -> list[str]:
    """Tokens of a query's text; refused if there is none or one is no term."""
    text = nfc(text)
    text = text if case else fold_text(text)
    out, run = [], ""
    for c in text + "\0":
        if c != "\0" and _is_token(c):
            run += c
        elif run:
            out.append(run)
            run = ""
    if not out or any(len(t.encode()) > TERM_BYTES for t in out):
        raise QueryError("NO_TERMS", "the text has no token, or one that is too long")
    return out


def query_literal(text: str, case: bool = False) -> str:
    return nfc(text) if case else fold_text(nfc(text))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def term_count(toks: Column, term: str) -> Column:
    return F.size(F.filter(toks, lambda t: t == F.lit(term)))


def _in_a_row(toks: Column) -> Column:
    """Tokens as one text, each between marks that no token has."""
    return F.concat(F.lit("\1"), F.array_join(toks, "\1", "\2"), F.lit("\1"))


def _run(words: list[str]) -> str:
    return "\1" + "\1".join(words) + "\1"


def phrase_count(toks: Column, words: list[str]) -> Column:
    """Number of places where the words stand one after another (overlaps count)."""
    if len(words) == 1:
        return term_count(toks, words[0])
    return F.regexp_count(_in_a_row(toks), F.lit(f"(?={_run(words)})"))


def has_phrase(toks: Column, words: list[str]) -> Column:
    if len(words) == 1:
        return F.array_contains(toks, words[0])
    return F.contains(_in_a_row(toks), F.lit(_run(words)))


def has_words(text: Column, toks: Column, words: list[str]) -> Column:
    """``has_phrase`` where ``toks`` are the tokens of ``text``: only texts that have all the letters are cut into tokens."""
    near = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        near = near & F.contains(text, F.lit(w))
    return near & has_phrase(toks, words)


def byte_trigrams(column: Column) -> Column:
    """Distinct runs of three bytes, as hexadecimal text."""
    raw = F.hex(F.encode(column, "UTF-8"))
    n = F.length(raw)
    places = F.when(n >= 6, F.sequence(F.lit(1), n - 5, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substr(raw, i, F.lit(6))))


_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PART_JVM = r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"


def components(name: str) -> list[str]:
    """Parts of a camel or snake identifier, lower-cased; none if it is not ASCII."""
    return [p.lower() for p in _PART.findall(name)] if name.isascii() else []


def components_column(name: Column) -> Column:
    parts = F.regexp_extract_all(name, F.lit(_PART_JVM), F.lit(0))
    none = F.array().cast("array<string>")
    return F.when(F.octet_length(name) == F.length(name), F.transform(parts, F.lower)).otherwise(none)


def within_one_edit(token: Column, word: str) -> Column:
    """Optimal string alignment distance of at most one: an edit or a swap of neighbours."""
    swaps = sorted({word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} | {word})
    return (F.levenshtein(token, F.lit(word), 1) >= 0) | token.isin(*swaps)


def osa(a: str, b: str) -> int:
    """Optimal string alignment distance."""
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


#: A place inside an ASCII identifier at which a part of it begins: beside an underscore, where case rises,
#: where letters and digits meet, and before the last capital of a run that a small letter follows.
_INNER = (
    "(?:(?<=_)(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])(?=_)|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[A-Z][a-z]))"
)
#: The ends of a whole token.
_BEGIN, _END = r"(?<![\p{L}\p{N}\p{M}_])", r"(?![\p{L}\p{N}\p{M}_])"


def boundary_bonus(text: Column, term: str, case: bool = False) -> Column:
    """16 if an occurrence begins and ends at parts of an identifier, one of the places inside it; 8 if one such place is
    all there is; 0 otherwise, for whole tokens too. The best occurrence counts."""
    literal = ("" if case else "(?iu:") + "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in term) + ("" if case else ")")
    both = f"{_INNER}{literal}(?:{_INNER}|{_END})|(?:{_INNER}|{_BEGIN}){literal}{_INNER}"
    one = f"{_INNER}{literal}|{literal}{_INNER}"
    return F.when(text.rlike(both), 16).when(text.rlike(one), 8).otherwise(0)


def snippet(text: str, needles: list[str], case: bool = False, width: int = 240) -> tuple[str, list[tuple[int, int]]]:
    """A window of at most ``width`` bytes around the first match, and all matches' spans in the whole text."""
    shown = text if case else fold_text(text)
    if len(shown) != len(text):
        shown = text
    spans = []
    for needle in {n if case else fold_text(n) for n in needles if n}:
        at = shown.find(needle)
        while at >= 0:
            spans.append((at, at + len(needle)))
            at = shown.find(needle, at + len(needle))
    spans.sort()
    start, end = spans[0] if spans else (0, 0)
    left, right = start, max(end, start)
    size = len(text[left:right].encode())
    while size < width and (left > 0 or right < len(text)):
        grown = False
        if right < len(text) and (size + len(text[right].encode())) <= width:
            size += len(text[right].encode())
            right += 1
            grown = True
        if left > 0 and size + len(text[left - 1].encode()) <= width:
            left -= 1
            size += len(text[left].encode())
            grown = True
        if not grown:
            break
    return text[left:right], spans


def nfc_offsets(text: str) -> list[tuple[int, int, int, int]]:
    """``(nfc start, nfc end, source start, source end)`` of each composed unit of the text."""
    out, at, done = [], 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and (unicodedata.combining(text[end]) or len(nfc(text[at : end + 1])) < len(nfc(text[at:end])) + len(nfc(text[end]))):
            end += 1
        size = len(nfc(text[at:end]))
        out.append((done, done + size, at, end))
        done += size
        at = end
    return out

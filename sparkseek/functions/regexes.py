"""Which regular expressions are accepted, so that every engine that checks us agrees."""

from __future__ import annotations

import re

from ..plans.errors import QueryError

_STATES = 100_000
_LOOK = re.compile(r"\(\?(?:[=!]|<[=!])")
_NAMED_REF = re.compile(r"\(\?P=|\\k[<{']")
_BACK_REF = re.compile(r"\\[1-9]")
_POSSESSIVE = re.compile(r"(?<!\\)(?:[*+?]|\{\d*,?\d*\})\+")
_ATOMIC = re.compile(r"\(\?>")
_INLINE = re.compile(r"\(\?[imsxU-]+[:)]")


def split_case_flag(pattern: str) -> tuple[str, bool]:
    """A leading ``(?i)`` is taken off and reported; inline flags elsewhere are refused."""
    folded = pattern.startswith("(?i)")
    rest = pattern[4:] if folded else pattern
    if _INLINE.search(rest):
        raise QueryError("FORBIDDEN_SYNTAX", "inline flags are accepted at the start of a pattern only")
    return rest, folded


def _states(pattern: str) -> int:
    """An upper estimate of automaton states: counted repetitions multiply what they repeat."""
    total = len(pattern)
    for low, high in re.findall(r"\{(\d+)(?:,(\d*))?\}", pattern):
        total *= max(1, int(high or low))
    return total


def check_text_regex(pattern: str) -> str:
    """A pattern over text: no look-around, back references, possessive or atomic parts."""
    for bad, what in ((_LOOK, "look-around"), (_NAMED_REF, "named references"), (_BACK_REF, "back references"), (_ATOMIC, "atomic groups")):
        if bad.search(pattern):
            raise QueryError("FORBIDDEN_SYNTAX", f"{what} are not accepted")
    if _POSSESSIVE.search(pattern):
        raise QueryError("FORBIDDEN_SYNTAX", "possessive repetition is not accepted")
    if _states(pattern) > _STATES:
        raise QueryError("LIMIT_EXCEEDED_NFA", "the pattern needs too many states")
    try:
        re.compile(re.sub(r"\\[pP](?:\{\w+\}|\w)", r"\\w", pattern).replace(r"\z", r"\Z"))
    except re.error as e:
        raise QueryError("REGEX_PARSE", f"pattern failed to compile: {e}") from e
    return pattern


def check_scope_regex(pattern: str) -> str:
    """A pattern over a whole repository name or path: anchors, word borders and lazy repetition are refused too."""
    check_text_regex(pattern)
    if re.search(r"(?<![\\\[])\^|\\[bB]|(?<!\\)[*+?}]\?", pattern):
        raise QueryError("FORBIDDEN_SYNTAX", "a scope pattern matches a whole name; anchors, word borders and lazy repetition are not accepted")
    return f"^(?:{pattern})$"

"""Typed refusals: a query is answered from one snapshot or refused with a code, never answered emptily."""

from __future__ import annotations

PARSE_CODES = frozenset(
    """LIMIT_EXCEEDED_BYTES LIMIT_EXCEEDED_DEPTH LIMIT_EXCEEDED_FANOUT LIMIT_EXCEEDED_NFA LIMIT_EXCEEDED_STRUCTURAL
    TOKEN_INVALID FORBIDDEN_SYNTAX UNKNOWN_FILTER INVALID_FILTER_VALUE EMPTY_QUERY UNCLOSED_QUOTE REGEX_PARSE
    INVALID_PATTERN_TYPE UNSUPPORTED_COMBO SYNTAX_ERROR""".split()
)
PLAN_CODES = frozenset(
    """UNSUPPORTED_FILTER UNSUPPORTED_LEAF UNSUPPORTED_PREDICATE UNSCORABLE INVALID_TIMEREF DOMAIN_UNAVAILABLE
    INVALID_TOP_K INVALID_CURSOR UNKNOWN_SNAPSHOT UNKNOWN_REVISION DIMENSION_MISMATCH MODEL_MISMATCH NOT_NORMALIZED
    WORK_BUDGET GENERATION_NOT_FOUND GENERATION_CONFLICT BATCH_CONFLICT STALE_BATCH NO_TERMS""".split()
)


class QueryError(ValueError):
    """A refusal with a code of one of the closed sets above."""

    def __init__(self, code: str, message: str, at: int | None = None):
        if code not in PARSE_CODES | PLAN_CODES:
            raise KeyError(code)
        super().__init__(f"{code}: {message}" + (f" (at byte {at})" if at is not None else ""))
        self.code, self.message, self.at = code, message, at

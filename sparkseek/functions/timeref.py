"""Time references of the query language, resolved to milliseconds on the driver."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from ..plans.errors import QueryError

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "mo": 30 * 86400, "y": 365 * 86400}
_NAMES = {"second": "s", "minute": "m", "hour": "h", "day": "d", "week": "w", "month": "mo", "year": "y"}
_MONTHS = {m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)}


def _ms(t: datetime) -> int:
    return round((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp() * 1000)


def _rfc3339(text: str) -> int | None:
    if not re.fullmatch(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)", text):
        return None
    try:
        return _ms(datetime.fromisoformat(text.upper().replace("Z", "+00:00")))
    except ValueError:
        return None


def _ago(text: str, now_ms: int) -> int | None:
    m = re.fullmatch(r"(\d+)(mo|[smhdwy])", text)
    return now_ms - int(m[1]) * _UNITS[m[2]] * 1000 if m else None


def parse_timeref(text: str, now_ms: int) -> int:
    """The wide form: a timestamp, a date, ``Month D, YYYY``, ``yesterday``, ``N unit(s) ago`` or a duration."""
    raw = text.strip().strip("\"'")
    low = raw.lower()
    if (got := _rfc3339(raw)) is not None or (got := _ago(low, now_ms)) is not None:
        return got
    try:
        if re.fullmatch(r"\d{4}-\d\d-\d\d", raw):
            return _ms(datetime.fromisoformat(raw))
        if (m := re.fullmatch(r"([a-z]+) (\d{1,2}),? (\d{4})", low)) and m[1] in _MONTHS:
            return _ms(datetime(int(m[3]), _MONTHS[m[1]], int(m[2])))
    except ValueError:
        pass
    if low == "yesterday":
        return now_ms - 86_400_000
    if (m := re.fullmatch(r"(\d+) ([a-z]+?)s? ago", low)) and m[2] in _NAMES:
        return now_ms - int(m[1]) * _UNITS[_NAMES[m[2]]] * 1000
    raise QueryError("INVALID_TIMEREF", f"not a timeref: {text!r}")


def parse_history_timeref(text: str, now_ms: int) -> int:
    """The narrow form of the history and runtime routes: a timestamp or a duration."""
    raw = text.strip().strip("\"'")
    got = _rfc3339(raw)
    got = _ago(raw.lower(), now_ms) if got is None else got
    if got is None:
        raise QueryError("INVALID_TIMEREF", f"not a timestamp or duration: {text!r}")
    return got


def at_midnight(now: datetime) -> datetime:
    return now.replace(hour=0, minute=0, second=0, microsecond=0) - timedelta(0)

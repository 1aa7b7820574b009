"""Lexer, parser, normal form, translation, time references and patterns: plain Python."""

import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkseek.functions.regexes import check_scope_regex, check_text_regex
from sparkseek.functions.text import boundary_bonus, components, fold_text, nfc_offsets, osa, query_tokens, snippet
from sparkseek.functions.timeref import parse_history_timeref, parse_timeref
from sparkseek.functions.vectors import hash_embed
from sparkseek.operators.paging import Cursors
from sparkseek.plans.ast import All, Any, Empty, Keyword, Not, Phrase, Predicate, Raw, Regex, normal, normalize, query_hash
from sparkseek.plans.errors import QueryError
from sparkseek.plans.parser import parse
from sparkseek.plans.translate import CodeSearch, from_web_syntax
from sparkseek.sources.chunkers import byte_windows, cut_lines


def refused(code, f, *args):
    with pytest.raises(QueryError) as e:
        f(*args)
    assert e.value.code == code


def test_precedence_and_leaves():
    assert parse("a OR b c").expr == Any((Keyword("a"), All((Keyword("b"), Keyword("c")))))
    assert parse("NOT a b").expr == All((Not(Keyword("a")), Keyword("b")))
    assert parse("-a").expr == Not(Keyword("a")) and parse("a-b").expr == Keyword("a-b")
    assert parse("\"x y\" 'z' /w+/").expr == All((Phrase("x y"), Raw("z"), Regex("w+")))
    assert parse("(a OR b) AND c").expr == All((Any((Keyword("a"), Keyword("b"))), Keyword("c")))
    assert isinstance(parse("repo.has.topic(x)").expr, Predicate)
    q = parse("a repo:x lang:EN case:yes count:7 boost:2.5")
    assert q.expr == Keyword("a") and q.values("repo") == ["x"] and q.options.case and q.options.count == 7 and q.options.boost_millis == 2500


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ('"open', "UNCLOSED_QUOTE"), ("(a", "SYNTAX_ERROR"), ("a AND", "SYNTAX_ERROR"), ("OR a", "SYNTAX_ERROR"), ("nosuch:x", "UNKNOWN_FILTER"),
        ("a count:0", "INVALID_FILTER_VALUE"), ("fork:maybe a", "INVALID_FILTER_VALUE"), ("a~2", "FORBIDDEN_SYNTAX"), ("a" * 17_000, "LIMIT_EXCEEDED_BYTES"),
        ("(" * 40 + "a" + ")" * 40, "LIMIT_EXCEEDED_DEPTH"), ("-lang:en a", "UNSUPPORTED_COMBO"), ("repo:x@main a", "UNSUPPORTED_COMBO"),
    ],
)
def test_refusals(text, code):
    refused(code, lambda: normalize(parse(text)))


def test_normal_form():
    assert normal(Not(Not(Keyword("a")))) == Keyword("a")
    assert normal(All((Keyword("b"), All((Keyword("a"), Keyword("b")))))) == All((Keyword("a"), Keyword("b")))
    assert query_hash(normalize(parse("a b"))) == query_hash(normalize(parse("b a b")))
    assert query_hash(normalize(parse("a b"))) != query_hash(normalize(parse("a OR b")))
    assert normalize(parse("/(?i)abc/ case:yes")).options.case is False
    refused("EMPTY_QUERY", lambda: normalize(parse("")))


words = st.text(string.ascii_lowercase, min_size=1, max_size=4).filter(lambda w: w != "match")
trees = st.recursive(
    words.map(Keyword) | words.map(Phrase) | words.map(Raw),
    lambda inner: st.lists(inner, min_size=1, max_size=3).map(lambda x: All(tuple(x))) | st.lists(inner, min_size=1, max_size=3).map(lambda x: Any(tuple(x))) | inner.map(Not),
    max_leaves=8,
)


@settings(max_examples=200, deadline=None)
@given(trees)
def test_normalizing_twice_changes_nothing(e):
    once = normal(e)
    assert normal(once) == once and not isinstance(once, Empty)


@settings(max_examples=300, deadline=None)
@given(st.text(string.ascii_letters + " ()\"'/:-.{}~\\", max_size=30))
def test_any_text_parses_or_is_refused(text):
    for f in (lambda t: normalize(parse(t)), from_web_syntax):
        try:
            f(text)
        except QueryError:
            pass


def test_web_syntax():
    q = from_web_syntax("r:x f:y l:go needle")
    assert q.values("repo") == ["x"] and q.values("file") == ["y"] and q.values("lang") == ["go"] and q.expr == Keyword("needle")
    assert from_web_syntax("foo.*bar patterntype:regexp").expr == Regex("foo.*bar")
    refused("UNSUPPORTED_COMBO", from_web_syntax, "-r:x needle")
    c = CodeSearch('a b -c typo:widgte components:"clean up"')
    assert sorted(c.terms) == ["a", "b"] and c.without == ["c"] and c.typo == ["widgte"] and c.components == [["clean", "up"]]


def test_patterns():
    assert check_text_regex("a+b") == "a+b"
    for bad in ("(?=x)", "(a)\\1", "a++", "("):
        with pytest.raises(QueryError):
            check_text_regex(bad)
    for bad in ("^x", "x\\b", "x+?"):
        with pytest.raises(QueryError):
            check_scope_regex(bad)


def test_time_references():
    now = 1_700_000_000_000
    day = 86_400_000
    assert parse_timeref("7d", now) == now - 7 * day and parse_timeref("2 weeks ago", now) == now - 14 * day and parse_timeref("1mo", now) == now - 30 * day
    assert parse_timeref("yesterday", now) == now - day and parse_timeref("1970-01-02", now) == day == parse_timeref("January 2, 1970", now)
    assert parse_timeref("1970-01-01T00:00:01+00:00", now) == 1000 == parse_history_timeref("1970-01-01T00:00:01Z", now)
    assert parse_history_timeref("3h", now) == now - 3 * 3_600_000
    for bad in ("yesterday", "2 weeks ago", "1970-01-02"):
        refused("INVALID_TIMEREF", parse_history_timeref, bad, now)
    refused("INVALID_TIMEREF", parse_timeref, "soon", now)


def test_text_contract():
    assert fold_text("ΟΔΟΣ") == "οδοσ" and fold_text("ß") == "ß" and fold_text("İ") == "i̇"
    assert query_tokens("foo_bar foo.bar नमस्ते") == ["foo_bar", "foo", "bar", "नमस्ते"]
    for bad in ("...", "x" * 300):
        refused("NO_TERMS", query_tokens, bad)
    assert components("cleanUp") == ["clean", "up"] and components("URLParser2") == ["url", "parser", "2"] and components("home_unix") == ["home", "unix"] and components("é") == []
    assert osa("abc", "acb") == 1 and osa("abc", "abd") == 1 and osa("ca", "abc") == 3
    cut, spans = snippet("a" * 500 + " needle " + "b" * 500, ["needle"])
    assert "needle" in cut and len(cut.encode()) <= 240 and spans == [(501, 507)]
    assert nfc_offsets("éx") == [(0, 1, 0, 2), (1, 2, 2, 3)]


def test_boundary_bonus(spark):
    # Name, term, bonus.
    table = [
        ("fooBar", "Bar", 16), ("foo_bar", "bar", 16), ("HTTPServer", "Server", 16), ("HTTPServer", "HTTP", 16), ("parse2Value", "2", 16),
        ("fooBarSuffix", "Bar", 16), ("foobar", "bar", 0), ("fooBar", "ar", 0), ("needle", "needle", 0), ("éNeedle", "Needle", 0),
    ]
    more = [("fooBarbaz", "Bar", 8), ("foobar/bar", "bar", 0), ("needle/needle", "needle", 0), ("a.b_c", "b_", 16), ("a.b_cd", "_c", 8), ("foobar fooBar", "bar", 16), ("x", "yy", 0)]
    for name, term, want in table + more:
        assert spark.range(1).select(boundary_bonus(F.lit(name), term)).first()[0] == want, (name, term)


def test_embedding_is_a_unit_vector():
    v = hash_embed("some words here")
    assert len(v) == 64 and sum(x * x for x in v) == pytest.approx(1)
    assert hash_embed("some words here") == v != hash_embed("other words")


def test_cursors_are_bound_to_their_query():
    c = Cursors(b"secret")
    token = c.issue("lexical", "q", "pin", [1.0, "a"])
    assert c.read(token, "lexical", "q", "pin") == [1.0, "a"]
    for other in (("symbol", "q", "pin"), ("lexical", "r", "pin"), ("lexical", "q", "old")):
        refused("INVALID_CURSOR", c.read, token, *other)
    refused("INVALID_CURSOR", Cursors(b"x").read, token, "lexical", "q", "pin")


def test_line_chunks_cover_the_text():
    text = "ab\n" * 40 + "x" * 50
    parts = cut_lines(text, 20)
    assert "".join(text[a:b] for a, b in parts) == text


@given(st.text(alphabet="ab é漢\n\r", max_size=60), st.integers(1, 9), st.integers(0, 8))
def test_byte_windows(text, size, overlap):
    if overlap >= size:
        return
    raw = text.encode()
    spans = byte_windows(text, size, overlap)
    assert not raw and not spans or spans[0][0] == 0 and spans[-1][1] == len(raw)
    lines = [len(x.encode()) for x in re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$", text)]
    ends = {sum(lines[: k + 1]) for k in range(len(lines))}
    for k, (s, e) in enumerate(spans):
        raw[s:e].decode()  # whole characters
        assert s < e and e in ends and (e >= min(len(raw), s + size - 3))
        assert k == 0 or s <= spans[k - 1][1] and spans[k - 1][0] < s <= spans[k - 1][0] + size - overlap + 3

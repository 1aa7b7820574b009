"""Symbols by word, exact name or component; and code search over files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import boundary_bonus, cased, components_column, has_phrase, nfc, fold_text, query_tokens, tokens, within_one_edit
from ..plans.ast import All, Any, Empty, Keyword, Not, Predicate, Query
from ..plans.errors import QueryError
from ..plans.translate import CodeSearch
from ..sources.snapshot import Snapshot
from .paging import check_top_k

def exact_name(column: str, value: str, case: bool) -> Column:
    text = nfc(value) if case else fold_text(nfc(value))
    return cased(F.col(column), case) == F.lit(text)


def has_components(name: Column, parts: list[str]) -> Column:
    """The parts stand side by side, in order, among the name's camel and snake parts."""
    return has_phrase(components_column(name), [p.lower() for p in parts])


def _any_with(words: Column, parts: list[str]) -> Column:
    """Whether any of the words has the parts."""
    return F.exists(words, lambda w: has_components(w, parts))


def search(s: Snapshot, q: Query, k: int) -> DataFrame:
    """Symbol rows whose name holds the words; exact predicates compare whole names."""
    check_top_k(k)
    case = q.options.case
    rows = s.need("symbols")
    names = tokens(cased(F.concat_ws(" ", "local_name", "qualified_name"), case))

    def condition(e) -> Column:
        if isinstance(e, Empty):
            return F.lit(True)
        if isinstance(e, Not):
            return ~condition(e.of)
        if isinstance(e, (All, Any)):
            return reduce(Column.__and__ if isinstance(e, All) else Column.__or__, [condition(x) for x in e.of])
        if isinstance(e, Keyword):
            return has_phrase(names, query_tokens(e.text, case))
        if isinstance(e, Predicate) and e.name.startswith("symbol.") and e.args:
            value = e.args[0][1]
            if e.name == "symbol.has.name":
                return exact_name("local_name", value, case) | exact_name("qualified_name", value, case)
            return exact_name(e.name.split(".")[1], value, case)
        raise QueryError("UNSUPPORTED_LEAF", "the symbol route takes words and symbol predicates")

    for f in q.filters:
        if f.name == "lang":
            rows = rows.where(F.col("lang") == f.value.strip().lower())
        elif f.name in ("repo", "file"):
            rows = rows.where(F.col("repo" if f.name == "repo" else "path").rlike(f"^(?:{f.value})$"))
        elif f.name not in ("type", "select"):
            raise QueryError("UNSUPPORTED_FILTER", f"{f.name}: is not a filter of the symbol route")
    exact = F.lit(0.0)
    for e in [q.expr] if isinstance(q.expr, Keyword) else []:
        exact = F.when(exact_name("local_name", e.text, case), F.lit(2.0)).otherwise(F.lit(1.0))
    rows = rows.where(condition(q.expr)).withColumn("score", exact)
    return rows.orderBy(F.col("score").desc(), "repo", "path", "start_line", "end_line", "symbol_id").limit(k)


def declaration_bonus(name: Column, term: str) -> Column:
    """64 for the whole name, 32 at an edge, 16 inside it."""
    low = F.lower(name)
    t = F.lit(term.lower())
    return F.when(low == t, 64).when(F.startswith(low, t) | F.endswith(low, t), 32).when(F.contains(low, t), 16).otherwise(0)


def occurrences(text: Column, term: str) -> Column:
    n = len(term)
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(n)).cast("int")


def code_search(s: Snapshot, text: str, k: int) -> DataFrame:
    """The best ``k`` of ``code_search_rows``."""
    check_top_k(k)
    return code_search_rows(s, text).orderBy(F.col("score").desc(), "repo", "path").limit(k)


def code_search_rows(s: Snapshot, text: str) -> DataFrame:
    """Files in which every term stands, in the text or the path, with the components of their score.

    A whole-token match in its own case scores ``100 + 5 + 2 * (occurrences - 1)``:
    16-point boundaries lie under the fixed 100 of the best place. What lies beyond
    that case is this library's own choice and documented as such.
    """
    want = CodeSearch(text)
    from ..plans.compile import Compiler

    compiler = Compiler(s, want.query, 0)
    rows = s.need("chunks")
    for c in compiler.filters()[0]:
        rows = compiler.base.where(c) if rows is s.chunks else rows.where(c)
    low, words = F.lower("text"), tokens(F.col("text"))
    folded_words = tokens(low)
    files = rows
    terms = list(want.terms)
    parts: list[Column] = []
    for i, t in enumerate(terms):
        whole = F.array_contains(folded_words, t.lower())
        place = F.when(whole, 100).when(F.contains(low, F.lit(t.lower())), 60).when(F.contains(F.lower("path"), F.lit(t.lower())), 40).otherwise(0)
        parts += [
            F.max(place).alias(f"place{i}"),
            F.sum(occurrences(low, t.lower())).alias(f"n{i}"),
            F.max(F.when(F.contains("text", F.lit(t)), 5).otherwise(0)).alias(f"case{i}"),
        ]
    for j, t in enumerate(want.without):
        parts.append(F.max((F.contains(low, F.lit(t.lower())) | F.contains(F.lower("path"), F.lit(t.lower()))).cast("int")).alias(f"no{j}"))
    for j, t in enumerate(want.typo):
        near = F.exists(folded_words, lambda w: within_one_edit(w, t.lower()))
        parts.append(F.max(F.when(F.array_contains(folded_words, t.lower()), 2).when(near, 1).otherwise(0)).alias(f"typo{j}"))
    for j, p in enumerate(want.components):
        parts.append(F.max(_any_with(words, p).cast("int")).alias(f"comp{j}"))
    grouped = files.groupBy("repo", "path").agg(*parts, F.min("candidate_id").alias("candidate_id"))
    keep = [F.col(f"place{i}") > 0 for i in range(len(terms))] + [F.col(f"no{j}") == 0 for j in range(len(want.without))]
    keep += [F.col(f"typo{j}") > 0 for j in range(len(want.typo))] + [F.col(f"comp{j}") > 0 for j in range(len(want.components))]
    for c in keep:
        grouped = grouped.where(c)
    zero = F.lit(0)
    boundary = sum((F.col(f"place{i}") for i in range(len(terms))), zero)
    boundary = boundary + sum((F.col(f"typo{j}") * 50 for j in range(len(want.typo))), zero) + sum((F.col(f"comp{j}") * 100 for j in range(len(want.components))), zero)
    repeats = sum((F.greatest(F.lit(0), F.col(f"n{i}") - 1) * 2 for i in range(len(terms))), zero)
    exact = sum((F.col(f"case{i}") for i in range(len(terms))), zero)
    out = grouped.select(
        "repo", "path", "candidate_id", boundary.cast("long").alias("boundary_and_path"), repeats.cast("long").alias("occurrence"),
        exact.cast("long").alias("exact_case"), F.lit(0).cast("long").alias("proximity"),
    )
    out = out.withColumn("score", F.col("boundary_and_path") + F.col("occurrence") + F.col("exact_case") + F.col("proximity"))
    return out


def code_search_study(s: Snapshot, text: str) -> DataFrame:
    """What other scores would make of the files of a code search: with the bonus of declarations, of parts of
    identifiers, of both, and with occurrences at half weight or none.

    A term's declaration bonus is the best among the file's symbols, its boundary bonus the best in
    text and path; the terms' add up. The score of ``code_search`` itself has neither.
    """
    rows, terms = code_search_rows(s, text), CodeSearch(text).terms
    zero = F.lit(0)
    places = s.need("chunks").groupBy("repo", "path").agg(
        *[F.greatest(F.max(boundary_bonus(F.col("text"), t)), F.max(boundary_bonus(F.col("path"), t))).alias(f"b{i}") for i, t in enumerate(terms)], F.lit(1).alias("__one")
    )
    rows = rows.join(places, ["repo", "path"]).withColumn("boundary_bonus", sum((F.col(f"b{i}") for i in range(len(terms))), zero).cast("long"))
    if s.symbols is not None:
        named = s.symbols.groupBy("repo", "path").agg(*[F.max(declaration_bonus(F.col("local_name"), t)).alias(f"d{i}") for i, t in enumerate(terms)], F.lit(1).alias("__two"))
        rows = rows.join(named, ["repo", "path"], "left")
        declared = sum((F.coalesce(F.col(f"d{i}"), zero) for i in range(len(terms))), zero)
    else:
        declared = zero
    rest = F.col("score") - F.col("occurrence")
    rows = rows.withColumn("declaration_bonus", declared.cast("long"))
    return rows.select(
        "repo", "path", "candidate_id", "declaration_bonus", "boundary_bonus", F.col("score").alias("baseline"),
        (F.col("score") + F.col("declaration_bonus")).alias("declaration_only"), (F.col("score") + F.col("boundary_bonus")).alias("boundary_only"),
        (rest + F.floor(F.col("occurrence") / 2)).alias("occurrence_half"), rest.alias("occurrence_none"),
        (rest + F.col("declaration_bonus") + F.col("boundary_bonus")).alias("combined"),
    )


def with_typo_fallback(s: Snapshot, text: str, k: int) -> DataFrame:
    """Plain code search; if it finds nothing for a single identifier, that identifier within one edit."""
    found = code_search(s, text, k)
    word = text.strip()
    if word.isascii() and word.isidentifier() and 3 <= len(word) <= 64 and found.isEmpty():
        return code_search(s, f"typo:{word}", k)
    return found

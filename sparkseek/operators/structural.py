"""Structural search on flattened parse trees, and the algebra of binding sets."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regexes import check_text_regex
from ..functions.text import query_tokens
from ..plans.errors import QueryError

MOST_NODES, MOST_DEPTH, MOST_VARS, MOST_BINDINGS = 256, 16, 32, 256
_PART = re.compile(r"\s*(\$\.\.\.[A-Za-z_]\w*|\.\.\.|\$[A-Za-z_]\w*|\(|\)|[^\s()$]+)")


def parse_pattern(body: str) -> list:
    """Literals, ``$x``, ``$...xs``, ``...`` and groups in parentheses."""
    out: list = []
    stack = [out]
    names, n, at = set(), 0, 0
    text = body.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise QueryError("TOKEN_INVALID", f"unexpected {text[at]!r} in a pattern", at)
        p, at, n = m[1], m.end(), n + 1
        if p == "(":
            group: list = []
            stack[-1].append(("group", group))
            stack.append(group)
        elif p == ")":
            if len(stack) == 1:
                raise QueryError("SYNTAX_ERROR", "a ) too many in a pattern", at)
            stack.pop()
        elif p == "...":
            stack[-1].append(("many", None))
        elif p.startswith("$..."):
            names.add(p[4:])
            stack[-1].append(("many", p[4:]))
        elif p[0] == "$":
            names.add(p[1:])
            stack[-1].append(("one", p[1:]))
        else:
            stack[-1].append(("literal", p))
        if n > MOST_NODES or len(stack) > MOST_DEPTH or len(names) > MOST_VARS:
            raise QueryError("LIMIT_EXCEEDED_STRUCTURAL", "the pattern is too large")
    if len(stack) > 1:
        raise QueryError("SYNTAX_ERROR", "no closing ) in a pattern")
    return out


def parse_block(body: str) -> dict:
    """A ``match`` body: a pattern, then ``where``, ``inside`` and ``outside`` parts."""
    parts = re.split(r"\b(where|inside|outside)\s*\{", body)
    block = {"pattern": parse_pattern(parts[0].rstrip().rstrip(",;")), "where": [], "inside": [], "outside": []}
    for kind, rest in zip(parts[1::2], parts[2::2], strict=True):
        inner = rest[: rest.rfind("}")] if "}" in rest else None
        if inner is None:
            raise QueryError("SYNTAX_ERROR", f"no closing }} after {kind}")
        if kind == "where":
            for clause in filter(None, (c.strip() for c in inner.split(","))):
                m = re.fullmatch(r"\$(?:\.\.\.)?(\w+)\s*==\s*(.+)", clause, re.S)
                if not m:
                    raise QueryError("SYNTAX_ERROR", f"not a constraint: {clause}")
                right = m[2].strip()
                if right[0] == "$":
                    block["where"].append((m[1], "hole", right.lstrip("$.")))
                elif right[0] == "/":
                    block["where"].append((m[1], "regex", check_text_regex(right.strip("/"))))
                elif right[0] == '"':
                    block["where"].append((m[1], "phrase", right.strip('"')))
                else:
                    block["where"].append((m[1], "raw", right.strip("'")))
        else:
            block[kind].append(parse_pattern(inner))
    if sum(kind == "regex" for _, kind, _ in block["where"]) > 8:
        raise QueryError("LIMIT_EXCEEDED_STRUCTURAL", "at most 8 patterns in where")
    return block


def _match(pattern: list, nodes: list, bound: dict, at: int = 0, i: int = 0):
    """All ways in which the pattern covers ``nodes[i:]``, as bindings of names to text."""
    if at == len(pattern):
        if i == len(nodes):
            yield bound
        return
    kind, value = pattern[at]
    if kind == "many":
        for j in range(i, len(nodes) + 1):
            text = " ".join(x["text"] for x in nodes[i:j])
            if value is None or bound.get(value, text) == text:
                yield from _match(pattern, nodes, bound if value is None else {**bound, value: text}, at + 1, j)
        return
    if i >= len(nodes):
        return
    node = nodes[i]
    if kind == "literal" and value in (node["text"], node["kind"]):
        yield from _match(pattern, nodes, bound, at + 1, i + 1)
    elif kind == "one" and bound.get(value, node["text"]) == node["text"]:
        yield from _match(pattern, nodes, {**bound, value: node["text"]}, at + 1, i + 1)
    elif kind == "group":
        for inner in _match(value, node["children"], bound):
            yield from _match(pattern, nodes, inner, at + 1, i + 1)


def _tokens(text: str) -> list[str]:
    try:
        return query_tokens(text)
    except QueryError:  # a text without words
        return []


def _has_run(tokens: list[str], wanted: list[str]) -> bool:
    """Whether the wanted tokens stand side by side among the tokens."""
    n = len(wanted)
    return any(tokens[i : i + n] == wanted for i in range(len(tokens) - n + 1))


def _holds(block: dict, bound: dict) -> bool:
    for name, kind, right in block["where"]:
        left = bound.get(name)
        if left is None:
            return False
        if kind == "hole" and left != bound.get(right):
            return False
        if kind == "raw" and left != right:
            return False
        if kind == "phrase" and not _has_run(_tokens(left), query_tokens(right)):
            return False
        if kind == "regex" and not re.search(right, left):
            return False
    return True


def match_trees(nodes: DataFrame, body: str) -> DataFrame:
    """``(candidate_id, start, end, bindings)``: matches of a block among the children of any node, a tree at a time.

    A tree is one document's and bounded by it; trees are independent.
    """
    block = parse_block(body)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = {r.node_id: {"kind": r.kind, "text": r.text, "start": r.start, "end": r.end, "children": []} for r in pdf.itertuples()}
        for r in pdf.sort_values("ord").itertuples():
            if r.parent_id in made:
                made[r.parent_id]["children"].append(made[r.node_id])
        around = {k: [(x["start"], x["end"]) for x in made.values() for p in block[k] if any(True for _ in _match([("many", None), *p, ("many", None)], x["children"], {}))] for k in ("inside", "outside")}
        out = []
        for x in made.values():
            kids = x["children"]
            for i in range(len(kids)):
                for j in range(i + 1, len(kids) + 1):
                    start, end = kids[i]["start"], kids[j - 1]["end"]
                    if block["inside"] and not any(a <= start and end <= b for a, b in around["inside"]):
                        continue
                    if any(a <= start and end <= b for a, b in around["outside"]):
                        continue
                    for bound in _match(block["pattern"], kids[i:j], {}):
                        if _holds(block, bound):
                            out.append((pdf.candidate_id.iloc[0], start, end, json.dumps(bound, sort_keys=True, ensure_ascii=False)))
                        if len(out) > MOST_BINDINGS * max(1, len(made)):
                            raise QueryError("LIMIT_EXCEEDED_STRUCTURAL", "too many matches in one tree")
        return pd.DataFrame(sorted(set(out)), columns=["candidate_id", "start", "end", "bindings"])

    kind = nodes.schema["candidate_id"].dataType.simpleString()
    found = nodes.groupBy("tree_id").applyInPandas(run, f"candidate_id {kind}, start long, end long, bindings string")
    return found.withColumn("bindings", F.from_json("bindings", "map<string,string>"))


def consistent(a: str = "a", b: str = "b"):
    """Names that both sides bind have the same text."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.forall(shared, lambda k: F.element_at(F.col(a), k) == F.element_at(F.col(b), k))


def both(left: DataFrame, right: DataFrame) -> DataFrame:
    """AND: rows of one candidate whose bindings agree, with all of them."""
    l, r = left.withColumnRenamed("bindings", "a"), right.select("candidate_id", F.col("bindings").alias("b"))
    rest = F.map_filter("b", lambda k, _: ~F.array_contains(F.map_keys("a"), k))
    return l.join(r, "candidate_id").where(consistent()).select("candidate_id", "start", "end", F.map_concat("a", rest).alias("bindings"))


def either(left: DataFrame, right: DataFrame) -> DataFrame:
    """OR: rows of either side, once for each span and set of bindings."""
    named = F.to_json(F.array_sort(F.map_entries("bindings")))
    return left.unionByName(right).withColumn("__named", named).dropDuplicates(["candidate_id", "start", "end", "__named"]).drop("__named")


def without(left: DataFrame, right: DataFrame) -> DataFrame:
    """AND NOT: rows to which no row of the other side of the same candidate is consistent."""
    l = left.withColumnRenamed("bindings", "a").alias("l")
    r = right.select(F.col("candidate_id").alias("rid"), F.col("bindings").alias("b"))
    return l.join(r, (F.col("candidate_id") == F.col("rid")) & consistent(), "left_anti").withColumnRenamed("a", "bindings")


def projected(rows: DataFrame) -> DataFrame:
    """The smallest match of each candidate."""
    named = F.to_json(F.array_sort(F.map_entries("bindings")))
    best = F.min_by(F.struct("start", "end", "bindings"), F.struct((F.col("end") - F.col("start")).alias("size"), "start", named.alias("named")))
    return rows.groupBy("candidate_id").agg(best.alias("m")).select("candidate_id", "m.start", "m.end", "m.bindings")

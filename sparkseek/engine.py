"""The query routes: text in, one bounded DataFrame of one snapshot out, or a typed refusal."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import query_tokens, snippet
from .functions.vectors import hash_embed
from .operators import dense, fusion, graph, history, runtime, structural, symbols
from .operators.paging import RANKED, boosted, check_top_k, group_first, page, projected_count
from .plans.ast import All, Any, Empty, Filter, Keyword, Phrase, Predicate, Query, Raw, Structural, normalize, positive_leaves, query_hash
from .plans.compile import Compiler, LEXICAL_FILTERS
from .plans.errors import QueryError
from .plans.parser import parse
from .plans.translate import from_web_syntax
from .sources.snapshot import Snapshot

DEFAULT_COUNT = 50
_SHOWN = ["candidate_id", "repo", "path", "lang", "start_line", "end_line", "score"]


@dataclass
class Constraints:
    """What a caller fixes before ranking. Two languages sets meet; an empty meeting is a proven contradiction."""

    languages: frozenset[str] | None = None
    path: str | None = None

    def meet(self, other: Constraints) -> tuple[Constraints, bool]:
        if self.languages is None or other.languages is None:
            languages = self.languages if other.languages is None else other.languages
        else:
            languages = self.languages & other.languages
        clash = languages is not None and not languages
        if self.path and other.path and self.path != other.path:
            clash = True
        return Constraints(languages, self.path or other.path), clash


class Engine:
    def __init__(self, snapshot: Snapshot, now_ms: int | None = None, embed: Callable[[str], list[float]] = hash_embed, model_id: str = "hash-64"):
        self.s = snapshot
        self.now_ms = round(time.time() * 1000) if now_ms is None else now_ms
        self.embed, self.model_id = embed, model_id

    # planning

    def plan(self, text: str | Query, syntax: str = "lq", constraints: Constraints | None = None) -> tuple[Query, bool]:
        """The normalized query, and whether the constraints contradict it."""
        if isinstance(text, Query):
            q = text
        elif syntax == "web":
            q = from_web_syntax(text)
        elif syntax == "lq":
            q = normalize(parse(text))
        else:
            raise QueryError("UNSUPPORTED_COMBO", f"unknown syntax {syntax}")
        languages = frozenset(v.strip().lower() for v in q.values("lang"))
        clash = len(languages) > 1
        if constraints:
            own = Constraints(languages or None)
            met, contradicted = own.meet(constraints)
            clash |= contradicted
            if met.languages and not languages and len(met.languages) == 1:
                q = replace(q, filters=(*q.filters, Filter("lang", next(iter(met.languages)))))
        return q, clash

    def _lexical_rows(self, q: Query, constraints: Constraints | None = None) -> DataFrame:
        rows = Compiler(self.s, q, self.now_ms).compile().result()
        if constraints and constraints.languages:
            rows = rows.where(F.col("lang").isin(sorted(constraints.languages)))
        if constraints and constraints.path:
            rows = rows.where(F.col("path") == constraints.path)
        rows = rows.withColumn("score", F.round("score", 6))
        return boosted(rows.select(*_SHOWN), q.options.boost_millis)

    # routes

    def lexical(self, text: str | Query, k: int = DEFAULT_COUNT, syntax: str = "lq", after: list | None = None, constraints: Constraints | None = None) -> DataFrame:
        """Chunks in page order; with ``select:`` the best chunk of each repository or file."""
        check_top_k(k)
        q, clash = self.plan(text, syntax, constraints)
        rows = self._lexical_rows(q, constraints)
        if clash:
            return rows.limit(0)
        if isinstance(q.options.count, int):
            k = min(k, q.options.count)
        select = (q.values("select") or [""])[0]
        if select == "repo":
            rows = group_first(rows, ["repo"], RANKED)
        elif select in ("file", "path", "file.owners"):
            rows = group_first(rows, ["repo", "path"], RANKED)
        elif select == "symbol":
            raise QueryError("UNSUPPORTED_COMBO", "select:symbol belongs to the symbol route")
        out = page(rows, RANKED, k, after)
        if select == "file.owners":
            out = out.join(self.s.need("owners").select("repo", "path", "owners"), ["repo", "path"], "left")
        return out

    def matches(self, text: str | Query, syntax: str = "lq") -> DataFrame:
        """Every row that matches, in no order: a scope for joins, not a page."""
        q, clash = self.plan(text, syntax)
        rows = self._lexical_rows(q)
        return rows.limit(0) if clash else rows

    def count(self, text: str | Query, syntax: str = "lq") -> DataFrame:
        """One row: the exact total of matching rows or groups."""
        q, clash = self.plan(text, syntax)
        rows = self._lexical_rows(replace(q, options=replace(q.options, index="no")))
        select = (q.values("select") or [""])[0]
        if select:
            rows = rows.select(*(["repo"] if select == "repo" else ["repo", "path"])).distinct()
        return projected_count(rows.limit(0) if clash else rows)

    def symbol(self, text: str | Query, k: int = DEFAULT_COUNT, syntax: str = "lq") -> DataFrame:
        return symbols.search(self.s, self.plan(text, syntax)[0], k)

    def code_search(self, text: str, k: int = DEFAULT_COUNT, fallback: bool = False) -> DataFrame:
        return (symbols.with_typo_fallback if fallback else symbols.code_search)(self.s, text, k)

    def _vectors(self) -> DataFrame:
        if self.s.model_id != self.model_id:
            raise QueryError("MODEL_MISMATCH", f"the index has {self.s.model_id}, the query {self.model_id}")
        return self.s.need("embeddings")

    def semantic(self, query: str | list[float], k: int = DEFAULT_COUNT, scope: str | None = None, scope_top_k: int = 1000, corpus: str | None = None, where=None) -> DataFrame:
        """Exact cosine top-k, over all vectors, a corpus, or the ids of a lexical page."""
        rows = self._vectors()
        if corpus is not None:
            rows = rows.where(F.col("corpus") == corpus)
        v = self.embed(query) if isinstance(query, str) else query
        if scope is not None:
            return dense.scoped_top_k(rows, self.lexical(scope, scope_top_k), v, k)
        return dense.top_k(rows, v, k, where)

    def hybrid(self, text: str, query: str | list[float], k: int = 10, corpora: list[str] | None = None, by_file: bool = False, hint: list[str] | None = None) -> DataFrame:
        """Lexical and dense lanes by reciprocal rank; the query's filters admit dense rows before they are ranked."""
        check_top_k(k)
        depth = min(max(k, dense.OVERFETCH), 10_000)
        q, _ = self.plan(text)
        unknown = [f.name for f in q.filters if f.name not in LEXICAL_FILTERS]
        if unknown:
            raise QueryError("UNSUPPORTED_FILTER", f"{unknown[0]}: is not a filter of the hybrid route")
        lexical = self._lexical_rows(q)
        vectors = self._vectors()
        if q.filters:
            admitted = self._lexical_rows(replace(q, expr=Empty(), options=replace(q.options, index="no"))).select("candidate_id")
            vectors = vectors.join(admitted, "candidate_id", "left_semi")
        v = self.embed(query) if isinstance(query, str) else query
        key = "candidate_id"
        if by_file or hint:
            key = "file"
            lexical = lexical.withColumn("file", F.concat_ws("\0", "repo", "path"))
            vectors = vectors.withColumn("file", F.concat_ws("\0", "repo", "path"))
        lanes = [fusion.lane(lexical, "lexical", depth, key, RANKED)]
        for c in corpora or [None]:
            part = vectors if c is None else vectors.where(F.col("corpus") == c)
            lanes.append(fusion.lane(dense.scored(part, v, digits=9), f"dense:{c}" if c else "dense", depth, key))
        fused = fusion.rrf(lanes, "lexical")
        if hint:
            framed = F.lit(0)
            for place, name in enumerate(hint):
                framed = framed + F.when(F.endswith(F.col("id"), F.lit(name)), 1 << (len(hint) - place)).otherwise(0)
            return fused.orderBy(framed.desc(), F.col("score").desc(), F.col("in_first").desc(), "id").limit(k)
        return fusion.fused_page(fused, k)

    def hybrid_seed(self, text: str, query: str | list[float], corpora: list[str], k: int = 10) -> DataFrame:
        return self.hybrid(text, query, k, corpora)

    def test_trace(self, trace: str, k: int = 10) -> DataFrame:
        """Files for a failing test's trace: those of its first frames first, in their order, then fused rank."""
        import re

        frames = list(dict.fromkeys(re.findall(r"([\w./-]+\.go):\d+", trace)))[:16]
        words = [w for w in re.findall(r"[A-Za-z_]\w{2,}", trace)][:16]
        if not words:
            raise QueryError("EMPTY_QUERY", "the trace has no word")
        return self.hybrid(" OR ".join(dict.fromkeys(words)), trace, k, by_file=True, hint=frames or None)

    def history(self, text: str, k: int = DEFAULT_COUNT, order: str = "recency", after: list | None = None) -> DataFrame:
        return history.search(self.s, self.plan(text)[0], k, self.now_ms, order, after)

    def runtime(self, text: str, k: int = DEFAULT_COUNT, after: list | None = None) -> DataFrame:
        return runtime.search(self.s, self.plan(text)[0], k, self.now_ms, after)

    def structural(self, text: str, k: int = DEFAULT_COUNT) -> DataFrame:
        """A page of ``structural_rows`` by candidate."""
        check_top_k(k)
        return self.structural_rows(text).orderBy("candidate_id").limit(k)

    def structural_rows(self, text: str) -> DataFrame:
        """Blocks joined by AND, OR and NOT on one candidate with consistent bindings; words admit candidates."""
        q, _ = self.plan(text)
        nodes = self.s.need("nodes")

        def rows(e) -> DataFrame:
            if isinstance(e, Structural):
                return structural.match_trees(nodes, e.body)
            if isinstance(e, Any):
                out = rows(e.of[0])
                for x in e.of[1:]:
                    out = structural.either(out, rows(x))
                return out
            if isinstance(e, All):
                blocks = [x for x in e.of if isinstance(x, (Structural, Any))]
                if not blocks:
                    raise QueryError("UNSUPPORTED_COMBO", "a structural query needs a block that is not negated")
                out = rows(blocks[0])
                for x in blocks[1:]:
                    out = structural.both(out, rows(x))
                for x in e.of:
                    if type(x).__name__ == "Not":
                        out = structural.without(out, rows(x.of))
                    elif isinstance(x, (Keyword, Phrase, Raw, Predicate)):
                        ids = self._lexical_rows(Query(x)).select("candidate_id")
                        out = out.join(ids, "candidate_id", "left_semi")
                return out
            raise QueryError("UNSUPPORTED_LEAF", "the structural route needs a match block")

        return structural.projected(rows(q.expr))

    def repo_map(self, text: str, k: int = 50, budget: int = 4096, focus: list[str] = (), focus_paths: list[str] = ()) -> DataFrame:
        return graph.repo_map(self.s.need("entries"), text, k, budget, focus, focus_paths)

    def neighbours(self, ids: list[str], direction: str = "out", kinds: list[str] | None = None) -> DataFrame:
        return graph.neighbours(self.s.need("graph_edges"), ids, direction, kinds)

    def cluster_members(self, cards: list) -> DataFrame:
        return self.s.need("clusters").where(F.col("card").isin(cards)).orderBy("card", "member")

    # explanation

    def explain(self, candidate, text: str, syntax: str = "lq") -> dict:
        """Not indexed, not matched, or matched with what each positive leaf adds; and the steps of the plan."""
        q, _ = self.plan(text, syntax)
        known = self.s.need("chunks").where(F.col("candidate_id") == candidate)
        out = {"query_hash": query_hash(q), "domains": self.s.domains(), "stages": ["parse", "normalize", "plan", "filter", "predicate", "score"]}
        if known.isEmpty():
            return out | {"outcome": "NotIndexed"}
        named = [x for x in positive_leaves(q.expr) if not isinstance(x, Predicate)]
        c = Compiler(self.s, q, self.now_ms).compile(tuple(named))
        parts = [x.alias(f"part{i}") for i, x in enumerate(c.parts)]
        row = c.rows.where(F.col("candidate_id") == candidate).select(c.match.alias("m"), c.score.alias("score"), *parts).first()
        if row is None or not row["m"]:
            return out | {"outcome": "NotMatched"}
        boost = q.options.boost_millis / 1000
        return out | {
            "outcome": "Matched", "engine_score": row["score"], "boost": boost, "emitted": row["score"] * boost,
            "leaves": [(repr(x), row[f"part{i}"]) for i, x in enumerate(named)],
        }

    def admitted(self, ids: DataFrame, text: str) -> DataFrame:
        """Which of the ids the plan admits."""
        q, _ = self.plan(text)
        return ids.join(self._lexical_rows(q).select("candidate_id"), "candidate_id", "left_semi")

    def rendered(self, rows: DataFrame, text: str, width: int = 240) -> list[dict]:
        """Snippets and match spans of a returned page, at most ``k`` rows, on the driver."""
        q, _ = self.plan(text)
        needles = []
        for x in positive_leaves(q.expr):
            if isinstance(x, (Keyword, Phrase)):
                needles += query_tokens(x.text, q.options.case)
            elif isinstance(x, Raw):
                needles.append(x.text)
        texts = rows.join(self.s.need("chunks").select("candidate_id", "text"), "candidate_id")
        out = []
        for r in texts.orderBy(F.col("score").desc(), "repo", "path").collect():
            cut, spans = snippet(r["text"], needles, q.options.case, width)
            out.append({"candidate_id": r["candidate_id"], "snippet": cut, "spans": spans})
        return out

"""What one query reads: the pinned tables of one generation."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_name, fold, tokens
from ..plans.errors import QueryError


@dataclass
class Snapshot:
    """Tables by read domain; an absent one refuses the queries that need it.

    chunks(candidate_id, repo, path, lang, start_line, end_line, text)
    symbols(symbol_id, repo, path, lang, kind, local_name, qualified_name, start_line, end_line)
    embeddings(candidate_id, vector, corpus); one row for each embedded owner
    repos(repo, latest_commit_ms, meta map<string,string>, topics, description, fork, archived, visibility, contexts)
    owners(repo, path, owners array<string>); contributors(repo, path, contributors array<struct<canonical,name,email>>)
    commits(sha, parents, author, author_email, committer, message, committer_time_ms, author_time_ms, is_merge)
    hunks(sha, path, header, added, removed, touched); refs(name, sha); tags(name, sha)
    dirty(candidate_id, applied_at_ms); changed(path, applied_at_ms); facets(candidate_id, owner, service, layer, surface)
    snapshots(name, candidate_id); affected(key, candidate_id); invalidated(key, candidate_id); head(head_ms, materialized_ms)
    nodes(tree_id, candidate_id, node_id, parent_id, ord, kind, start, end, text); entries: the repository map
    graph_nodes(id, digest); graph_edges(kind, source, target); clusters(card, member)
    postings(term, candidate_id, tf, length, positions) and totals(n, mean): the index of this generation's chunks
    """

    chunks: DataFrame | None = None
    symbols: DataFrame | None = None
    embeddings: DataFrame | None = None
    repos: DataFrame | None = None
    owners: DataFrame | None = None
    contributors: DataFrame | None = None
    commits: DataFrame | None = None
    hunks: DataFrame | None = None
    refs: DataFrame | None = None
    tags: DataFrame | None = None
    dirty: DataFrame | None = None
    changed: DataFrame | None = None
    facets: DataFrame | None = None
    snapshots: DataFrame | None = None
    affected: DataFrame | None = None
    invalidated: DataFrame | None = None
    head: DataFrame | None = None
    nodes: DataFrame | None = None
    entries: DataFrame | None = None
    graph_nodes: DataFrame | None = None
    graph_edges: DataFrame | None = None
    clusters: DataFrame | None = None
    postings: DataFrame | None = None
    totals: DataFrame | None = None
    model_id: str = "hash-64"

    def need(self, name: str) -> DataFrame:
        table = getattr(self, name)
        if table is None:
            raise QueryError("DOMAIN_UNAVAILABLE", f"this generation has no {name}")
        return table

    def domains(self) -> list[str]:
        return [f.name for f in fields(self) if f.name != "model_id" and getattr(self, f.name) is not None]


def analysed(chunks: DataFrame, case: bool = False) -> DataFrame:
    """Chunks with what the leaves of a query read; unused columns are pruned."""
    shown = F.col("text") if case else fold(F.col("text"))
    path = F.col("path") if case else fold(F.col("path"))
    return (
        chunks.withColumn("__text", shown).withColumn("__path", path)
        .withColumn("__tokens", tokens(F.col("__text"))).withColumn("__path_tokens", tokens(F.col("__path")))
        .withColumn("__name", file_name(F.col("path")))
    )

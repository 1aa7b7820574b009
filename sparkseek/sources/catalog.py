"""Generations on a shared folder: publish, seal, activate, roll back, compare.

Every generation of a domain is a folder of Parquet files that never changes once
sealed. Publication is not visibility: a generation is read by default only after its
activation. All files are written and read by Spark or through Hadoop's file
system, so the folder may be in any store that Spark reaches.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nfc_udf
from ..functions.vectors import unit
from ..operators.bm25 import postings, totals
from ..plans.errors import QueryError
from .snapshot import Snapshot

DOMAINS = frozenset(f.name for f in fields(Snapshot)) - {"model_id"}
#: The columns that name the scope which a publication replaces.
SCOPES = {
    "chunks": ["repo", "path"], "symbols": ["repo", "path"], "embeddings": ["candidate_id"], "repos": ["repo"], "owners": ["repo", "path"],
    "contributors": ["repo", "path"], "commits": ["sha"], "hunks": ["sha", "path"], "refs": ["name"], "tags": ["name"], "dirty": ["candidate_id"],
    "changed": ["path"], "facets": ["candidate_id"], "snapshots": ["name"], "affected": ["key"], "invalidated": ["key"], "head": [],
    "nodes": ["tree_id"], "entries": ["identity"], "graph_nodes": ["id"], "graph_edges": ["source"], "clusters": ["card"], "postings": ["candidate_id"], "totals": [],
}


def batch_digest(rows: DataFrame) -> str:
    """The same for the same rows in any order or partitioning."""
    text = F.to_json(F.struct(*sorted(rows.columns)))
    sums = rows.select(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), F.reverse(text)).alias("b")).agg(
        F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))
    )
    return hashlib.sha256(json.dumps([str(x) for x in sums.first()] + [rows.schema.simpleString()]).encode()).hexdigest()


def scope_delta(base: DataFrame, fresh: DataFrame, scope: list[str], tombstones: DataFrame | None = None) -> DataFrame:
    """The base without replaced and removed scopes, and the fresh rows."""
    left = base.join(fresh.select(*scope).distinct(), scope, "left_anti")
    if tombstones is not None:
        left = left.join(tombstones.select(*scope).distinct(), scope, "left_anti")
    return left.unionByName(fresh, allowMissingColumns=True)


def source_diff(old: DataFrame, new: DataFrame, owner: list[str]) -> DataFrame:
    """Owners that were added, changed or removed between two views, by digest of their rows."""

    def digests(rows: DataFrame, name: str) -> DataFrame:
        rest = [c for c in sorted(rows.columns) if c not in owner]
        each = F.sha2(F.to_json(F.struct(*rest)), 256)
        return rows.groupBy(*owner).agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(each))), 256).alias(name))

    both = digests(old, "before").join(digests(new, "after"), owner, "full_outer")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select(*owner, kind.alias("change"))


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils
        self._charset = jvm.java.nio.charset.StandardCharsets.UTF_8

    # small files

    def _put(self, name: str, value, exclusive: bool = False) -> bool:
        path = self._path(f"{self.root}/{name}")
        if exclusive and not self._fs.createNewFile(path):
            return False
        out = self._fs.create(path, True)
        out.write(json.dumps(value).encode())
        out.close()
        return True

    def _get(self, name: str):
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        source = self._fs.open(path)
        try:
            return json.loads(self._io.toString(source, self._charset) or "null")
        finally:
            source.close()

    def _folder(self, domain: str, generation: int, staged: bool = False) -> str:
        if domain not in DOMAINS:
            raise QueryError("DOMAIN_UNAVAILABLE", f"there is no domain {domain}")
        return f"{self.root}/{'_staging/' if staged else ''}{domain}/generation={generation}"

    def exists(self, domain: str, generation: int) -> bool:
        return self._fs.exists(self._path(self._folder(domain, generation)))

    # publication

    def _admit(self, event: str | None, rows: DataFrame) -> bool:
        """Whether an event is new; the same rows again are a replay, others a conflict."""
        if event is None:
            return True
        digest = batch_digest(rows)
        known = self._get(f"_ledger/{event}.json")
        if known is None:
            return True
        if known != digest:
            raise QueryError("BATCH_CONFLICT", f"event {event} was published with other rows")
        return False

    def publish(self, domain: str, generation: int, rows: DataFrame, parent: int | None = None, tombstones: DataFrame | None = None, event: str | None = None) -> bool:
        """Write a domain of a generation: the rows alone, or the parent's with these scopes replaced and removed.

        False if the event has been published before with the same rows.
        """
        if self._get(f"_sealed/{generation}.json") is not None:
            raise QueryError("GENERATION_CONFLICT", f"generation {generation} is sealed")
        if not self._admit(event, rows):
            return False
        out = rows
        if parent is not None:
            if not self.exists(domain, parent):
                raise QueryError("STALE_BATCH", f"the parent {parent} of {domain} does not exist")
            out = scope_delta(self.read(domain, parent), rows, SCOPES[domain], tombstones)
        if domain == "chunks":
            out = out.withColumn("text", nfc_udf("text")).withColumn("path", nfc_udf("path"))
        if domain == "embeddings":
            first = rows.select(F.size("vector").alias("n")).first()
            out = out.withColumn("vector", unit(F.col("vector"), first["n"] if first else 0))
        cluster = [c for c in ("repo", "lang") if c in out.columns]
        if domain == "postings":
            cluster = ["term"]
        if cluster:
            out = out.sortWithinPartitions(*cluster)
        out.write.mode("overwrite").parquet(self._folder(domain, generation))
        if event is not None:
            self._put(f"_ledger/{event}.json", batch_digest(rows))
        return True

    def stage(self, domain: str, generation: int, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self._folder(domain, generation, staged=True))

    def publish_staged(self, domain: str, generation: int, **how) -> bool:
        done = self.publish(domain, generation, self.spark.read.parquet(self._folder(domain, generation, staged=True)), **how)
        self.discard(domain, generation)
        return done

    def discard(self, domain: str, generation: int) -> None:
        self._fs.delete(self._path(self._folder(domain, generation, staged=True)), True)

    def clear(self, domain: str, generation: int) -> None:
        if self._get(f"_sealed/{generation}.json") is not None:
            raise QueryError("GENERATION_CONFLICT", f"generation {generation} is sealed")
        self._fs.delete(self._path(self._folder(domain, generation)), True)

    def index(self, generation: int) -> None:
        """Postings of the generation's chunks, clustered by term so that a query reads its terms' row groups, and their totals."""
        chunks = self.read("chunks", generation)
        self.publish("postings", generation, postings(chunks).repartitionByRange("term"))
        self.publish("totals", generation, totals(chunks))

    def seal(self, generation: int, parent: int | None = None) -> None:
        if not self._put(f"_sealed/{generation}.json", {"parent": parent, "domains": sorted(d for d in DOMAINS if self.exists(d, generation))}, exclusive=True):
            raise QueryError("GENERATION_CONFLICT", f"generation {generation} is sealed already")

    # visibility

    def _log(self) -> list[int | None]:
        """Activated generations in order, one file each, created exclusively. There is no second file that has to agree
        with them; an empty one is that of a writer that stopped before it wrote, and counts for nothing."""
        folder = self._path(f"{self.root}/_activations")
        if not self._fs.exists(folder):
            return []
        places = [int(n[:-5]) for x in self._fs.listStatus(folder) if (n := x.getPath().getName()).endswith(".json") and n[0] != "."]
        return [self._get(f"_activations/{k}.json") for k in range(max(places, default=-1) + 1)]

    def active(self) -> int | None:
        return next((g for g in reversed(self._log()) if g is not None), None)

    def activate(self, generation: int, expected: int | None) -> None:
        """Make a sealed generation the active one, if the active one is still ``expected``."""
        if self._get(f"_sealed/{generation}.json") is None:
            raise QueryError("GENERATION_NOT_FOUND", f"generation {generation} is not sealed")
        log = self._log()
        now = next((g for g in reversed(log) if g is not None), None)
        if now != expected:
            raise QueryError("GENERATION_CONFLICT", f"active is {now}, not {expected}")
        if not self._put(f"_activations/{len(log)}.json", generation, exclusive=True):
            raise QueryError("GENERATION_CONFLICT", "another activation came first")

    def rollback(self) -> int:
        log = [g for g in self._log() if g is not None]
        if len(log) < 2:
            raise QueryError("GENERATION_NOT_FOUND", "there is no generation to go back to")
        self.activate(log[-2], log[-1])
        return log[-2]

    def resolve(self, pinned: int | None = None) -> int:
        generation = self.active() if pinned is None else pinned
        if generation is None or self._get(f"_sealed/{generation}.json") is None:
            raise QueryError("GENERATION_NOT_FOUND", f"no sealed generation {generation}")
        return generation

    # reading

    def read(self, domain: str, generation: int) -> DataFrame:
        return self.spark.read.parquet(self._folder(domain, generation))

    def snapshot(self, pinned: int | None = None) -> Snapshot:
        """One generation's tables; all reads of a query come from it."""
        generation = self.resolve(pinned)
        return Snapshot(**{d: self.read(d, generation) for d in self._get(f"_sealed/{generation}.json")["domains"]})

    def status(self) -> DataFrame:
        listed = self._fs.listStatus(self._path(f"{self.root}/_sealed")) if self._fs.exists(self._path(f"{self.root}/_sealed")) else []
        rows = [(int(x.getPath().getName()[:-5]), int(x.getPath().getName()[:-5]) == self.active()) for x in listed if x.getPath().getName().endswith(".json") and x.getPath().getName()[0] != "."]
        return self.spark.createDataFrame(rows, "generation long, active boolean").orderBy("generation")


def path_inventory(chunks: DataFrame, k: int, repo: str | None = None, after: tuple[str, str] | None = None) -> DataFrame:
    """Files in order of repository and path, after a key."""
    rows = chunks.select("repo", "path").distinct()
    if repo is not None:
        rows = rows.where(F.col("repo") == repo)
    if after is not None:
        rows = rows.where((F.col("repo") > after[0]) | ((F.col("repo") == after[0]) & (F.col("path") > after[1])))
    return rows.orderBy("repo", "path").limit(k)

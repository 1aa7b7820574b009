"""Ordered, idempotent micro-batches into a generation's overlay tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.errors import QueryError
from ..sources.catalog import Catalog


def last_rows(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key, tombstones among them."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("r")).select("r.*")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last state of each key; a row of kind ``tombstone`` removes it."""
    return last_rows(rows, key, order).where(F.col("kind") != "tombstone")


class Ingest:
    """Applies each micro-batch once: its id is its event, its rows its digest.

    A batch that declares an older parent than the head is refused. State is the
    latest row of each key over the batches applied so far, one folder for each;
    ``compact`` replaces all batches up to the head by their last rows, so that
    reading the state does not grow with the stream's age.
    """

    def __init__(self, catalog: Catalog, stream: str):
        self.catalog, self.stream = catalog, stream
        self.folder = f"{catalog.root}/_streams/{stream}"

    def head(self) -> int:
        return self.catalog._get(f"_streams/{self.stream}.head.json") or 0

    def apply(self, rows: DataFrame, batch: int, parent: int | None = None) -> bool:
        head = self.head()
        if parent is not None and parent < head and batch > head:
            raise QueryError("STALE_BATCH", f"the head is {head}, the batch expects {parent}")
        if not self.catalog._admit(f"{self.stream}-{batch}", rows):
            return False
        if batch <= self._through():
            raise QueryError("STALE_BATCH", f"batches up to {self._through()} are compacted")
        from ..sources.catalog import batch_digest

        rows.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        self.catalog._put(f"_ledger/{self.stream}-{batch}.json", batch_digest(rows))
        self.catalog._put(f"_streams/{self.stream}.head.json", max(head, batch))
        return True

    def sink(self):
        """For ``writeStream.foreachBatch``: replays of a batch are applied once."""

        def each(rows: DataFrame, batch: int) -> None:
            self.apply(rows, batch + 1)

        return each

    def _through(self) -> int:
        return self.catalog._get(f"_streams/{self.stream}.base.json") or 0

    def _rows(self, spark: SparkSession) -> DataFrame:
        through = self._through()
        rows = spark.read.parquet(self.folder).where(F.col("batch") > through)
        return rows.unionByName(spark.read.parquet(f"{self.folder}.base/through={through}")) if through else rows

    def compact(self, spark: SparkSession, key: list[str], order: str) -> int:
        """Write the last row of each key, and then that it stands for all batches up to the head. Tombstones stay: a
        later batch may still bring an older row. A compaction that stops half way has changed nothing."""
        head = self.head()
        if head > self._through():
            last_rows(self._rows(spark), key, order).write.mode("overwrite").parquet(f"{self.folder}.base/through={head}")
            self.catalog._put(f"_streams/{self.stream}.base.json", head)
        return head

    def state(self, spark: SparkSession, key: list[str], order: str) -> DataFrame:
        return latest(self._rows(spark), key, order)


def freshness(rows: DataFrame, staged: str, seen: str) -> DataFrame:
    """Nearest-rank percentiles of the time from staging to visibility."""
    delay = F.col(seen) - F.col(staged)
    return rows.select(delay.alias("ms")).agg(*[F.expr(f"percentile_disc({p}) within group (order by ms)").alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)])

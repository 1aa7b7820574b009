"""A session's settings, and the library on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED = "__sparkseek_shipped"
#: Bytes of a batch of rows that is sent to Python; one longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def session(name: str = "sparkseek", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one named by ``spark.checkpoint.dir`` or set as the checkpoint folder. Only
    on one machine, as in tests, a temporary one is made; on a cluster its lack is an error, as
    executors cannot see one another's local folders.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(made)
    return made


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches of some ``BATCH_BYTES`` each.

    By default a batch has 10,000 rows; of long texts that is hundreds of MB, held by
    the JVM outside its heap and again by the Python worker. The session setting
    holds when the plan runs, so it is left set.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that was written to the shared one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library: by its folder, and on a cluster as an archive."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return spark
    known = context.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if HOME not in known.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [HOME, known]))
        if not context.master.startswith("local"):
            archive = os.path.join(tempfile.mkdtemp(prefix="sparkseek-"), "sparkseek.zip")
            with zipfile.ZipFile(archive, "w") as z:
                for folder, _, names in os.walk(os.path.join(HOME, "sparkseek")):
                    for n in names:
                        if n.endswith(".py"):
                            path = os.path.join(folder, n)
                            z.write(path, os.path.relpath(path, HOME))
            context.addPyFile(archive)
    setattr(context, _SHIPPED, True)
    return spark

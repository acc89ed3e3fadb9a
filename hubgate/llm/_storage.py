"""Shared scratch storage: tables that cut lineage, written where every executor can read them."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])


#: Rows in an Arrow batch where the session has Spark's default of 10,000, which for texts is tens of MB on either side.
_BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package even if the driver put it on sys.path by hand, and keep Arrow batches
    small. Results do not depend on the batches."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(_BATCH_ROWS))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _PACKAGE_ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_PACKAGE_ROOT, have) if x)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only on a local master that sets none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder once and return the table that was written.

    Later steps read files that survive lost executors instead of recomputing; the schema is kept, so the
    reread needs no inference and an empty table stays readable. ``narrow`` is for tables of ids and numbers:
    eight partitions of a shuffle are written as one file.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if narrow:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned, once everything that reads them is written itself."""
    for table in tables:
        for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
            folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are done: it does so when the driver collects what stood for
    them, which may be long after."""
    gc.collect()
    spark._jvm.System.gc()


#: So many long keys (some 20 MB as a hash table) are broadcast, whatever the session's own threshold is.
BROADCAST_KEYS = 1 << 20


def only(rows: DataFrame, key: str, keys: DataFrame, count: int, how: str = "left_semi") -> DataFrame:
    """``rows`` whose long ``key`` is (or, with left_anti, is not) among the one column of ``keys``, at most ``count``
    of them: few keys are broadcast, so the rows stay where they are read; more are joined by a shuffle."""
    return rows.join(F.broadcast(keys) if count <= BROADCAST_KEYS else keys.hint("merge"), key, how)

"""Session settings and lineage cuts.

A lineage cut is a table written to the shared checkpoint folder and read
back, so a lost executor never forces a long recomputation and a loop's plan
stays short.  The folder is taken from ``spark.checkpoint.dir``; only a local
session without that setting gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a large table that one task takes at a time.
TASK_ROWS = 1 << 19


def build_session(app: str = "somagrid", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators rely on (AQE, UTC, Arrow)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
        if master.startswith("local"):
            b = b.config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="somagrid-"))
    return sc.getCheckpointDir().rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """Mark rows that an ``explode`` has multiplied.

    Spark's size estimate does not see the multiplication, so it might broadcast
    such a side unchecked; the hint holds up to the next join and asks for a
    shuffled one, where adaptive execution still splits skewed keys.
    """
    return df.hint("merge")


def shared_out(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` (of about ``rows`` rows) dealt by ``keys`` to tasks of about ``TASK_ROWS`` rows, if it is large.

    Spark puts shuffle partitions together by their compressed size, which for voxels is a small part of what an aggregate
    or sort of them takes; tables with fewer rows for every task are left to it."""
    tasks = rows // TASK_ROWS
    return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` once no plan reads it any more."""
    path = getattr(df, "_cut_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)

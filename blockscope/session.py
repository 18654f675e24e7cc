"""Session settings the library relies on, and where it may write shared files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
ARROW_BYTES = 4 << 20


def prepare_session(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on (UTC) and keep runtime re-planning on."""
    for key, value in (
        ("spark.sql.session.timeZone", "UTC"),
        ("spark.sql.adaptive.enabled", "true"),
        ("spark.sql.adaptive.skewJoin.enabled", "true"),
        ("spark.sql.adaptive.coalescePartitions.enabled", "true"),
        # rows sent to Python workers at once, for tables of long texts
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES)),
    ):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session, whose
    driver and executors are one machine, gets a fresh folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="blockscope-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The frame's rows written to the shared folder, for frames that several branches read.

    They are computed once, survive the loss of executors, and the plan starts anew.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one job's files below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

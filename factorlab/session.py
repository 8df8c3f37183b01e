"""Session helpers: where lineage is cut and how wide shuffles are."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# Rows of sums that a task may hold at once.
TASK_ROWS = 1_000_000


def table_partitions(spark: SparkSession, rows: int) -> int:
    """The session's shuffle width, or as many partitions as keep TASK_ROWS rows each."""
    return max(shuffle_partitions(spark), -(-rows // TASK_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a machine-local folder: on a cluster, executors could not read it back.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="factorlab-")
    spark.sparkContext.setCheckpointDir(made)
    return made


# Spark drops the shuffle files of an execution as soon as it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Materialize ``df`` reliably and forget its lineage (survives lost executors).

    ``tidy`` drops what it shuffled, which is not read again once ``df`` is written: otherwise the
    files stay until the driver's garbage collector finds them, and a fit keeps those of all its steps.
    """
    spark = df.sparkSession
    base = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    if not tidy:
        return df.checkpoint(eager=True)
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query is planned with the setting of its time
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, for a table that is written and read back."""
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"

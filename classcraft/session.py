"""Session helpers: one place that knows how a job is configured.

On a cluster the session is given to us; we only read settings from it.
Local defaults (tests, bench) are applied only where a setting is unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings we want everywhere; never overwrite what the cluster already set.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "classcraft") -> SparkSession:
    """A local session for tests and the bench (UI off, small shuffles)."""
    # Python workers import this package wherever the job was started
    root = str(Path(__file__).resolve().parents[1])
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [root, os.environ.get("PYTHONPATH")]))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CLASSCRAFT_DRIVER_MEMORY", "8g"))
    )
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/S3/ABFS) folder there and we use it as is.
    Only a local master may leave it unset: driver and executors are one machine then, and a
    scratch folder is made. Elsewhere an unset folder is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="classcraft-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table between two steps, in the shared folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a table between two steps once nothing reads it any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


ROWS_A_TASK = 25_000          # fewer rows are not worth a task of their own
MOST_ROWS_A_TASK = 250_000    # so that what a task holds does not grow with the table


def task_count(spark: SparkSession, n: int, work: int = 1) -> int:
    """Partitions for ``n`` rows that are worth ``work`` common rows each: two a core if the work is worth it, more only where a task
    would get too many rows."""
    return max(1, min(-(-n * work // ROWS_A_TASK), 2 * spark.sparkContext.defaultParallelism), -(-n // MOST_ROWS_A_TASK))


def dealt(rows: DataFrame, n: int | None = None, work: int = 1) -> DataFrame:
    """``rows`` (``n`` of them) dealt evenly to ``task_count`` partitions: a table from one small file is one partition, and all
    that is worked out from it would be one task's work."""
    parts = task_count(rows.sparkSession, rows.count() if n is None else n, work)
    return rows.repartition(parts) if parts > 1 else rows


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt evenly to as many partitions as shuffles have: a table that many passes read may come from one small file."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, key) if key in rows.columns else rows.repartition(parts)

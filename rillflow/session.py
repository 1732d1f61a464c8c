"""Session helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, and sends them batches of 2,000 rows.

    Where the package is installed on the executors, the former changes nothing."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{have}" if have else ROOT
    if spark.conf.get(BATCH) == "10000":  # the default: long texts make such batches too large for small executors
        spark.conf.set(BATCH, "2000")
    return spark


_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder given to setCheckpointDir; a folder of the driver only in local mode."""
    context = spark.sparkContext
    if shared := spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return shared
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="rillflow-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored_table(df, name: str):
    """Writes `df` to the shared folder once and returns a reader of it: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder as root

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` once and returns a reader of it: lineage ends at the files, which go when the driver ends."""
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the table stands for the plan from here on, whose shuffle files may go
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    system, where = _hadoop(spark, path)
    system.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    system, where = _hadoop(spark, path)
    system.delete(where, True)


class Scope:
    """Tables that are not needed once the operator has written its last one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        out, path = stored(df, name)
        self.paths.append(path)
        return out

    def close(self) -> None:
        for path in self.paths:
            drop(self.spark, path)
        self.paths.clear()

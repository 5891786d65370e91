"""Folders under the one that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def delete_folder(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, kind: str = "stream") -> str:
    """A new folder under the one that driver and executors share; it is deleted when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    where = f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"

    def close() -> None:
        try:
            delete_folder(spark, where)
        except Exception:  # the JVM may have ended first
            pass

    atexit.register(close)
    return where


def stored(df: DataFrame, kind: str) -> DataFrame:
    """df as a table in a new shared folder, so that what reads it more than once does not make it again."""
    where = shared_folder(df.sparkSession, kind)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)

"""The file catalog: listings, status, statistics, and the upkeep of its counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STATUS_MESSAGE, mapped

UNKNOWN = "状态未知"


def listing(files: DataFrame) -> DataFrame:
    return files.select("file_id", "original_filename", "file_size", "status", "processing_progress", "upload_time").orderBy(F.desc("upload_time"), "file_id")


def point(files: DataFrame, file_id: str) -> DataFrame:
    return files.filter(F.col("file_id") == file_id).limit(1)


def rename(files: DataFrame, key: Column, name: str, column: str) -> DataFrame:
    return files.withColumn(column, F.when(key, F.lit(name)).otherwise(F.col(column)))


def with_status(files: DataFrame, live: DataFrame) -> DataFrame:
    """While a file is processing, progress and message come from the live status (file_id, progress, message), where there is one."""
    own = live.select("file_id", F.col("progress").alias("__p"), F.col("message").alias("__m"))
    on = F.col("status") == "processing"
    return files.join(own, "file_id", "left").select("file_id", "status", F.when(on, F.coalesce("__p", "processing_progress")).otherwise(F.col("processing_progress")).alias("progress"), F.coalesce(F.when(on, F.col("__m")), mapped(F.col("status"), STATUS_MESSAGE, UNKNOWN)).alias("message"))


def latest_status(log: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    return log.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("r")).select(key, "r.*")


def daily_stats(files: DataFrame) -> DataFrame:
    """Per day of creation: files, files by status, mean size, sums of the counters."""
    states = ("completed", "processing", "failed")
    return files.groupBy(F.to_date("created_at").alias("processing_date")).agg(
        F.count("*").alias("total_files"), *[F.count_if(F.col("status") == s).alias(f"{s}_files") for s in states],
        F.avg("file_size").alias("avg_file_size"), *[F.sum(f"total_{c}").alias(f"total_{c}") for c in ("chunks", "images", "tables")],
    )


def counters(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """files with the counts of their chunks by type, derived from the chunks instead of kept by a trigger."""
    kinds = {"total_chunks": "text", "total_images": "image", "total_tables": "table"}
    own = chunks.groupBy("file_id").agg(*[F.count_if(F.col("content_type") == k).alias(c) for c, k in kinds.items()])
    return files.join(own, "file_id", "left").select(*files.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in kinds])


def type_counts(chunks: DataFrame) -> DataFrame:
    kinds = ("text", "image", "table", "chart")
    return chunks.groupBy("file_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("content_type") == k).alias(k) for k in kinds])


def statistics(files: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per file: its chunks, nodes and edges; each side is summed before it is joined."""
    out = files.select("file_id")
    for name, df in (("chunks", chunks), ("entities", nodes), ("relations", edges)):
        out = out.join(df.groupBy("file_id").agg(F.count("*").alias(name)), "file_id", "left")
    return out.select("file_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks", "entities", "relations")])

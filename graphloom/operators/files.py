"""Files from upload to deletion: checks and catalog rows, details, and deletion from every table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import upload_checks
from . import catalog, graph

# What an upload is answered.
BAD_TYPE, BAD_SIZE, ACCEPTED = "不支持的文件类型，仅支持: pdf", "文件大小超过限制 (100MB)", "文件上传成功，GraphRAG处理已开始"


def register(uploads: DataFrame, folder: str) -> DataFrame:
    """uploads (file_id, original_filename, size, uploaded_at) with their catalog row's eight columns, and success and message.

    A file is stored under its id and second of arrival. Rows that are refused have no path and no status.
    """
    type_ok, size_ok = upload_checks(F.col("original_filename"), F.col("size"))
    ok = F.coalesce(type_ok & size_ok, F.lit(False))
    name = F.concat("file_id", F.lit("_"), F.unix_timestamp("uploaded_at").cast("string"), F.lit(".pdf"))
    message = F.when(~F.coalesce(type_ok, F.lit(False)), F.lit(BAD_TYPE)).when(~F.coalesce(size_ok, F.lit(False)), F.lit(BAD_SIZE)).otherwise(F.lit(ACCEPTED))
    return uploads.select(
        "file_id", "original_filename", F.when(ok, name).alias("filename"), F.when(ok, F.concat(F.lit(folder.rstrip("/") + "/"), name)).alias("file_path"), F.col("size").alias("file_size"),
        F.col("uploaded_at").alias("upload_time"), F.when(ok, F.lit("uploaded")).alias("status"), F.lit(0).alias("processing_progress"), ok.alias("success"), message.alias("message"),
    )


def accepted(registered: DataFrame) -> DataFrame:
    """The catalog rows of what was registered."""
    return registered.filter("success").drop("success", "message")


def details(files: DataFrame, live: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per file its catalog columns, its progress and message as they stand, and how many chunks, entities and relations it has."""
    status = catalog.with_status(files, live).select("file_id", "progress", "message")
    return files.join(status, "file_id").join(catalog.statistics(files, chunks, nodes, edges), "file_id")


def delete(file_id: str, files: DataFrame, chunks: DataFrame, vectors: DataFrame, media: DataFrame, nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """What is left of every table without a file: catalog, chunks, vectors, media of its chunks, nodes with their edges, edges."""
    other = F.col("file_id") != file_id
    gone = chunks.filter(F.col("file_id") == file_id).select("chunk_id")
    left_nodes, left_edges = graph.detach_delete(nodes, edges, file_id)
    return {"files": files.filter(other), "chunks": chunks.filter(other), "vectors": vectors.filter(other), "media": media.join(gone, "chunk_id", "left_anti"), "nodes": left_nodes, "edges": left_edges}


def new_sessions(requests: DataFrame, now: Column) -> DataFrame:
    """A session (session_id, title, status, session_created, updated_at) per request (session_id, title)."""
    return requests.select("session_id", F.coalesce("title", F.lit("")).alias("title"), F.lit("active").alias("status"), now.alias("session_created"), now.alias("updated_at"))

"""Streams: ingestion of pages into chunks, latest status by key, bounded session history, and session windows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import chunking
from ..operators.sessions import KEPT, line
from ..sources.folders import shared_folder  # noqa: F401


def source(spark: SparkSession, path: str, files_per_batch: int = 16, schema: StructType | None = None) -> DataFrame:
    """New Parquet files under path, as a stream with the schema of those there, or the one given; a single file is watched in its folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    single = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    stream = spark.readStream.schema(schema or spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    if single:
        folder, _, name = path.rstrip("/").rpartition("/")
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


def drain(stream: DataFrame, out: str, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over what is there now, one folder per micro-batch, and reads all of it with its batch number.

    A batch that is run again after a failure writes its own folder again, so the result holds each row once.
    """

    def keep(batch: DataFrame, number: int) -> None:
        (each(batch, number) if each else batch).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    spark = stream.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/rows")
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)  # there was nothing, so no batch ran
    reader = spark.read.schema(schema) if each is None else spark.read
    return reader.option("basePath", f"{out}/rows").parquet(f"{out}/rows")


def ingest(pages: DataFrame, out: str) -> DataFrame:
    """Chunk records of a stream of pages (file_id, page_number, text)."""
    return drain(chunking.chunk_records(pages), out)


def latest_status(log: DataFrame, out: str) -> DataFrame:
    """Per file the last (ts, seq) entry of a stream of (file_id, ts, seq, progress, message): updates of each batch, the last of a key wins."""
    now = log.groupBy("file_id").agg(F.max_by(F.struct("ts", "seq", "progress", "message"), F.struct("ts", "seq")).alias("r")).select("file_id", "r.*")
    rows = drain(now, out, "update")
    return rows.groupBy("file_id").agg(F.max_by(F.struct("progress", "message"), "batch").alias("r")).select("file_id", "r.*")


def bounded_history(messages: DataFrame, out: str, most: int = KEPT) -> DataFrame:
    """Per session the last lines of a stream of (session_id, turn, role, text), as keyed state of at most `most` lines."""

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        for f in frames:
            held += [[int(t), x] for t, x in zip(f["turn"], f["line"], strict=True)]
        held = sorted(held)[-most:]
        state.update((json.dumps(held),))
        yield pd.DataFrame({"session_id": [key[0]], "history": ["\n".join(x for _, x in held)]})

    lines = messages.select("session_id", "turn", line(F.col("role"), F.col("text")).alias("line"))
    rows = drain(lines.groupBy("session_id").applyInPandasWithState(keep, "session_id long, history string", "held string", "update", "NoTimeout"), out, "update")
    return rows.groupBy("session_id").agg(F.max_by("history", "batch").alias("history"))


def _sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def session_windows(events: DataFrame, out: str, gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream of (user_id, ts) that have ended: one is put out, and leaves the state, once the watermark is past its end."""
    return drain(_sessions(events.withWatermark("ts", late), gap), out).drop("batch")


def open_sessions(events: DataFrame, closed: DataFrame, gap: str = "24 hours") -> DataFrame:
    """Sessions that stand open, from a batch read of the events (user_id, ts): of each user those after the last closed session."""
    last = closed.groupBy("user_id").agg(F.max("end").alias("last"))
    left = events.join(last, "user_id", "left").filter(F.col("last").isNull() | (F.col("ts") >= F.col("last")))
    return _sessions(left.select("user_id", "ts"), gap)

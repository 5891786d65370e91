"""Queries that run a stream over what is there and read its table; their SQL is that of the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import load
from ..streaming import jobs, sessions
from . import text_plans
from .registry import query


@query("g01_stream_ingest", text_plans._RECORDS)
def g01_stream_ingest(spark, sf_dir):
    d = jobs.source(spark, f"{sf_dir}/documents.parquet")
    pages = d.select(F.concat("source", F.lit("_"), F.col("doc_id").cast("string")).alias("file_id"), F.pmod("doc_id", F.lit(9)).cast("int").alias("page_number"), "text")
    return jobs.ingest(pages, jobs.shared_folder(spark)).select("chunk_id", "file_id", "content_type", "content", "page_number", "chunk_index", "metadata.length", "metadata.language")


@query("g02_stream_status", "SELECT user_id AS file_id, max_by(event_id % 101, (ts, event_id)) AS progress, max_by(event_type, (ts, event_id)) AS message FROM events GROUP BY user_id")
def g02_stream_status(spark, sf_dir):
    e = jobs.source(spark, f"{sf_dir}/events.parquet")
    log = e.select(F.col("user_id").alias("file_id"), "ts", F.col("event_id").alias("seq"), F.pmod("event_id", F.lit(101)).alias("progress"), F.col("event_type").alias("message"))
    return jobs.latest_status(log, jobs.shared_folder(spark))


@query(
    "g04_stream_history",
    """SELECT conv_id AS session_id, string_agg(CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || ': ' || text, chr(10) ORDER BY turn) AS history
       FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) GROUP BY conv_id""",
)
def g04_stream_history(spark, sf_dir):
    c = jobs.source(spark, f"{sf_dir}/conversations.parquet")
    return jobs.bounded_history(c.select(F.col("conv_id").alias("session_id"), "turn", "role", "text"), jobs.shared_folder(spark), 3)


@query(
    "g05_stream_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 24 HOUR THEN 0 ELSE 1 END AS new FROM events),
       s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
       SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS end, count(*) AS n FROM s GROUP BY user_id, k""",
)
def g05_stream_sessions(spark, sf_dir):
    own = lambda df: df.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    closed = jobs.session_windows(own(jobs.source(spark, f"{sf_dir}/events.parquet")), jobs.shared_folder(spark))
    out = closed.unionByName(jobs.open_sessions(own(load(spark, sf_dir, "events")), closed))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n")


@query(
    "g05_stateful_sessions",
    """WITH e AS (SELECT user_id, event_id, ts, event_type, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 24 HOUR THEN 0 ELSE 1 END AS new FROM events),
       s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e),
       r AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) AS back FROM s)
       SELECT user_id AS session_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, count(*) AS n, string_agg(event_type, chr(10) ORDER BY ts, event_id) FILTER (WHERE back <= 10) AS history FROM r GROUP BY user_id, k""",
)
def g05_stateful_sessions(spark, sf_dir):
    """Sessions with their last ten messages: the closed ones as the stream gives them, the open ones from its state."""
    e = jobs.source(spark, f"{sf_dir}/events.parquet")
    out = jobs.shared_folder(spark)
    rows = e.select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("line"))
    return sessions.run(rows, out).unionByName(sessions.still_open(spark, out))

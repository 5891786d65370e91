"""Queries over the file catalog and chat sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog, sessions
from ..sources.tables import load, settings
from .registry import query

STATES = ["uploaded", "processing", "completed", "failed"]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the part of catalogued files."""
    d = load(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_id"), F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("original_filename"), F.col("n_chars").alias("file_size"),
        F.element_at(F.array(*map(F.lit, STATES)), (F.pmod("doc_id", F.lit(4)) + 1).cast("int")).alias("status"), F.pmod("doc_id", F.lit(101)).alias("processing_progress"),
        F.date_format(F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int))"), "yyyy-MM-dd HH:mm:ss").alias("upload_time"),
    )


FILES_SQL = """files AS (
  SELECT 'f' || doc_id AS file_id, source || '_' || doc_id || '.pdf' AS original_filename, n_chars AS file_size,
         ['uploaded', 'processing', 'completed', 'failed'][doc_id % 4 + 1] AS status, doc_id % 101 AS processing_progress,
         strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id), '%Y-%m-%d %H:%M:%S') AS upload_time
  FROM documents)"""


@query("s08_file_list", f"WITH {FILES_SQL} SELECT * FROM files ORDER BY upload_time DESC, file_id")
def s08_file_list(spark, sf_dir):
    return catalog.listing(files(spark, sf_dir))


@query("s07_file_point", f"WITH {FILES_SQL} SELECT * FROM files WHERE file_id = 'f7'")
def s07_file_point(spark, sf_dir):
    return catalog.point(files(spark, sf_dir), "f7")


@query(
    "p01_upload_validation",
    """SELECT doc_id, name, contains(name, '.') AND lower(string_split(name, '.')[-1]) IN ('pdf') AS type_ok, size <= 104857600 AS size_ok
       FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN doc_id || '.PDF' WHEN 1 THEN 'pdf' WHEN 2 THEN doc_id || '.pdf.exe' WHEN 3 THEN '.pdf' ELSE 'a.b.pdf' END AS name,
                    CASE WHEN doc_id % 7 = 0 THEN 104857600 + doc_id % 2 ELSE n_chars * 20000 END AS size FROM documents)""",
)
def p01_upload_validation(spark, sf_dir):
    k, i = F.pmod("doc_id", F.lit(5)), F.col("doc_id").cast("string")
    name = F.when(k == 0, F.concat(i, F.lit(".PDF"))).when(k == 1, F.lit("pdf")).when(k == 2, F.concat(i, F.lit(".pdf.exe"))).when(k == 3, F.lit(".pdf")).otherwise(F.lit("a.b.pdf"))
    size = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.lit(104857600) + F.pmod("doc_id", F.lit(2))).otherwise(F.col("n_chars") * 20000)
    type_ok, size_ok = X.upload_checks(F.col("name"), F.col("size"))
    return load(spark, sf_dir, "documents").select("doc_id", name.alias("name"), size.alias("size")).select("doc_id", "name", type_ok.alias("type_ok"), size_ok.alias("size_ok"))


@query(
    "p14_status_overlay",
    """WITH live AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS message, max_by(event_id % 101, (ts, event_id)) AS progress FROM events GROUP BY user_id),
       f AS (SELECT DISTINCT user_id FROM events UNION SELECT -1),
       s AS (SELECT f.user_id, CASE f.user_id % 5 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' WHEN -1 THEN 'processing' ELSE 'other' END AS status,
                    message AS m, progress AS p FROM f LEFT JOIN live ON f.user_id = live.user_id AND f.user_id <> 11)
       SELECT user_id AS file_id, status, CASE WHEN status = 'processing' THEN coalesce(p, 7) ELSE 7 END AS progress,
              coalesce(CASE WHEN status = 'processing' THEN m END, CASE status WHEN 'uploaded' THEN '📄 等待开始GraphRAG处理...' WHEN 'processing' THEN '🚀 正在进行GraphRAG处理...' WHEN 'completed' THEN '✅ 处理完成' WHEN 'failed' THEN '❌ 处理失败' ELSE '状态未知' END) AS message
       FROM s""",
)
def p14_status_overlay(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    live = catalog.latest_status(events.withColumn("progress", F.pmod("event_id", F.lit(101))), "user_id", ["ts", "event_id"], ["event_type", "progress"])
    live = live.filter("user_id <> 11").select(F.col("user_id").alias("file_id"), "progress", F.col("event_type").alias("message"))
    k = F.col("file_id") % 5
    status = F.when(k == 0, F.lit("uploaded")).when(k == 1, F.lit("processing")).when(k == 2, F.lit("completed")).when(k == 3, F.lit("failed")).when(k == -1, F.lit("processing")).otherwise(F.lit("other"))
    known = events.select(F.col("user_id").alias("file_id")).union(spark.range(1).select(F.lit(-1).cast("long"))).distinct()
    return catalog.with_status(known.withColumn("status", status).withColumn("processing_progress", F.lit(7).cast("long")), live)


@query("p19_rename", "SELECT doc_id, CASE WHEN doc_id = 5 THEN 'renamed.pdf' ELSE source END AS source, lang, n_chars FROM documents")
def p19_rename(spark, sf_dir):
    return catalog.rename(load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), F.col("doc_id") == 5, "renamed.pdf", "source")


@query(
    "f12_progress",
    """SELECT doc_id, CAST(5 + floor((doc_id % 13 + 0.2::DOUBLE) / 13 * 25) AS INTEGER) AS text_done, CAST(5 + floor((doc_id % 13 + 0.6::DOUBLE) / 13 * 25) AS INTEGER) AS tables_done, CAST(5 + floor((doc_id % 13 + 1.0::DOUBLE) / 13 * 25) AS INTEGER) AS page_done,
              CAST(32 + floor(doc_id % 37 / 37 * 18) AS INTEGER) AS embedded, CAST(55 + floor(doc_id % 37 / 37 * 5) AS INTEGER) AS prepared, CAST(60 + floor(doc_id % 37 / 37 * 5) AS INTEGER) AS inserted
       FROM documents""",
)
def f12_progress(spark, sf_dir):
    page, n, done, total = F.pmod("doc_id", F.lit(13)), F.lit(13), F.pmod("doc_id", F.lit(37)), F.lit(37)
    parts = [X.page_progress(page, n, p).alias(c) for p, c in ((0.2, "text_done"), (0.6, "tables_done"), (1.0, "page_done"))]
    stages = [X.stage_progress(a, w, done, total).alias(c) for a, w, c in ((32, 18, "embedded"), (55, 5, "prepared"), (60, 5, "inserted"))]
    return load(spark, sf_dir, "documents").select("doc_id", *parts, *stages)


@query(
    "f22_display_size",
    """SELECT doc_id, CASE WHEN n = 0 THEN '0 B' WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN regexp_replace(CAST(round(n / 1024.0::DOUBLE, 2) AS VARCHAR), '\\.0$', '') || ' KB'
              WHEN n < 1073741824 THEN regexp_replace(CAST(round(n / 1048576.0::DOUBLE, 2) AS VARCHAR), '\\.0$', '') || ' MB' ELSE regexp_replace(CAST(round(n / 1073741824.0::DOUBLE, 2) AS VARCHAR), '\\.0$', '') || ' GB' END AS size_text
       FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n_chars % 1100 WHEN 1 THEN n_chars * 97 WHEN 2 THEN n_chars * 10007 ELSE n_chars * 1000003 END AS n FROM documents)""".replace("\\\\", "\\"),
)
def f22_display_size(spark, sf_dir):
    k, n = F.pmod("doc_id", F.lit(4)), F.col("n_chars")
    size = F.when(k == 0, n % 1100).when(k == 1, n * 97).when(k == 2, n * 10007).otherwise(n * 1000003)
    return load(spark, sf_dir, "documents").select("doc_id", size.alias("n")).select("doc_id", X.human_size(F.col("n")).alias("size_text"))


@query(
    "f23_relative_time",
    """SELECT event_id, CASE WHEN s < 60 THEN '刚刚' WHEN s < 3600 THEN floor(s / 60)::BIGINT || '分钟前' WHEN s < 86400 THEN floor(s / 3600)::BIGINT || '小时前' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS age
       FROM (SELECT event_id, ts, epoch(TIMESTAMP '2024-01-30 12:00:00' - date_trunc('second', ts)) AS s FROM events)""",
)
def f23_relative_time(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.date_trunc("second", "ts").alias("ts"))
    age = F.unix_timestamp(F.lit("2024-01-30 12:00:00")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return e.select("event_id", X.relative_time(age, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("age"))


@query("f15_timestamps", "SELECT event_id, replace(strftime(ts, '%Y-%m-%dT%H:%M:%S'), ' ', '') || CASE WHEN strftime(ts, '%f') <> '000000' THEN '.' || strftime(ts, '%f') ELSE '' END AS iso, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def f15_timestamps(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return load(spark, sf_dir, "events").select("event_id", X.iso_time(ts).alias("iso"), F.unix_seconds(ts).alias("seconds"))


@query("f25_kind_names", f"WITH k AS (SELECT doc_id, ['text', 'image', 'table', 'chart', 'graph', 'other'][doc_id % 6 + 1] AS kind FROM documents) SELECT doc_id, CASE kind WHEN 'image' THEN '图片' WHEN 'table' THEN '表格' WHEN 'chart' THEN '图表' ELSE kind END AS shown FROM k")
def f25_kind_names(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("text", "image", "table", "chart", "graph", "other"))), (F.pmod("doc_id", F.lit(6)) + 1).cast("int"))
    return load(spark, sf_dir, "documents").select("doc_id", X.kind_name(kind).alias("shown"))


@query(
    "f24_progress_message",
    f"""WITH {FILES_SQL} SELECT file_id, CASE status WHEN 'uploaded' THEN '等待处理' WHEN 'processing' THEN '处理中' WHEN 'completed' THEN '已完成' WHEN 'failed' THEN '处理失败' ELSE '未知' END AS status_text,
        CASE status WHEN 'uploaded' THEN '📄 准备开始GraphRAG处理...' WHEN 'completed' THEN '✅ 处理完成' WHEN 'failed' THEN '❌ 处理失败' WHEN 'processing' THEN
          CASE WHEN processing_progress <= 5 THEN '🚀 正在启动GraphRAG处理...' WHEN processing_progress <= 30 THEN '📖 正在提取PDF内容...' WHEN processing_progress <= 50 THEN '🔤 正在生成嵌入向量...' WHEN processing_progress <= 65 THEN '💾 正在保存向量数据...'
               WHEN processing_progress <= 86 THEN '🧠 正在构建知识图谱...' WHEN processing_progress < 100 THEN '🕸️ 正在保存图数据...' ELSE '🎉 即将完成...' END
        ELSE processing_progress || '%' END AS message FROM files""",
)
def f24_progress_message(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", X.mapped(F.col("status"), X.STATUS_TEXT, "未知").alias("status_text"), X.progress_message(F.col("status"), F.col("processing_progress")).alias("message"))


@query(
    "a01_daily_stats",
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS processing_date, count(*) AS total_files, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed_files, count(*) FILTER (WHERE o_orderstatus = 'O') AS processing_files, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed_files,
              round(avg(o_totalprice), 4) AS avg_file_size, CAST(sum(o_custkey) AS BIGINT) AS total_chunks, CAST(sum(o_orderkey % 3) AS BIGINT) AS total_images, CAST(sum(o_orderkey % 2) AS BIGINT) AS total_tables
       FROM orders GROUP BY ALL""",
)
def a01_daily_stats(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    f = o.select(F.col("o_orderdate").alias("created_at"), X.mapped(F.col("o_orderstatus"), {"F": "completed", "O": "processing", "P": "failed"}, "uploaded").alias("status"), F.col("o_totalprice").alias("file_size"), F.col("o_custkey").alias("total_chunks"), (F.col("o_orderkey") % 3).alias("total_images"), (F.col("o_orderkey") % 2).alias("total_tables"))
    return catalog.daily_stats(f).withColumn("avg_file_size", F.round("avg_file_size", 4)).withColumn("processing_date", F.col("processing_date").cast("string"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, pages and benchmark items in the part of chunks of 60 files."""
    parts = (("documents", "doc_id", "text"), ("pages", "page_id", "image"), ("benchmark", "item_id", "table"))
    out = None
    for table, key, kind in parts:
        one = load(spark, sf_dir, table).select(F.pmod(key, F.lit(50)).alias("file_id"), F.when(F.pmod(key, F.lit(17)) == 3, F.lit("chart")).otherwise(F.lit(kind)).alias("content_type"))
        out = one if out is None else out.unionByName(one)
    return out


CHUNKS_SQL = """chunks AS (
  SELECT doc_id % 50 AS file_id, CASE WHEN doc_id % 17 = 3 THEN 'chart' ELSE 'text' END AS content_type FROM documents
  UNION ALL SELECT page_id % 50, CASE WHEN page_id % 17 = 3 THEN 'chart' ELSE 'image' END FROM pages
  UNION ALL SELECT item_id % 50, CASE WHEN item_id % 17 = 3 THEN 'chart' ELSE 'table' END FROM benchmark)"""


@query(
    "a03_chunk_counters",
    f"""WITH {CHUNKS_SQL}, c AS (SELECT file_id, count(*) FILTER (WHERE content_type = 'text') AS t, count(*) FILTER (WHERE content_type = 'image') AS i, count(*) FILTER (WHERE content_type = 'table') AS b FROM chunks GROUP BY file_id)
        SELECT f.file_id, coalesce(t, 0) AS total_chunks, coalesce(i, 0) AS total_images, coalesce(b, 0) AS total_tables FROM (SELECT unnest(range(60)) AS file_id) f LEFT JOIN c ON f.file_id = c.file_id""",
)
def a03_chunk_counters(spark, sf_dir):
    return catalog.counters(spark.range(60).withColumnRenamed("id", "file_id"), chunks(spark, sf_dir))


@query("a04_type_counts", f"WITH {CHUNKS_SQL} SELECT file_id, count(*) AS total, count(*) FILTER (WHERE content_type = 'text') AS text, count(*) FILTER (WHERE content_type = 'image') AS image, count(*) FILTER (WHERE content_type = 'table') AS \"table\", count(*) FILTER (WHERE content_type = 'chart') AS chart FROM chunks GROUP BY file_id")
def a04_type_counts(spark, sf_dir):
    return catalog.type_counts(chunks(spark, sf_dir))


@query(
    "a08_file_statistics",
    """WITH f AS (SELECT DISTINCT conv_id AS file_id FROM conversations), c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), e AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), r AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1)
       SELECT f.file_id, coalesce(c.n, 0) AS chunks, coalesce(e.n, 0) AS entities, coalesce(r.n, 0) AS relations FROM f LEFT JOIN c ON f.file_id = c.conv_id LEFT JOIN e ON f.file_id = e.c_nationkey LEFT JOIN r ON f.file_id = r.s_nationkey""",
)
def a08_file_statistics(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"))
    nodes = load(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("file_id"))
    edges = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("file_id"))
    return catalog.statistics(c.distinct(), c, nodes, edges)


def chat(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) of conversations, with a session without messages for each region."""
    c = load(spark, sf_dir, "conversations")
    ids = c.select("conv_id").distinct().union(load(spark, sf_dir, "region").select((F.col("r_regionkey") + 1_000_000).cast("long")))
    base = "timestamp'2024-01-01 00:00:00'"
    s = ids.select(
        F.col("conv_id").alias("session_id"), F.concat(F.lit("chat "), F.col("conv_id").cast("string")).alias("title"), F.when(F.col("conv_id") % 3 == 0, F.lit("closed")).otherwise(F.lit("active")).alias("status"),
        F.expr(f"{base} + make_dt_interval(0, cast(conv_id % 700 as int))").alias("created"),
    )
    m = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("message_id"), F.expr(f"{base} + make_dt_interval(0, cast(conv_id % 700 as int), cast(turn as int))").alias("created_at"), "role", "text")
    return s, m


def _time(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


CHAT_SQL = """s AS (
  SELECT conv_id AS session_id, 'chat ' || conv_id AS title, CASE WHEN conv_id % 3 = 0 THEN 'closed' ELSE 'active' END AS status, TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id % 700) AS created
  FROM (SELECT DISTINCT conv_id FROM conversations UNION ALL SELECT CAST(r_regionkey + 1000000 AS BIGINT) FROM region)),
m AS (SELECT conv_id AS session_id, turn AS message_id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id % 700) + to_minutes(turn) AS created_at, role, text FROM conversations)"""


@query(
    "n06_recent_conversations",
    f"""WITH {CHAT_SQL} SELECT s.session_id, title, status, strftime(created, '%Y-%m-%d %H:%M:%S') AS session_created, count(message_id) AS message_count, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_message_time
        FROM s LEFT JOIN m ON s.session_id = m.session_id GROUP BY ALL""",
)
def n06_recent_conversations(spark, sf_dir):
    s, m = chat(spark, sf_dir)
    out = sessions.recent(s.withColumnRenamed("created", "session_created"), m)
    return out.select("session_id", "title", "status", _time("session_created"), "message_count", _time("last_message_time"))


@query(
    "n05_expire_sessions",
    f"""WITH {CHAT_SQL}, old AS (SELECT session_id FROM s WHERE status = 'active' AND created < TIMESTAMP '2024-01-04 00:00:00' - to_hours(24))
        SELECT s.session_id, CASE WHEN old.session_id IS NOT NULL THEN 'closed' ELSE status END AS status, CASE WHEN old.session_id IS NULL THEN coalesce(n, 0) ELSE 0 END AS messages_left, (SELECT count(*) FROM old) AS cleaned_sessions
        FROM s LEFT JOIN old ON s.session_id = old.session_id LEFT JOIN (SELECT session_id, count(*) AS n FROM m GROUP BY 1) c ON s.session_id = c.session_id""",
)
def n05_expire_sessions(spark, sf_dir):
    s, m = chat(spark, sf_dir)
    # The setting is one row, read once; its default is a day.
    found = settings(spark).filter("config_key = 'session_timeout_hours'").select(F.col("config_value").try_cast("int")).limit(1).first()
    hours = F.lit((found and found[0]) or 24)
    after, left, closed = sessions.expire(s.withColumn("updated_at", F.col("created")), m, F.expr("timestamp'2024-01-04 00:00:00'"), hours)
    n = left.groupBy("session_id").agg(F.count("*").alias("n"))
    return after.join(n, "session_id", "left").crossJoin(closed.agg(F.count("*").alias("cleaned_sessions"))).select("session_id", "status", F.coalesce("n", F.lit(0)).alias("messages_left"), "cleaned_sessions")


@query("w01_history_last_n", "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def w01_history_last_n(spark, sf_dir):
    return sessions.last_messages(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn", 3)


@query(
    "n03_history_format",
    """SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || ': ' || text, chr(10) ORDER BY turn) AS history
       FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10) GROUP BY conv_id""",
)
def n03_history_format(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return sessions.formatted(sessions.last_messages(c, "conv_id", "turn"), "conv_id", "turn")


@query("n04_clear_session", "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT DISTINCT conv_id FROM conversations WHERE turn = 5)")
def n04_clear_session(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn")
    return sessions.clear(c, c.filter("turn = 5").distinct(), "conv_id")

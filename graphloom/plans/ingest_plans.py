"""Queries over scans of pages, media, and the upkeep of what was ingested."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import files as lifecycle
from ..operators import graph, ingest, retrieval
from ..sources import providers
from ..sources import tables as src
from ..sources.tables import load
from . import catalog_plans
from .registry import query


@query("s03_image_filter", "SELECT 'b' || p_brand || '_page_' || p_partkey % 7 || '_image_0' AS chunk_id, p_partkey FROM part WHERE p_size * 4 >= 50 AND p_partkey % 120 >= 50 AND p_partkey % 6 - p_partkey % 2 < 4")
def s03_image_filter(spark, sf_dir):
    p, k = load(spark, sf_dir, "part"), F.col("p_partkey")
    image = F.struct((F.col("p_size") * 4).cast("int").alias("width"), (k % 120).cast("int").alias("height"), (k % 6).cast("int").alias("channels"), (k % 2).cast("int").alias("alpha"), F.lit("png").alias("format"), k.cast("string").cast("binary").alias("bytes"))
    pages = p.select(F.concat(F.lit("b"), "p_brand").alias("file_id"), (k % 7).cast("int").alias("page_number"), F.array(image).alias("images"))
    return ingest.image_chunks(pages).select("chunk_id", F.col("media_bytes").cast("string").cast("long").alias("p_partkey"))


def _pages(spark, sf_dir):
    """Parts as pages with a text, a table, an image and a chart each."""
    p, k = load(spark, sf_dir, "part"), F.col("p_partkey")
    size = F.col("p_size").cast("string")
    image = F.struct((F.col("p_size") * 4).cast("int").alias("width"), (k % 120).cast("int").alias("height"), F.lit(3).alias("channels"), F.lit(0).alias("alpha"), F.lit("png").alias("format"), F.col("p_name").cast("binary").alias("bytes"))
    table = F.array(F.array(F.lit("type"), F.lit("size")), F.array(F.col("p_type"), size))
    chart = F.struct(F.col("p_type").alias("chart_type"), F.create_map(F.lit("x"), F.col("p_brand")).alias("axis_labels"), F.array(size).alias("legend_info"))
    return p.select(F.concat(F.lit("f"), k.cast("string")).alias("file_id"), (k % 7).cast("int").alias("page_number"), F.col("p_name").alias("text"), F.array(table, F.array(F.array(F.lit("only")))).alias("tables"), F.array(image).alias("images"), F.array(chart).alias("charts"))


_OWN_PAGES = """p AS (SELECT 'f' || p_partkey AS file_id, CAST(p_partkey % 7 AS INTEGER) AS page_number, * FROM part),
  chunks AS (SELECT file_id, page_number, 'text' AS content_type, p_name AS content, 1 AS kind_order, 0 AS media FROM p
    UNION ALL SELECT file_id, page_number, 'image', '', 2, length(p_name) FROM p WHERE p_size * 4 >= 50 AND p_partkey % 120 >= 50
    UNION ALL SELECT file_id, page_number, 'table', '表格(第' || (page_number + 1) || '页，表1)：' || chr(10) || '表头：type | size' || chr(10) || '第1行：' || p_type || ' | ' || p_size, 3, 0 FROM p
    UNION ALL SELECT file_id, page_number, 'chart', p_type, 4, 0 FROM p)"""


@query("s05_multimodal_chunks", f"WITH {_OWN_PAGES} SELECT file_id || '_page_' || page_number || '_' || content_type || '_0' AS chunk_id, content_type, content, kind_order, media FROM chunks")
def s05_multimodal_chunks(spark, sf_dir):
    out = ingest.multimodal_chunks(_pages(spark, sf_dir))
    return out.select("chunk_id", "content_type", "content", "kind_order", F.coalesce(F.length("media_bytes"), F.lit(0)).alias("media"))


@query("s06_multimodal_union", f"WITH {_OWN_PAGES} SELECT file_id, content_type, CAST(row_number() OVER (PARTITION BY file_id ORDER BY page_number, kind_order) AS INTEGER) AS seq FROM chunks")
def s06_multimodal_union(spark, sf_dir):
    out = ingest.multimodal_chunks(_pages(spark, sf_dir))
    return out.select("file_id", "content_type", F.row_number().over(W.partitionBy("file_id").orderBy("page_number", "kind_order", "chunk_index")).alias("seq"))


@query("r23_file_media", f"WITH {_OWN_PAGES} SELECT file_id || '_page_' || page_number || '_' || content_type || '_0' AS chunk_id, file_id, content_type FROM chunks WHERE content_type <> 'text'")
def r23_file_media(spark, sf_dir):
    return retrieval.media_listing(ingest.multimodal_chunks(_pages(spark, sf_dir))).select("chunk_id", "file_id", "content_type")


@query("f30_image_analysis", f"WITH {_OWN_PAGES} SELECT file_id || '_page_' || page_number || '_image_0' AS chunk_id, '图像(第' || (page_number + 1) || '页)：尺寸' || p_size * 4 || 'x' || p_partkey % 120 || '，包含文字：' || p_name AS description, p_brand AS objects, p_name AS text_content FROM p WHERE p_size * 4 >= 50 AND p_partkey % 120 >= 50")
def f30_image_analysis(spark, sf_dir):
    """Pictures through a reader that takes their bytes for their text; objects are looked up beside them."""
    images = ingest.image_chunks(_pages(spark, sf_dir))
    seen = providers.analyse_images(images, reader=providers.PlainReader())
    brands = load(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file_id"), F.col("p_brand").alias("objects"))
    return seen.join(brands, "file_id").select("chunk_id", "description", "objects", "text_content")


@query("s16_has_data", "SELECT (SELECT count(*) FROM embeddings) > 0 AS vectors, (SELECT count(*) FROM embeddings WHERE vec_id < 0) > 0 AS none")
def s16_has_data(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings").select("vec_id")
    return spark.createDataFrame([(not v.isEmpty(), not v.filter("vec_id < 0").isEmpty())], "vectors boolean, none boolean")


@query(
    "s30_settings",
    """WITH s AS (SELECT * FROM (VALUES ('max_file_size_mb', '100', CAST(100 AS BIGINT)), ('allowed_file_types', '["pdf"]', NULL), ('chunk_size', '1000', 1000), ('chunk_overlap', '200', 200), ('vector_similarity_threshold', '0.7', NULL), ('max_search_results', '10', 10), ('session_timeout_hours', '24', 24)) v(config_key, config_value, whole))
       SELECT source, config_key, config_value, whole, n_chars // whole AS times FROM s CROSS JOIN (SELECT source, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY source)""",
)
def s30_settings(spark, sf_dir):
    """The settings, and how often each whole number of them goes into a source's characters."""
    value = F.col("config_value")
    own = src.settings(spark).select("config_key", "config_value", F.when(value.rlike(r"^\d+$"), value.try_cast("bigint")).alias("whole"))
    sizes = load(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("n_chars"))
    # Seven settings: they are broadcast to the sources.
    return sizes.join(F.broadcast(own)).select("source", "config_key", "config_value", "whole", F.expr("n_chars div whole").alias("times"))


@query("p04_type_filter", f"WITH {catalog_plans.CHUNKS_SQL} SELECT file_id, content_type FROM chunks WHERE content_type IN ('image', 'chart')")
def p04_type_filter(spark, sf_dir):
    return catalog_plans.chunks(spark, sf_dir).filter(F.col("content_type").isin("image", "chart"))


@query("p03_blank_filter", r"SELECT conv_id, turn FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN ' ' || chr(12288) || chr(9) WHEN 1 THEN chr(133) || chr(160) ELSE text END AS t FROM conversations) WHERE regexp_replace(t, '[\s\x0b\p{Z}\x{85}\x{1c}-\x{1f}]', '', 'g') <> ''")
def p03_blank_filter(spark, sf_dir):
    k = F.pmod("turn", F.lit(3))
    t = F.when(k == 0, F.lit(" 　\t")).when(k == 1, F.lit("\u0085 ")).otherwise(F.col("text"))
    return load(spark, sf_dir, "conversations").filter(~X.blank(t)).select("conv_id", "turn")


@query("p11_vector_rows", "SELECT 'f' || doc_id AS file_id, text AS content, '{\"type\":\"text\",\"page\":' || doc_id % 9 || ',\"language\":\"' || lang || '\"}' AS metadata FROM documents")
def p11_vector_rows(spark, sf_dir):
    meta = F.to_json(F.struct(F.lit("text").alias("type"), F.pmod("doc_id", F.lit(9)).alias("page"), F.col("lang").alias("language")))
    return load(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_id"), F.col("text").alias("content"), meta.alias("metadata"))


@query("p10_metadata_filter", "SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def p10_metadata_filter(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.col("lang").alias("type"))).alias("metadata"))
    kind = F.get_json_object("metadata", "$.type")
    return rows.select("doc_id", kind.alias("lang")).filter("lang = 'fr'")


@query("u04_missing_names", "SELECT c_name AS name FROM customer EXCEPT SELECT c_name FROM customer JOIN orders ON o_custkey = c_custkey")
def u04_missing_names(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    known = c.join(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey").select("name")
    return c.select("name").distinct().join(known, "name", "left_anti")


@query("w06_batches", "SELECT conv_id, b AS batch, count(*) AS messages, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS joined FROM (SELECT *, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS BIGINT) AS b FROM conversations) GROUP BY conv_id, b")
def w06_batches(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    rows = load(spark, sf_dir, "conversations").withColumn("batch", F.floor(n / 2))
    own = rows.groupBy("conv_id", "batch").agg(F.count("*").alias("messages"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return own.select("conv_id", "batch", "messages", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("joined"))


@query("k06_image_entities", r"SELECT 'c' || doc_id AS chunk_id, trim(o) AS name, 'IMAGE_OBJECT' AS type, 0.8::DOUBLE AS confidence FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS o FROM documents) WHERE trim(o) <> ''")
def k06_image_entities(spark, sf_dir):
    objects = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    return graph.image_entities(load(spark, sf_dir, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), objects.alias("objects_detected"))).drop("place")


_CHARTS = "c AS (SELECT 'c' || p_partkey AS chunk_id, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS chart_type, p_brand AS label, p_name AS series FROM part)"


@query("k07_chart_entities", f"WITH {_CHARTS} SELECT chunk_id, label AS name, 'CHART_AXIS' AS type, 0.9::DOUBLE AS confidence FROM c UNION ALL SELECT chunk_id, series, 'CHART_SERIES', 0.8::DOUBLE FROM c")
def k07_chart_entities(spark, sf_dir):
    return graph.chart_graph(_charts(spark, sf_dir))[0].drop("part", "place")


@query("k07_chart_relations", f"WITH {_CHARTS} SELECT chunk_id, series AS subject, 'DISPLAYED_IN' AS predicate, chart_type AS object, 0.8::DOUBLE AS confidence FROM c WHERE chart_type <> ''")
def k07_chart_relations(spark, sf_dir):
    return graph.chart_graph(_charts(spark, sf_dir))[1].drop("place")


def _charts(spark, sf_dir):
    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(F.concat(F.lit("c"), k.cast("string")).alias("chunk_id"), F.when(k % 4 == 0, F.lit("")).otherwise(F.col("p_type")).alias("chart_type"), F.create_map(F.lit("x"), "p_brand", F.lit("y"), F.lit(" ")).alias("axis_labels"), F.array("p_name", F.lit("")).alias("legend_info"))


@query("r05_media_enrichment", "SELECT 'c' || d.doc_id AS chunk_id, CASE WHEN p.page_id IS NOT NULL THEN 'loaded' ELSE 'failed' END AS media_status, 'data:image/jpeg;base64,' || to_base64(encode(p.url)) AS data_uri FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id")
def r05_media_enrichment(spark, sf_dir):
    media = load(spark, sf_dir, "pages").select(F.concat(F.lit("c"), F.col("page_id").cast("string")).alias("chunk_id"), F.lit("jpg").alias("extension"), F.encode("url", "UTF-8").alias("bytes"))
    out = src.with_media(load(spark, sf_dir, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id")), media)
    return out.withColumn("data_uri", F.regexp_replace("data_uri", "[\r\n]", ""))


@query(
    "s24_register_files",
    """WITH u AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || '.pdf' WHEN 1 THEN source || '.PDF' ELSE source || '.txt' END AS name, n_chars * CASE WHEN doc_id % 7 = 0 THEN 100000 ELSE 1 END AS size FROM documents),
       r AS (SELECT *, lower(string_split(name, '.')[-1]) = 'pdf' AS type_ok, size <= 104857600 AS size_ok FROM u)
       SELECT 'f' || doc_id AS file_id, name AS original_filename, CASE WHEN type_ok AND size_ok THEN '/in/f' || doc_id || '_' || (1704067200 + doc_id) || '.pdf' END AS file_path, size AS file_size, CASE WHEN type_ok AND size_ok THEN 'uploaded' END AS status, type_ok AND size_ok AS success,
              CASE WHEN NOT type_ok THEN '不支持的文件类型，仅支持: pdf' WHEN NOT size_ok THEN '文件大小超过限制 (100MB)' ELSE '文件上传成功，GraphRAG处理已开始' END AS message FROM r""",
)
def s24_register_files(spark, sf_dir):
    k = F.pmod("doc_id", F.lit(3))
    name = F.concat("source", F.when(k == 0, F.lit(".pdf")).when(k == 1, F.lit(".PDF")).otherwise(F.lit(".txt")))
    size = F.col("n_chars") * F.when(F.pmod("doc_id", F.lit(7)) == 0, F.lit(100_000)).otherwise(F.lit(1))
    uploads = load(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_id"), name.alias("original_filename"), size.alias("size"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("uploaded_at"))
    return lifecycle.register(uploads, "/in").select("file_id", "original_filename", "file_path", "file_size", "status", "success", "message")


@query(
    "p16_file_details",
    f"""WITH {catalog_plans.FILES_SQL}, live AS (SELECT 'f' || user_id AS file_id, max_by(event_type, (ts, event_id)) AS message, max_by(event_id % 101, (ts, event_id)) AS progress FROM events GROUP BY user_id),
        c AS (SELECT 'f' || conv_id AS file_id, count(*) AS n FROM conversations GROUP BY 1), e AS (SELECT 'f' || c_nationkey AS file_id, count(*) AS n FROM customer GROUP BY 1), r AS (SELECT 'f' || s_nationkey AS file_id, count(*) AS n FROM supplier GROUP BY 1)
        SELECT files.file_id, original_filename, file_size, status, processing_progress, upload_time, CASE WHEN status = 'processing' THEN coalesce(live.progress, processing_progress) ELSE processing_progress END AS progress,
               coalesce(CASE WHEN status = 'processing' THEN live.message END, CASE status WHEN 'uploaded' THEN '📄 等待开始GraphRAG处理...' WHEN 'processing' THEN '🚀 正在进行GraphRAG处理...' WHEN 'completed' THEN '✅ 处理完成' ELSE '❌ 处理失败' END) AS message,
               coalesce(c.n, 0) AS chunks, coalesce(e.n, 0) AS entities, coalesce(r.n, 0) AS relations
        FROM files LEFT JOIN live USING (file_id) LEFT JOIN c USING (file_id) LEFT JOIN e USING (file_id) LEFT JOIN r USING (file_id)""",
)
def p16_file_details(spark, sf_dir):
    named = lambda table, key: load(spark, sf_dir, table).select(F.concat(F.lit("f"), F.col(key).cast("string")).alias("file_id"))
    events = load(spark, sf_dir, "events").withColumn("file_id", F.concat(F.lit("f"), F.col("user_id").cast("string"))).withColumn("progress", F.pmod("event_id", F.lit(101)))
    live = catalog_plans.catalog.latest_status(events, "file_id", ["ts", "event_id"], ["event_type", "progress"]).select("file_id", "progress", F.col("event_type").alias("message"))
    return lifecycle.details(catalog_plans.files(spark, sf_dir), live, named("conversations", "conv_id"), named("customer", "c_nationkey"), named("supplier", "s_nationkey"))


@query("n01_new_sessions", "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session_id, '' AS title, 'active' AS status, '2024-05-01 00:00:00' AS session_created FROM conversations")
def n01_new_sessions(spark, sf_dir):
    asked = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.lit(None).cast("string").alias("title")).distinct()
    out = lifecycle.new_sessions(asked, F.lit("2024-05-01 00:00:00").cast("timestamp"))
    return out.select("session_id", "title", "status", F.date_format("session_created", "yyyy-MM-dd HH:mm:ss").alias("session_created"))


@query(
    "m01_delete_file",
    """WITH doc AS (SELECT source AS file_id, 'c' || doc_id AS chunk_id, doc_id FROM documents), node AS (SELECT 'SUPPLIER' AS label, s_name AS name, 'src' || s_nationkey AS file_id FROM supplier UNION ALL SELECT 'NATION', n_name, 'other' FROM nation),
       edge AS (SELECT s_name, 'src' || s_nationkey % 5 AS file_id, 'src' || s_nationkey AS node_file FROM supplier JOIN nation ON s_nationkey = n_nationkey)
       SELECT 'files' AS store, count(DISTINCT file_id) AS n FROM doc WHERE file_id <> 'src3' UNION ALL SELECT 'chunks', count(*) FROM doc WHERE file_id <> 'src3' UNION ALL SELECT 'vectors', count(*) FROM embeddings JOIN doc ON vec_id = doc_id WHERE file_id <> 'src3'
       UNION ALL SELECT 'media', count(*) FROM pages WHERE page_id NOT IN (SELECT doc_id FROM doc WHERE file_id = 'src3') UNION ALL SELECT 'nodes', count(*) FROM node WHERE file_id <> 'src3' UNION ALL SELECT 'edges', count(*) FROM edge WHERE file_id <> 'src3' AND node_file <> 'src3'""",
)
def m01_delete_file(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("source").alias("file_id"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), "doc_id")
    vectors = load(spark, sf_dir, "embeddings").join(d, F.col("vec_id") == F.col("doc_id")).select("file_id", "vec_id")
    media = load(spark, sf_dir, "pages").select(F.concat(F.lit("c"), F.col("page_id").cast("string")).alias("chunk_id"))
    s, n = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    file = lambda k: F.concat(F.lit("src"), k.cast("string"))
    nodes = s.select(F.lit("SUPPLIER").alias("label"), F.col("s_name").alias("name"), file(F.col("s_nationkey")).alias("file_id")).union(n.select(F.lit("NATION"), "n_name", F.lit("other")))
    edges = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("SUPPLIER").alias("src_label"), F.col("s_name").alias("subject"), F.lit("NATION").alias("dst_label"), F.col("n_name").alias("object"), file(F.col("s_nationkey") % 5).alias("file_id"))
    left = lifecycle.delete("src3", d.select("file_id").distinct(), d, vectors, media, nodes, edges)
    return reduce(DataFrame.union, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(store).alias("store"), "n") for store, df in left.items()])

"""Queries over vectors, fused results and what answers are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import retrieval
from ..sources import providers
from ..sources.tables import load
from . import graph_plans, text_plans
from .registry import query

_DOT = "list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return v, v.filter("vec_id = 0")


@query("j08_vector_topk", f"SELECT e.vec_id, round({_DOT}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {_DOT} DESC, e.vec_id LIMIT 5")
def j08_vector_topk(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return retrieval.top_k(v, q).select("vec_id", F.round("score", 6).alias("score"))


@query("p05_vector_threshold", f"SELECT e.vec_id, round({_DOT}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND {_DOT} >= 0.2 ORDER BY {_DOT} DESC, e.vec_id LIMIT 20")
def p05_vector_threshold(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return retrieval.top_k(v, q, 20, 0.2).select("vec_id", F.round("score", 6).alias("score"))


@query("j08_multi_query", f"SELECT q.vec_id AS query_id, e.vec_id, round({_DOT}, 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS INTEGER) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 QUALIFY rank <= 5")
def j08_multi_query(spark, sf_dir):
    v, _ = _vectors(spark, sf_dir)
    out = retrieval.top_k_of_each(v, v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


#: Lists that a search of the index probes, of 128: as many as a recall of 0.9 of the five nearest takes.
PROBES = 64


@query("r02_ivf_topk")
def r02_ivf_topk(spark, sf_dir):
    v, _ = _vectors(spark, sf_dir)
    indexed, centres = retrieval.inverted_file(v)
    queries = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.probed_top_k_of_each(indexed, centres, queries, probes=PROBES).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("r02_ivf_recall", "SELECT count(*) AS queries, true AS recall_reached FROM embeddings WHERE vec_id % 20 = 0")
def r02_ivf_recall(spark, sf_dir):
    """Whether the index finds nine tenths of the nearest, held against the exact search of the same queries."""
    v, _ = _vectors(spark, sf_dir)
    exact = retrieval.top_k_of_each(v, v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")).select("query_id", "vec_id")
    both = exact.join(r02_ivf_topk(spark, sf_dir).select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))


QUESTION = "Where is NATION_3 of ASIA"
_QUESTION_TERMS = graph_plans.paths_sql("SELECT unnest(['Where', 'NATION_3', 'ASIA'])")
_KIND = "['text', 'image', 'table', 'chart'][{} % 4 + 1]"


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of the vector table, embedded."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    d = load(spark, sf_dir, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("source").alias("file_id"), F.col("text").alias("content"), F.to_json(F.struct(kind.alias("type"))).alias("metadata"))
    return providers.embed(d, "content")


@query(
    "r01_question",
    f"""WITH RECURSIVE {_QUESTION_TERMS},
        v AS ({text_plans.embedded_sql(f"(SELECT doc_id AS k, text FROM documents UNION ALL SELECT -1, '{QUESTION}')")}),
        scored AS (SELECT e.k, list_inner_product(e.v::FLOAT[]::DOUBLE[], q.v::FLOAT[]::DOUBLE[]) AS score FROM v e, v q WHERE q.k = -1 AND e.k >= 0 AND e.n > 0),
        top AS (SELECT k, score, row_number() OVER (ORDER BY score DESC, 'c' || k) AS seq FROM scored WHERE score >= 0.1 ORDER BY score DESC, 'c' || k LIMIT 5),
        u AS (SELECT 'vector' AS type, {_KIND.format('k')} AS content_type, text AS content, source AS file_id, 'c' || k AS chunk_id, score, CAST(NULL AS VARCHAR) AS path, 0 AS part, seq FROM top JOIN documents ON doc_id = k
          UNION ALL SELECT 'graph', 'graph', NULL, NULL, NULL, 0.8::DOUBLE, nodes, 1, row_number() OVER (ORDER BY term, hops, key) FROM best)
        SELECT CAST(row_number() OVER (ORDER BY content_type <> 'text' DESC, score DESC, part, seq) AS INTEGER) AS rank, type, content_type, chunk_id, file_id, content, path, round(score, 6) AS score FROM u QUALIFY rank <= 15""",
)
def r01_question(spark, sf_dir):
    """A question in words, through its vector and its terms."""
    out = retrieval.search(vector_rows(spark, sf_dir), graph_plans.places_edges(spark, sf_dir), QUESTION, threshold=0.1)
    return out.select("rank", "type", "content_type", "chunk_id", "file_id", "content", "path", F.round("score", 6).alias("score"))


_ASKS = "SELECT conv_id * 1000 + turn AS question_id, text || ' in NATION_' || conv_id % 25 || ' of ASIA' AS question FROM conversations WHERE role = 'user' AND (conv_id * 1000 + turn) % 20 = 0"


def _asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn whose id is divisible by 20, as a question that names a nation."""
    c = load(spark, sf_dir, "conversations").filter("role = 'user' AND (conv_id * 1000 + turn) % 20 = 0")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.concat("text", F.lit(" in NATION_"), (F.col("conv_id") % 25).cast("string"), F.lit(" of ASIA")).alias("question"))


@query(
    "r01_many_questions",
    f"""WITH RECURSIVE q AS ({_ASKS}),
        asked AS (SELECT DISTINCT question_id, unnest(list_filter(string_split(question, ' '), lambda w: length(w) > 2)[1:3]) AS term FROM (SELECT question_id, regexp_replace(question, '{text_plans._WS}+', ' ', 'g') AS question FROM q)),
        {graph_plans.paths_sql("SELECT DISTINCT term FROM asked")},
        v AS ({text_plans.embedded_sql("(SELECT doc_id AS k, text FROM documents UNION ALL SELECT -1 - question_id, question FROM q)")}),
        scored AS (SELECT -1 - q.k AS question_id, e.k, list_inner_product(e.v::FLOAT[]::DOUBLE[], q.v::FLOAT[]::DOUBLE[]) AS score FROM v e, v q WHERE q.k < 0 AND e.k >= 0 AND e.n > 0),
        top AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, 'c' || k) AS seq FROM scored QUALIFY seq <= 5),
        u AS (SELECT question_id, 'vector' AS type, {_KIND.format('k')} AS content_type, source AS file_id, 'c' || k AS chunk_id, score, CAST(NULL AS VARCHAR) AS path, 0 AS part, seq FROM top JOIN documents ON doc_id = k WHERE score >= 0.1
          UNION ALL SELECT question_id, 'graph', 'graph', NULL, NULL, 0.8::DOUBLE, nodes, 1, row_number() OVER (PARTITION BY question_id ORDER BY asked.term, hops, key) FROM asked JOIN best ON asked.term = best.term)
        SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY content_type <> 'text' DESC, score DESC, part, seq) AS INTEGER) AS rank, type, content_type, chunk_id, file_id, path, round(score, 6) AS score FROM u QUALIFY rank <= 15""",
)
def r01_many_questions(spark, sf_dir):
    """All questions through their vectors and terms, in one plan."""
    out = retrieval.search_each(vector_rows(spark, sf_dir), graph_plans.places_edges(spark, sf_dir), _asks(spark, sf_dir), threshold=0.1)
    return out.select("question_id", "rank", "type", "content_type", "chunk_id", "file_id", "path", F.round("score", 6).alias("score"))


@query(
    "p12_result_details",
    f"""WITH top AS (SELECT e.vec_id, {_DOT} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {_DOT} DESC, e.vec_id LIMIT 12)
        SELECT 'c' || vec_id AS chunk_id, CASE WHEN vec_id % 4 = 1 THEN n_chars END AS width, CASE WHEN vec_id % 4 = 3 THEN lang END AS chart_type, CASE WHEN vec_id % 4 = 2 THEN text END AS summary,
               CASE WHEN vec_id % 4 = 2 THEN CASE WHEN page_id IS NULL THEN 'failed' ELSE 'loaded' END END AS status, CASE WHEN vec_id % 4 = 2 AND page_id IS NOT NULL THEN url END AS cell
        FROM top LEFT JOIN documents ON doc_id = vec_id LEFT JOIN pages ON page_id = vec_id""",
)
def p12_result_details(spark, sf_dir):
    """The nearest chunks, fused, with the details of images, charts and tables."""
    d = load(spark, sf_dir, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.to_json(F.struct(F.col("n_chars").alias("width"), F.col("lang").alias("chart_type"))).alias("metadata"))
    tables = load(spark, sf_dir, "pages").select(F.concat(F.lit("c"), F.col("page_id").cast("string")).alias("chunk_id"), F.array(F.array(F.lit("url")), F.array("url")).alias("table_data"))
    none = spark.createDataFrame([], "path string, seq long")
    out = retrieval.with_details(retrieval.fuse(hits(spark, sf_dir, 12).join(d, "chunk_id", "left"), none), tables)
    return out.select("chunk_id", F.col("image.width").cast("long").alias("width"), "chart.chart_type", F.col("table.table_summary").alias("summary"), F.col("table.status").alias("status"), F.get(F.get("table.table_data", F.lit(1)), F.lit(0)).alias("cell"))


@query(
    "r03_graph_search",
    f"""WITH RECURSIVE q AS (SELECT n_nationkey AS question_id, 'in which ' || r_name || ' is ' || n_name AS question FROM nation JOIN region ON n_regionkey = r_regionkey),
        asked AS (SELECT DISTINCT question_id, unnest(list_filter(string_split(question, ' '), lambda w: length(w) > 2)[1:3]) AS term FROM q),
        {graph_plans.paths_sql("SELECT DISTINCT term FROM asked")}
        SELECT question_id, asked.term, CAST(hops AS INTEGER) AS hops, key, nodes FROM asked JOIN best ON asked.term = best.term""",
)
def r03_graph_search(spark, sf_dir):
    n = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    questions = n.select(F.col("n_nationkey").alias("question_id"), F.concat(F.lit("in which "), "r_name", F.lit(" is "), "n_name").alias("question"))
    return retrieval.graph_search(graph_plans.places_edges(spark, sf_dir), questions).select("question_id", "term", "hops", "key", "nodes")


KINDS = ["text", "image", "table", "chart"]


def hits(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The vectors nearest to the first one, with documents in the part of their chunks."""
    v, q = _vectors(spark, sf_dir)
    top = retrieval.top_k(v, q, k)
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"), F.col("source").alias("file_id"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod("vec_id", F.lit(4)) + 1).cast("int"))
    return top.join(d, "vec_id", "left").select(F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("chunk_id"), "file_id", "content", kind.alias("content_type"), "score", F.col("vec_id").alias("seq"))


def fused(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    p = graph_plans.paths(spark, sf_dir).filter("term = 'ASIA'")
    # Ten paths at most, so ranking them in one task is no burden.
    return retrieval.fuse(hits(spark, sf_dir, k), p.select(F.col("nodes").alias("path"), F.row_number().over(W.orderBy("key")).cast("long").alias("seq")))


def _fused_sql(k: int) -> str:
    return f"""{graph_plans.PATHS_SQL},
top AS (SELECT e.vec_id, {_DOT} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {_DOT} DESC, e.vec_id LIMIT {k}),
u AS (SELECT 'vector' AS type, ['text', 'image', 'table', 'chart'][vec_id % 4 + 1] AS content_type, text AS content, source AS file_id, 'c' || vec_id AS chunk_id, score, CAST(NULL AS VARCHAR) AS path, 0 AS part, vec_id AS seq FROM top LEFT JOIN documents ON doc_id = vec_id
  UNION ALL SELECT 'graph', 'graph', NULL, NULL, NULL, 0.8::DOUBLE, nodes, 1, row_number() OVER (ORDER BY key) FROM best WHERE term = 'ASIA'),
fused AS (SELECT *, CAST(row_number() OVER (ORDER BY content_type <> 'text' DESC, score DESC, part, seq) AS INTEGER) AS rank FROM u QUALIFY rank <= 15)"""


@query("r04_fusion", f"WITH RECURSIVE {_fused_sql(5)} SELECT rank, type, content_type, chunk_id, file_id, content, path, round(score, 6) AS score FROM fused")
def r04_fusion(spark, sf_dir):
    return fused(spark, sf_dir).select("rank", "type", "content_type", "chunk_id", "file_id", "content", "path", F.round("score", 6).alias("score"))


@query("r06_media_map", f"WITH RECURSIVE {_fused_sql(12)} SELECT chunk_id, content_type, content, rank FROM fused WHERE content_type NOT IN ('text', 'graph')")
def r06_media_map(spark, sf_dir):
    return retrieval.media_map(fused(spark, sf_dir, 12))


_PIECE = "CASE WHEN type = 'graph' THEN '关系信息 ' || rank || '：' || chr(10) || '相关实体关系信息' || chr(10) {} ELSE '文档片段 ' || rank || '：' || chr(10) || content || chr(10) END"


@query("r07_context", f"WITH RECURSIVE {_fused_sql(5)} SELECT string_agg({_PIECE.format('')}, chr(10) ORDER BY rank) AS context FROM fused")
def r07_context(spark, sf_dir):
    return retrieval.context(fused(spark, sf_dir))


_MEDIA = "WHEN content_type <> 'text' THEN '多媒体内容 ' || rank || '（' || content_type || '）：[' || upper(content_type) || ':' || chunk_id || ']' || chr(10) || '描述：' || content || chr(10)"


@query("r08_context_placeholders", f"WITH RECURSIVE {_fused_sql(5)} SELECT string_agg({_PIECE.format(_MEDIA)}, chr(10) ORDER BY rank) AS context FROM fused")
def r08_context_placeholders(spark, sf_dir):
    return retrieval.context(fused(spark, sf_dir), placeholders=True)


@query(
    "r25_placeholders",
    f"""WITH RECURSIVE {_fused_sql(12)}, m AS (SELECT chunk_id, content FROM fused WHERE content_type NOT IN ('text', 'graph')),
        a AS (SELECT doc_id AS answer_id, regexp_extract_all('See [IMAGE:c' || doc_id || '] and [TABLE:c' || (doc_id + 1) || '], not [this] ' || text, '(\\[[A-Z]+:[^\\]]+\\])', 1) AS marks FROM documents),
        p AS (SELECT answer_id, CAST(i - 1 AS INTEGER) AS position, marks[i] AS mark FROM a, LATERAL (SELECT unnest(range(1, len(marks) + 1)) AS i)),
        k AS (SELECT answer_id, position, lower(regexp_extract(mark, '^\\[([A-Z]+):', 1)) AS kind, regexp_extract(mark, ':([^\\]]+)\\]$', 1) AS chunk_id FROM p)
        SELECT answer_id, position, kind, k.chunk_id, m.chunk_id IS NOT NULL AS known, m.content AS description FROM k LEFT JOIN m ON k.chunk_id = m.chunk_id""",
)
def r25_placeholders(spark, sf_dir):
    i = F.col("doc_id")
    text = F.concat(F.lit("See [IMAGE:c"), i.cast("string"), F.lit("] and [TABLE:c"), (i + 1).cast("string"), F.lit("], not [this] "), F.col("text"))
    return retrieval.resolve_placeholders(load(spark, sf_dir, "documents").select(i.alias("answer_id"), text.alias("text")), retrieval.media_map(fused(spark, sf_dir, 12)))


_ASKED = ["显示图片", "统计数据", "what is this"]


@query(
    "r17_layout",
    f"""WITH RECURSIVE {_fused_sql(5)}, q AS (SELECT unnest([{', '.join(f"'{x}'" for x in _ASKED)}]) AS query),
        c AS (SELECT 0 AS position, 'images' AS section, '相关图片' AS title, count_if(content_type = 'image') AS count, true AS interactive FROM fused UNION ALL SELECT 1, 'tables', '数据表格', count_if(content_type = 'table'), true FROM fused
              UNION ALL SELECT 2, 'charts', '图表分析', count_if(content_type = 'chart'), true FROM fused UNION ALL SELECT 3, 'text_summary', '详细解答', 1, false)
        SELECT query, CAST(position AS INTEGER) AS position, section, title, CAST(count AS BIGINT) AS count, interactive, CASE WHEN contains(query, '图') THEN 'media_first' WHEN contains(query, '表格') OR contains(query, '数据') OR contains(query, '统计') THEN 'mixed' ELSE 'text_first' END AS content_flow
        FROM c, q WHERE count > 0""",
)
def r17_layout(spark, sf_dir):
    own = fused(spark, sf_dir)
    return reduce(DataFrame.union, [retrieval.layout(own, F.lit(q)).select(F.lit(q).alias("query"), "*") for q in _ASKED])


@query("a09_type_histogram", f"WITH RECURSIVE {_fused_sql(12)} SELECT content_type, count(*) AS n, bool_or(content_type = 'image') AS images FROM fused GROUP BY content_type")
def a09_type_histogram(spark, sf_dir):
    return fused(spark, sf_dir, 12).groupBy("content_type").agg(F.count("*").alias("n"), F.bool_or(F.col("content_type") == "image").alias("images"))


@query(
    "r20_key_points",
    r"""WITH d AS (SELECT doc_id, string_split(replace(text, '.', '。'), chr(10)) AS l FROM documents),
        r AS (SELECT doc_id, n, ['text', 'image', 'text', 'chart'][(doc_id + n) % 4 + 1] AS k, l[n] AS c FROM d, (SELECT unnest(range(1, 6)) AS n) WHERE n <= len(l)),
        p AS (SELECT doc_id, n, i, CASE WHEN k = 'text' THEN regexp_replace(string_split(c, '。')[i], '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') END AS s, k, c FROM r, (SELECT unnest([1, 2]) AS i) WHERE length(c) > 50 AND (k = 'text' OR i = 1)),
        o AS (SELECT doc_id, n, i, CASE WHEN k = 'text' THEN s || '。' ELSE k || '内容：' || c[1:100] || '...' END AS point FROM p WHERE k <> 'text' OR length(s) > 20)
        SELECT doc_id, array_to_string(list(point ORDER BY n, i)[1:5], '|') AS points FROM o GROUP BY doc_id""",
)
def r20_key_points(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("text", "image", "text", "chart")))
    kind = lambda i: F.element_at(kinds, (F.pmod(F.col("doc_id") + i + 1, F.lit(4)) + 1).cast("int"))
    results = F.transform(F.split(F.replace("text", F.lit("."), F.lit("。")), "\n"), lambda c, i: F.struct(kind(i).alias("content_type"), c.alias("content")))
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(retrieval.key_points(results), "|").alias("points")).filter("points <> ''")


@query(
    "a11_media_flags",
    f"""WITH RECURSIVE {_fused_sql(12)} SELECT bool_or(content_type = 'image') AS has_images, bool_or(content_type = 'table') AS has_tables, bool_or(content_type = 'chart') AS has_charts,
        count(*) FILTER (WHERE content_type IN ('image', 'table', 'chart')) AS media_count, count(*) AS results, array_to_string(list_sort(list(DISTINCT content_type) FILTER (WHERE content_type <> 'text')), ',') AS kinds FROM fused""",
)
def a11_media_flags(spark, sf_dir):
    return retrieval.media_flags(fused(spark, sf_dir, 12)).withColumn("kinds", F.array_join("kinds", ","))


@query(
    "r21_recommendations",
    """WITH t AS (SELECT conv_id, list(DISTINCT ['text', 'image', 'table', 'chart', 'graph'][(conv_id + turn) % 5 + 1]) AS k FROM conversations GROUP BY conv_id)
       SELECT conv_id, array_to_string(list_concat(CASE WHEN list_contains(k, 'image') THEN ['建议仔细查看相关图片以获得更直观的理解'] ELSE [] END, CASE WHEN list_contains(k, 'table') THEN ['建议分析表格数据以发现更多数据模式'] ELSE [] END,
              CASE WHEN list_contains(k, 'chart') THEN ['建议研究图表趋势以了解数据变化'] ELSE [] END, ['可以基于这些内容提出更具体的问题', '建议关注关键数据点和趋势分析'])[1:4], '|') AS recommendations FROM t""",
)
def r21_recommendations(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, [*KINDS, "graph"])), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) + 1).cast("int"))
    rows = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set(kind).alias("k"))
    return rows.select("conv_id", F.array_join(retrieval.recommendations(F.col("k")), "|").alias("recommendations"))


@query(
    "r22_suggestions",
    """SELECT conv_id, turn, array_to_string(list_concat(CASE WHEN contains(q, '表格') OR contains(q, '数据') THEN ['显示相关的数据表格', '分析表格中的趋势', '比较不同数据项'] ELSE [] END,
              CASE WHEN contains(q, '图') OR contains(q, '图片') THEN ['解释图表内容', '描述图像信息', '分析视觉元素'] ELSE [] END, ['总结文档主要内容', '提取关键信息', '查找相关章节'])[1:5], '|') AS suggestions
       FROM (SELECT conv_id, turn, text || ['', ' 数据', ' 图片', ' 表格和图'][(conv_id + turn) % 4 + 1] AS q FROM conversations WHERE role = 'user')""",
)
def r22_suggestions(spark, sf_dir):
    extra = F.element_at(F.array(*map(F.lit, ("", " 数据", " 图片", " 表格和图"))), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)) + 1).cast("int"))
    rows = load(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.concat("text", extra).alias("q"))
    return rows.select("conv_id", "turn", F.array_join(retrieval.suggestions(F.col("q")), "|").alias("suggestions"))


@query("r23_multimodal_list", "SELECT event_id, event_type, CAST(props ->> '$.k' AS INTEGER) AS k FROM events WHERE user_id = 8 AND CAST(props ->> '$.k' AS INTEGER) % 2 = 0")
def r23_multimodal_list(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return load(spark, sf_dir, "events").filter("user_id = 8").select("event_id", "event_type", k.alias("k")).filter("k % 2 = 0")

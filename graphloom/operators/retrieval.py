"""Vector search, fusion with graph hits, and what is assembled from fused results."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import prepare
from ..functions.text import dot, query_terms, strip
from ..sources import providers
from ..sources.folders import stored
from ..sources.tables import CHART_METADATA, IMAGE_METADATA, media_metadata, with_tables
from . import graph, products

TOP_K, THRESHOLD, FUSED, GRAPH_SCORE = 5, 0.7, 15, 0.8

# How the original product words its answers' parts.
PIECE, RELATION, MEDIA, DESCRIPTION, GRAPH_TEXT = "文档片段 ", "关系信息 ", "多媒体内容 ", "描述：", "相关实体关系信息"
ADVICE = [("image", "建议仔细查看相关图片以获得更直观的理解"), ("table", "建议分析表格数据以发现更多数据模式"), ("chart", "建议研究图表趋势以了解数据变化")]
ADVICE_ALWAYS = ["可以基于这些内容提出更具体的问题", "建议关注关键数据点和趋势分析"]
HINTS = [(("表格", "数据"), ["显示相关的数据表格", "分析表格中的趋势", "比较不同数据项"]), (("图", "图片"), ["解释图表内容", "描述图像信息", "分析视觉元素"])]
HINTS_ALWAYS = ["总结文档主要内容", "提取关键信息", "查找相关章节"]
SECTIONS = [("image", "images", "相关图片"), ("table", "tables", "数据表格"), ("chart", "charts", "图表分析")]
SUMMARY = ("text_summary", "详细解答")
FLOWS = [("media_first", ("图",)), ("mixed", ("表格", "数据", "统计"))]


def top_k(vectors: DataFrame, query: DataFrame, k: int = TOP_K, threshold: float | None = None, key: str = "vec_id") -> DataFrame:
    """The k vectors of highest inner product with the one query vector (embedding), by score and then key.

    One query row, limited so, meets all vectors; each task keeps its own k before they merge. Filtering by a threshold
    before the limit gives the same rows as after it.
    """
    q = query.select(F.col("embedding").alias("__q")).limit(1)
    scored = vectors.join(F.broadcast(q)).withColumn("score", dot(F.col("embedding"), F.col("__q"))).drop("__q")
    if threshold is not None:
        scored = scored.filter((F.col("score") >= threshold) & ~F.isnan("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


#: Vectors, and queries, that one group of the search of many queries scores against each other.
VECTOR_BLOCK, QUERY_BLOCK = 1 << 16, 1 << 16


def _meet(x: DataFrame, q: DataFrame, by: list[str], k: int, key: str) -> DataFrame:
    """The k best of each query (query_id, q) among the vectors (key, v) of its groups, with their rank. A group keeps k rows of each of its queries before these are shuffled."""
    schema = T.StructType([T.StructField("query_id", q.schema["query_id"].dataType), T.StructField(key, x.schema["key"].dataType), T.StructField("score", T.DoubleType())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, ids = left.column("key"), right.column("query_id")
        if not len(keys) or not len(ids):
            return pa.Table.from_arrays([ids.slice(0, 0), keys.slice(0, 0), pa.array([], pa.float64())], names=schema.names)
        # Vectors in order of their keys, so that of equal scores the first stay.
        order = pc.sort_indices(keys).to_numpy()
        at, which, score = products.best(products.matrix(right.column("q")), products.matrix(left.column("v"))[order], k)
        return pa.Table.from_arrays([ids.take(pa.array(at)), keys.take(pa.array(order[which])), pa.array(score)], names=schema.names)

    scored = x.groupBy(*by).cogroup(q.groupBy(*by)).applyInArrow(meet, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k_of_each(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, most_queries: int = QUERY_BLOCK, key: str = "vec_id") -> DataFrame:
    """As top_k for a stated set of queries (query_id, embedding): the k best of each, with their rank; ties go by key.

    Vectors and queries are dealt over blocks, and each block of the one meets each of the other once, as two matrices: one
    plan whatever the number of queries. A task holds one block of each and the products of some queries at a time.
    """
    spark = vectors.sparkSession
    prepare(spark)
    n, m = vectors.count(), queries.count()
    # At least four blocks for each task that runs at once, where there are so many rows.
    blocks = max(1, -(-n // VECTOR_BLOCK), min(4 * spark.sparkContext.defaultParallelism, n // 256))
    turns = max(1, -(-m // most_queries))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    x = vectors.select(F.col(key).alias("key"), F.col("embedding").alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), every(turns).alias("turn"))
    q = queries.select("query_id", F.col("embedding").alias("q"), F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int").alias("turn"), every(blocks).alias("block"))
    return _meet(x, q, ["block", "turn"], k, key)


def inverted_file(vectors: DataFrame, lists: int = 128, sample_rows: int = 20_000, seed: int = 7):
    """(vectors with `list`, centroids): k-means is fitted on a bounded sample by hash, every vector gets its nearest list."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    total = max(1, vectors.count())
    share = min(1.0, sample_rows / total)
    sample = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    model = KMeans(k=min(lists, total), seed=seed, maxIter=8).fit(sample.select("features"))
    spark = vectors.sparkSession
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list int, centre array<double>")
    return model.transform(rows).withColumnRenamed("prediction", "list").drop("features"), centres


def write_index(indexed: DataFrame, centres: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The index as tables, vectors parted by list, so that a search reads the folders of the lists that it probes; read again."""
    indexed.repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
    centres.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    spark = indexed.sparkSession
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/centres")


def probed_top_k(indexed: DataFrame, centres: DataFrame, query: DataFrame, k: int = TOP_K, probes: int = 10) -> DataFrame:
    """Approximate top-k: only the lists whose centroids have the highest inner product with the query are searched."""
    q = query.select(F.col("embedding").alias("__q")).limit(1)
    lists = centres.join(F.broadcast(q)).orderBy(F.desc(dot(F.col("centre"), F.col("__q"))), "list").limit(probes).select("list")
    return top_k(indexed.join(F.broadcast(lists), "list", "left_semi"), query, k)


def probed_top_k_of_each(indexed: DataFrame, centres: DataFrame, queries: DataFrame, k: int = TOP_K, probes: int = 10) -> DataFrame:
    """As probed_top_k for many queries (query_id, embedding): each searches the lists nearest to it, and a list meets its queries as two matrices."""
    prepare(indexed.sparkSession)
    near = top_k_of_each(centres.select(F.col("list").cast("long").alias("vec_id"), F.col("centre").alias("embedding")), queries, probes)
    turns = max(1, -(-queries.count() // QUERY_BLOCK))
    sizes = F.broadcast(indexed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / VECTOR_BLOCK).cast("int").alias("blocks")))
    asked = queries.select("query_id", F.col("embedding").alias("q")).join(near.select("query_id", F.col("vec_id").cast("int").alias("list")), "query_id").join(sizes, "list")
    asked = asked.select("query_id", "q", "list", F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int").alias("turn"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    x = indexed.join(sizes, "list").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"), "list", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
    return _meet(x, asked, ["list", "block", "turn"], k, "vec_id")


def vector_search(vectors: DataFrame, question: str, embedder=None, k: int = TOP_K, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of the vector table (chunk_id, file_id, content, metadata, embedding) nearest to a question, if near enough; seq is their rank."""
    spark = vectors.sparkSession
    asked = providers.embed(spark.createDataFrame([(question,)], "text string"), "text", embedder)
    found = top_k(vectors, asked, k, threshold, "chunk_id").drop("embedding")
    kind = F.coalesce(F.get_json_object("metadata", "$.type"), F.lit("text")).alias("content_type")
    return found.select("chunk_id", "file_id", "content", "metadata", kind, "score", F.row_number().over(W.orderBy(F.desc("score"), "chunk_id")).cast("long").alias("seq"))


def graph_search(edges: DataFrame, questions: DataFrame, max_hops: int = 3, max_paths: int = 10) -> DataFrame:
    """Trails from the nodes that terms of the questions (question_id, question) name: question_id, term, hops, key, nodes."""
    asked = questions.select("question_id", F.explode(F.array_distinct(query_terms(F.col("question")))).alias("term"))
    return asked.join(graph.trails(edges, asked.select("term").distinct(), max_hops, max_paths), "term")


def search(vectors: DataFrame, edges: DataFrame, question: str, embedder=None, k: int = TOP_K, threshold: float = THRESHOLD, most: int = FUSED) -> DataFrame:
    """A question's way: its vector to the nearest chunks, its terms to trails of the graph, and both fused. A blank question finds nothing."""
    asked = vectors.sparkSession.createDataFrame([(0, question)] if question.strip() else [], "question_id long, question string")
    near = vector_search(vectors if question.strip() else vectors.limit(0), question, embedder, k, threshold)
    found = graph_search(edges, asked)
    return fuse(near, found.select(F.col("nodes").alias("path"), F.row_number().over(W.orderBy("term", "hops", "key")).cast("long").alias("seq")), most)


def search_each(vectors: DataFrame, edges: DataFrame, questions: DataFrame, embedder=None, k: int = TOP_K, threshold: float = THRESHOLD, most: int = FUSED) -> DataFrame:
    """As search for many questions (question_id, question) in one plan: question_id, and the columns of its fused results.

    Questions are embedded beside each other and meet the vectors in blocks; trails are searched once for each distinct
    term; each question's results are ranked on their own, which are k + 3 * 10 rows at most. Blank questions find nothing.
    """
    own = questions.filter(F.length(strip(F.coalesce("question", F.lit("")))) > 0)
    # Vectors are made once: they are counted, searched and looked up from a stored table.
    vectors, asked = (stored(x, "embedded") for x in (vectors, providers.embed(own.select("question_id", "question"), "question", embedder).select(F.col("question_id").alias("query_id"), "embedding")))
    best = top_k_of_each(vectors, asked, k, key="chunk_id").filter((F.col("score") >= threshold) & ~F.isnan("score"))
    rows = vectors.select("chunk_id", "file_id", "content", "metadata")
    near = best.select(F.col("query_id").alias("question_id"), "chunk_id", "score", F.col("rank").cast("long").alias("seq")).join(rows, "chunk_id")
    near = near.withColumn("content_type", F.coalesce(F.get_json_object("metadata", "$.type"), F.lit("text")))
    found = graph_search(edges, own)
    paths = found.select("question_id", F.col("nodes").alias("path"), F.row_number().over(W.partitionBy("question_id").orderBy("term", "hops", "key")).cast("long").alias("seq"))
    return fuse(near, paths, most, ["question_id"])


def media_listing(chunks: DataFrame, file_id: str | None = None, kind: str | None = None) -> DataFrame:
    """Chunks that are no text, of a file and of a kind, where these are given."""
    out = chunks.filter(F.col("content_type") != "text")
    out = out if file_id is None else out.filter(F.col("file_id") == file_id)
    return out if kind is None else out.filter(F.col("content_type") == kind)


def media_flags(fused: DataFrame) -> DataFrame:
    """One row: whether there are images, tables and charts, how many media, results, and the kinds other than text."""
    media = ("image", "table", "chart")
    any_ = lambda k: F.coalesce(F.bool_or(F.col("content_type") == k), F.lit(False)).alias(f"has_{k}s")
    return fused.agg(*map(any_, media), F.count_if(F.col("content_type").isin(*media)).alias("media_count"), F.count(F.lit(1)).alias("results"), F.array_sort(F.collect_set(F.when(F.col("content_type") != "text", F.col("content_type")))).alias("kinds"))


def fuse(vector_hits: DataFrame, graph_hits: DataFrame, most: int = FUSED, by: list[str] | None = None) -> DataFrame:
    """Vector hits (chunk_id, file_id, content, content_type, score, seq, and metadata where there are any) and graph hits
    (path, seq), media before text, then by score, then in order of arrival; the first fifteen, with their rank. `by` names
    columns of both, such as a question's id: each of their values is fused on its own.
    """
    keys = by or []
    extra = [c for c in ("metadata",) if c in vector_hits.columns]
    v = vector_hits.select(*keys, F.lit("vector").alias("type"), "content_type", "content", "file_id", "chunk_id", *extra, "score", F.lit(None).cast("string").alias("path"), F.lit(0).alias("part"), "seq")
    g = graph_hits.select(*keys, F.lit("graph").alias("type"), F.lit("graph").alias("content_type"), F.lit(GRAPH_SCORE).alias("score"), "path", F.lit(1).alias("part"), "seq")
    both = v.unionByName(g, allowMissingColumns=True)
    order = [(F.col("content_type") != "text").desc(), F.desc("score"), F.asc("part"), F.asc("seq")]
    top = both if keys else both.orderBy(*order).limit(most)
    return top.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= most).drop("part", "seq")


def with_details(fused: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Fused results with what their kind has to tell, of their metadata (JSON): of an image and a chart the fields that an answer
    shows, of a table its data (tables: chunk_id, table_data), summary, size, column types and insights; null for other kinds.
    """
    kind = F.col("content_type")
    of = lambda k, fields: F.when(kind == k, media_metadata(F.col("metadata"), fields))
    out = fused.withColumns({"image": of("image", IMAGE_METADATA), "chart": of("chart", CHART_METADATA)})
    if tables is None:
        return out
    own = with_tables(fused.filter(kind == "table").select("chunk_id", "content", "metadata").distinct(), tables)
    parts = ("table_data", "table_summary", "rows", "columns", "data_types", "key_insights", "status")
    return out.join(own.select("chunk_id", F.struct(*parts).alias("table")), "chunk_id", "left")


def media_map(fused: DataFrame) -> DataFrame:
    """Media of fused results by chunk: the last of a chunk wins; graph hits are not media."""
    own = fused.filter(~F.col("content_type").isin("text", "graph"))
    return own.groupBy("chunk_id").agg(F.max_by(F.struct("content_type", "content", "rank"), "rank").alias("m")).select("chunk_id", "m.*")


def context(fused: DataFrame, placeholders: bool = False) -> DataFrame:
    """One row: the numbered pieces of the fused results; with placeholders, media stand as [TYPE:chunk]."""
    n = F.col("rank").cast("string")
    text = F.concat(F.lit(PIECE), n, F.lit("：\n"), F.col("content"), F.lit("\n"))
    relation = F.concat(F.lit(RELATION), n, F.lit("：\n"), F.lit(GRAPH_TEXT), F.lit("\n"))
    media = F.concat(F.lit(MEDIA), n, F.lit("（"), F.col("content_type"), F.lit("）："), placeholder(F.col("content_type"), F.col("chunk_id")), F.lit("\n"), F.lit(DESCRIPTION), F.col("content"), F.lit("\n"))
    piece = F.when(F.col("type") == "graph", relation)
    if placeholders:
        piece = piece.when(F.col("content_type") != "text", media)
    return fused.select("rank", piece.otherwise(text).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "piece"))), lambda x: x["piece"]), "\n").alias("context"))


def placeholder(content_type: Column, chunk_id: Column) -> Column:
    return F.concat(F.lit("["), F.upper(content_type), F.lit(":"), chunk_id, F.lit("]"))


def resolve_placeholders(answers: DataFrame, media: DataFrame) -> DataFrame:
    """Placeholders of answers (answer_id, text) in order, with the media they name, where known."""
    found = F.regexp_extract_all("text", F.lit(r"(\[[A-Z]+:[^\]]+\])"), F.lit(1))
    rows = answers.select("answer_id", F.posexplode(found).alias("position", "mark"))
    rows = rows.select("answer_id", "position", F.lower(F.regexp_extract("mark", r"^\[([A-Z]+):", 1)).alias("kind"), F.regexp_extract("mark", r":([^\]]+)\]$", 1).alias("chunk_id"))
    return rows.join(media.select("chunk_id", F.lit(True).alias("known"), F.col("content").alias("description")), "chunk_id", "left").select("answer_id", "position", "kind", "chunk_id", F.coalesce("known", F.lit(False)).alias("known"), "description")


def content_flow(query: Column) -> Column:
    out = F.lit("text_first")
    for flow, words in reversed(FLOWS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(query, F.lit(w))
        out = F.when(hit, F.lit(flow)).otherwise(out)
    return out


def layout(fused: DataFrame, query: Column) -> DataFrame:
    """Sections (position, section, title, count, interactive, content_flow) for the media found, and one for the answer."""
    counts = fused.agg(*[F.count_if(F.col("content_type") == kind).alias(kind) for kind, _, _ in SECTIONS])
    row = lambda i, section, title, n, interactive: F.struct(F.lit(i).alias("position"), F.lit(section).alias("section"), F.lit(title).alias("title"), n.cast("long").alias("count"), F.lit(interactive).alias("interactive"))
    all_ = F.array(*[row(i, s, t, F.col(kind), True) for i, (kind, s, t) in enumerate(SECTIONS)], row(len(SECTIONS), *SUMMARY, F.lit(1), False))
    return counts.select(F.explode(F.filter(all_, lambda s: s["count"] > 0)).alias("s"), content_flow(query).alias("content_flow")).select("s.*", "content_flow")


def key_points(results: Column) -> Column:
    """From the first five results (array of content_type, content): sentences of texts, and heads of media; at most five."""
    def points(r: Column) -> Column:
        sentences = F.transform(F.slice(F.split(r["content"], "。"), 1, 2), strip)
        text = F.transform(F.filter(sentences, lambda s: F.length(s) > 20), lambda s: F.concat(s, F.lit("。")))
        media = F.array(F.concat(r["content_type"], F.lit("内容："), F.substring(r["content"], 1, 100), F.lit("...")))
        none = F.array().cast("array<string>")
        return F.when(F.coalesce(F.length(r["content"]), F.lit(0)) <= 50, none).when(r["content_type"] == "text", text).when(r["content_type"].isin("image", "table", "chart"), media).otherwise(none)

    return F.slice(F.flatten(F.transform(F.slice(results, 1, 5), points)), 1, 5)


def _some(pairs, test) -> Column:
    """Texts whose test holds, in order."""
    return F.flatten(F.array(*[F.when(test(k), F.array(*[F.lit(t) for t in texts])).otherwise(F.array().cast("array<string>")) for k, texts in pairs]))


def recommendations(types: Column) -> Column:
    return F.slice(F.concat(_some([(k, [t]) for k, t in ADVICE], lambda k: F.array_contains(types, k)), F.array(*[F.lit(t) for t in ADVICE_ALWAYS])), 1, 4)


def suggestions(query: Column) -> Column:
    def any_of(words) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(query, F.lit(w))
        return out

    return F.slice(F.concat(_some(HINTS, any_of), F.array(*[F.lit(t) for t in HINTS_ALWAYS])), 1, 5)

"""From pages to chunks, vectors and graph: the batch form of what happens to an uploaded file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import providers
from . import chunking, graph, tables

SMALLEST_IMAGE = 50

PAGES = "file_id string, page_number int, text string, tables array<array<array<string>>>, images array<struct<width:int,height:int,channels:int,alpha:int,format:string,bytes:binary>>, charts array<struct<chart_type:string,axis_labels:map<string,string>,legend_info:array<string>>>"


def _chunk_id(kind: str):
    return F.concat_ws("_", "file_id", F.lit("page"), "page_number", F.lit(kind), "chunk_index").alias("chunk_id")


def image_chunks(pages: DataFrame) -> DataFrame:
    """Images of at least 50 pixels either way that are not CMYK; a broken image is left out without harm to the others."""
    rows = pages.select("file_id", "page_number", F.posexplode("images").alias("chunk_index", "image"))
    good = rows.filter((F.col("image.width") >= SMALLEST_IMAGE) & (F.col("image.height") >= SMALLEST_IMAGE) & (F.col("image.channels") - F.col("image.alpha") < 4))
    return good.select(_chunk_id("image"), "file_id", F.lit("image").alias("content_type"), F.lit("").alias("content"), "page_number", "chunk_index", F.col("image.bytes").alias("media_bytes"), F.col("image.format").alias("media_format"), F.col("image.width").alias("width"), F.col("image.height").alias("height"))


def table_chunks(pages: DataFrame) -> DataFrame:
    """Tables with a row beside the header, as text, with summary, column types and insights."""
    rows = pages.select("file_id", "page_number", F.posexplode("tables").alias("chunk_index", "table_data")).filter(F.size("table_data") > 1)
    t = F.col("table_data")
    return rows.select(
        _chunk_id("table"), "file_id", F.lit("table").alias("content_type"), tables.formatted(t, F.col("page_number"), F.col("chunk_index")).alias("content"), "page_number", "chunk_index", "table_data",
        tables.summary(t).alias("summary"), tables.column_types(t).alias("data_types"), tables.insights(t).alias("key_insights"),
    )


def chart_chunks(pages: DataFrame) -> DataFrame:
    rows = pages.select("file_id", "page_number", F.posexplode("charts").alias("chunk_index", "chart"))
    return rows.select(_chunk_id("chart"), "file_id", F.lit("chart").alias("content_type"), F.col("chart.chart_type").alias("content"), "page_number", "chunk_index", "chart.chart_type", "chart.axis_labels", "chart.legend_info")


def multimodal_chunks(pages: DataFrame) -> DataFrame:
    """All chunks of pages: text, images, tables, charts, in one table whose order is (page, kind, index)."""
    text = chunking.chunk_records(pages).drop("metadata")
    out = text.unionByName(image_chunks(pages), allowMissingColumns=True).unionByName(table_chunks(pages), allowMissingColumns=True).unionByName(chart_chunks(pages), allowMissingColumns=True)
    kinds = F.array(*map(F.lit, ("text", "image", "table", "chart")))
    return out.withColumn("kind_order", F.array_position(kinds, F.col("content_type")).cast("int"))


def vectors(chunks: DataFrame, embedder: providers.Embedder | None = None) -> DataFrame:
    """Rows for the vector table: the chunk's text, its vector, and what else is known of it as JSON."""
    meta = F.to_json(F.struct(F.col("content_type").alias("type"), F.col("page_number").alias("page"), "chunk_index")).alias("metadata")
    return providers.embed(chunks.filter(F.length("content") > 0).select("file_id", "chunk_id", "content", meta), "content", embedder)


#: Order in which the kinds of a file's chunks arrive in its graph.
ARRIVAL = ("text", "table", "image", "chart")


def _arrival(kind: str, *parts) -> Column:
    """Where something arrives among all of a file: numbers that are compared one after the other."""
    parts = [F.lit(ARRIVAL.index(kind)), *parts, *[F.lit(0)] * (4 - len(parts))]
    return F.array(*[p.cast("long") for p in parts]).alias("arrival")


def _read(chunks: DataFrame, kind: str, content: str, extractor: providers.Extractor | None, batch: int) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) that an extractor finds in a column of the chunks of a kind, `batch` of them at a time."""
    own = chunks.filter((F.col("content_type") == kind) & (F.length(content) > 0))
    found = providers.extracted(own.select("file_id", (F.col("page_number").cast("long") * 1_000_000 + F.col("chunk_index")).alias("seq"), "chunk_id", F.col(content).alias("content")), extractor, batch)
    # All chunks of a batch are sources; what was found comes in the order of the batches, and in its own.
    place = [F.col("batch")] if kind == "text" else [F.col("page_number"), F.col("chunk_index")]
    if kind != "text":
        found = found.join(own.select(F.array("chunk_id").alias("source_chunks"), "page_number", "chunk_index"), "source_chunks")
    e = found.select("*", F.posexplode("entities").alias("place", "e"))
    r = found.select("*", F.posexplode("relations").alias("place", "r"))
    entities = e.select("file_id", "e.name", "e.type", F.lit(0.8).alias("confidence"), F.lit(kind).alias("source_type"), "source_chunks", _arrival(kind, *place, F.lit(0), F.col("place")) if kind != "text" else _arrival(kind, *place, F.col("place")))
    relations = r.select("file_id", F.element_at("source_chunks", 1).alias("chunk_id"), "r.subject", "r.predicate", "r.object", "r.confidence", _arrival(kind, *place, F.col("place")))
    return entities, relations


def mentions(chunks: DataFrame, extractor: providers.Extractor | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of chunks, every mention of them: what an extractor finds in texts and in text that was read in
    pictures, objects seen in pictures, headers and cells of tables, labels of charts; with their file, sources and order of arrival.
    """
    entities, relations = _read(chunks, "text", "content", extractor, 2)
    at = chunks.select("chunk_id", "file_id", "page_number", "chunk_index")
    own = lambda df, source, kind, *place: df.join(at, "chunk_id").select("file_id", "name", "type", "confidence", F.lit(source).alias("source_type"), F.array("chunk_id").alias("source_chunks"), _arrival(kind, F.col("page_number"), F.col("chunk_index"), *place))
    linked = lambda df, kind: df.join(at, "chunk_id").select("file_id", "chunk_id", "subject", "predicate", "object", "confidence", _arrival(kind, F.col("page_number"), F.col("chunk_index"), F.col("place")))
    if "text_content" in chunks.columns:
        seen, of_pictures = _read(chunks, "image", "text_content", extractor, 1)
        objects = graph.image_entities(chunks.filter("content_type = 'image'"))
        entities = entities.unionByName(seen).unionByName(own(objects, "image", "image", F.lit(1), F.col("place")))
        relations = relations.unionByName(of_pictures)
    tabled = chunks.filter("content_type = 'table'")
    entities = entities.unionByName(own(tables.table_entities(tabled), "table", "table", F.col("place.row"), F.col("place.col")))
    of_charts, chart_relations = graph.chart_graph(chunks.filter("content_type = 'chart'"))
    entities = entities.unionByName(own(of_charts, "chart", "chart", F.col("part"), F.col("place")))
    return entities, relations.unionByName(linked(tables.field_pairs(tabled), "table")).unionByName(linked(chart_relations, "chart"))


def knowledge(chunks: DataFrame, extractor: providers.Extractor | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of chunks, file by file: mentions of one name are merged, relations without both ends dropped, and
    of equal ones the first to arrive stays. The chunks of each entity are in `members`.
    """
    entities, relations = mentions(chunks, extractor)
    merged, _ = graph.entity_classes(entities, ("file_id",), "arrival")
    return merged, graph.filter_relations(relations, merged, ("file_id",), "arrival").drop("arrival")


def members(chunks: DataFrame, extractor: providers.Extractor | None = None) -> DataFrame:
    """Which chunks (file_id, key, chunk) each entity of `knowledge` has its mentions in; key is the name in lower case."""
    return graph.entity_classes(mentions(chunks, extractor)[0], ("file_id",), "arrival")[1]

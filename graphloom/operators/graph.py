"""The knowledge graph as two tables: entities are merged, relations filtered, nodes and edges upserted, trails searched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import sanitise, strip

NODE_DEFAULTS = {"type": "UNKNOWN", "confidence": 0.0, "source_type": "unknown"}
EDGE_DEFAULTS = {"predicate": "RELATED_TO", "confidence": 0.0, "source_type": "unknown"}


def name_key(name: Column) -> Column:
    """A name without case and outer spaces; one of visible ASCII alone has none to look for."""
    return F.lower(F.when(name.rlike("^[!-~]+$"), name).otherwise(strip(name)))


def entity_classes(entities: DataFrame, by: tuple[str, ...] = (), arrival: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(representatives, members) of entities (name, type, source_type, confidence, source_chunks and their order of arrival).

    Entities of one name, whatever its case and outer spaces, are a class, apart for each value of the columns `by`. It is
    represented by its most confident spelling, of equals the one that arrived first, with the number of mentions where
    there are several. Members are a table (key, chunk), each once: no row holds all chunks of a name, and a name of very
    many chunks is spread over the tasks.
    """
    known = entities.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    # Counted per spelling and confidence first: of a frequent name few rows are left to be stripped and compared.
    spelt = known.groupBy(*by, "name", "type", "source_type", "confidence").agg(F.min(arrival).alias("first"), F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct("name", "type", "source_type", "confidence"), F.struct((-F.col("confidence")).alias("c"), "first"))
    own = spelt.withColumn("key", name_key(F.col("name"))).groupBy(*by, "key").agg(best.alias("b"), F.sum("n").alias("n"))
    members = entities.select(*by, name_key(F.col("name")).alias("key"), F.explode("source_chunks").alias("chunk")).distinct()
    return own.select(*by, "key", "b.name", "b.type", "b.source_type", "b.confidence", F.when(F.col("n") > 1, F.col("n")).alias("merged_count")), members


def named_chunks(chunks: DataFrame) -> DataFrame:
    """Members (key, chunk), each once, of chunks (chunk, names: the names in it), where the names of a chunk lie together.

    They are made distinct in their own row, so nothing is shuffled but the ids, which tell whether a chunk has several rows
    or none has an id; only such rows are made distinct over the tasks.
    """
    names = F.filter(F.array_distinct(F.transform(F.array_distinct("names"), name_key)), lambda k: k != "")
    spread = lambda rows: rows.select(F.explode(names).alias("key"), "chunk")
    again = chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("chunk")
    if again.isEmpty():
        return spread(chunks)
    same = chunks["chunk"].eqNullSafe(again["chunk"])
    return spread(chunks.join(again, same, "left_anti")).union(spread(chunks.join(again, same, "left_semi")).distinct())


def chunk_lists(members: DataFrame) -> DataFrame:
    """(key, source_chunks) of members: the chunks of a name in order. Each task gathers its own before they are shuffled."""
    return members.groupBy("key").agg(F.array_sort(F.collect_list("chunk")).alias("source_chunks"))


def filter_relations(relations: DataFrame, entities: DataFrame, by: tuple[str, ...] = (), arrival: str = "seq") -> DataFrame:
    """Relations with both ends among the entities' names, the first to arrive of each (subject, predicate, object); apart for each value of the columns `by`."""
    names = entities.select(*by, F.col("name")).distinct()
    both = relations
    for end in ("subject", "object"):
        both = both.join(names.withColumnRenamed("name", end), [*by, end], "left_semi")
    keys = [*by, "subject", "predicate", "object"]
    first = both.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in relations.columns if c not in keys]), arrival).alias("f"))
    return first.select(*keys, "f.*")


def latest(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last write of each key; partial aggregation keeps one row per key and task before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes keyed by sanitised label and stripped name, over all files; blank names are left out."""
    rows = nodes.filter(F.length(strip(F.coalesce("name", F.lit("")))) > 0)
    rows = rows.select(sanitise(F.coalesce("type", F.lit(NODE_DEFAULTS["type"])), "ENTITY_").alias("label"), strip(F.col("name")).alias("name"), "file_id", F.coalesce("confidence", F.lit(NODE_DEFAULTS["confidence"])).alias("confidence"), F.coalesce("source_type", F.lit(NODE_DEFAULTS["source_type"])).alias("source_type"), "seq")
    return latest(rows, ["label", "name"])


def upsert_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between all nodes that bear the names of both ends, whatever their labels; last write wins."""
    rel = relations.select(F.col("subject"), sanitise(F.coalesce("predicate", F.lit(EDGE_DEFAULTS["predicate"])), "REL_").alias("rel_type"), F.col("object"), "file_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "seq")
    a = nodes.select(F.col("label").alias("src_label"), F.col("name").alias("subject"))
    b = nodes.select(F.col("label").alias("dst_label"), F.col("name").alias("object"))
    return latest(rel.join(a, "subject").join(b, "object"), ["src_label", "subject", "rel_type", "dst_label", "object"])


def nodes_exist(names: DataFrame, nodes: DataFrame) -> DataFrame:
    return names.join(nodes.select("name").distinct().withColumn("hit", F.lit(True)), "name", "left").select("name", F.coalesce("hit", F.lit(False)).alias("found"))


def merge_properties(writes: DataFrame) -> DataFrame:
    """Nodes (label, name, props) after writes (label, name, props map, seq): each property has the value of its last write, and
    goes if that is null; properties that later writes don't name stay.
    """
    rows = writes.select("label", "name", "seq", F.explode_outer("props").alias("k", "v"))
    last = rows.groupBy("label", "name", "k").agg(F.max_by(F.struct("v"), "seq").alias("s"))
    kept = F.when(F.col("k").isNotNull() & F.col("s.v").isNotNull(), F.struct("k", "s.v"))
    return last.groupBy("label", "name").agg(F.map_from_entries(F.array_sort(F.collect_list(kept))).alias("props"))


def properties(props: Column, without: tuple[str, ...] = ("type", "name")) -> Column:
    """A map of properties without those that are kept elsewhere."""
    return F.map_filter(props, lambda k, _: ~k.isin(*without))


def relation_outcomes(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """relations with `outcome`: error where an end or the predicate is blank, failed where a node is missing, else created."""
    names = nodes.select("name").distinct()
    a, b = names.select(F.col("name").alias("subject"), F.lit(True).alias("__a")), names.select(F.col("name").alias("object"), F.lit(True).alias("__b"))
    wrong = reduce(lambda x, y: x | y, [F.coalesce(F.length(strip(F.col(c))) == 0, F.lit(True)) for c in ("subject", "predicate", "object")])
    outcome = F.when(wrong, F.lit("error")).when(F.col("__a") & F.col("__b"), F.lit("created")).otherwise(F.lit("failed"))
    return relations.join(a, "subject", "left").join(b, "object", "left").select(*relations.columns, outcome.alias("outcome"))


def outcome_counts(outcomes: DataFrame, by: str) -> DataFrame:
    """The counters of a batch of writes: created, failed and errors."""
    return outcomes.groupBy(by).agg(*[F.count_if(F.col("outcome") == k).alias(n) for k, n in (("created", "created"), ("failed", "failed"), ("error", "errors"))])


def detach_delete(nodes: DataFrame, edges: DataFrame, file_id: str) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of a file, the edges at those nodes, and the edges of the file."""
    gone = nodes.filter(F.col("file_id") == file_id)
    left = edges.filter(F.col("file_id") != file_id)
    for label, name in (("src_label", "subject"), ("dst_label", "object")):
        left = left.join(gone.select(F.col("label").alias(label), F.col("name").alias(name)), [label, name], "left_anti")
    return nodes.filter(F.col("file_id") != file_id), left


def trails(edges: DataFrame, starts: DataFrame, most_hops: int = 3, per_term: int = 10) -> DataFrame:
    """Undirected trails of 1 to most_hops edges from nodes named by a term, the first `per_term` of each by (hops, edges).

    edges (edge_id, src, dst), starts (term). An edge is used once in a trail, a node may come again. Shorter trails rank
    first, so a term with enough of them is not carried to the next hop.
    """
    steps = edges.select("edge_id", F.col("src").alias("at"), F.col("dst").alias("to")).union(edges.filter("src <> dst").select("edge_id", F.col("dst"), F.col("src")))
    now = starts.select("term", F.col("term").alias("end"), F.array().cast("array<string>").alias("path_edges"), F.array("term").alias("path_nodes"))
    rank = W.partitionBy("term").orderBy("hops", "key")
    kept = None
    for hop in range(1, most_hops + 1):
        now = now.join(steps, now["end"] == steps["at"]).filter(~F.array_contains("path_edges", F.col("edge_id")))
        now = now.select("term", F.col("to").alias("end"), F.concat("path_edges", F.array("edge_id")).alias("path_edges"), F.concat("path_nodes", F.array("to")).alias("path_nodes"))
        found = now.select("term", F.lit(hop).alias("hops"), F.array_join("path_edges", ">").alias("key"), F.array_join("path_nodes", ">").alias("nodes"))
        kept = found if kept is None else kept.union(found)
        kept = kept.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= per_term).drop("rank")
        if hop < most_hops:
            enough = kept.groupBy("term").count().filter(F.col("count") >= per_term)
            now = now.join(enough, "term", "left_anti")
    return kept


_ENTITIES, _RELATIONS = "array<struct<name:string,type:string>>", "array<struct<subject:string,predicate:string,object:string,confidence:double>>"


def _answered(response: Column) -> Column:
    """What the JSON between the first and last brace of a model's answer holds."""
    return F.from_json(F.regexp_extract(response, r"(?s)(\{.*\})", 1), f"entities {_ENTITIES}, relations {_RELATIONS}")


def parse_relations(response: Column) -> Column:
    """Relations (subject, predicate, object, confidence) of a model's answer; those without both ends are dropped, a missing
    predicate is RELATED_TO and a missing confidence 0.8.
    """
    some = lambda x: F.coalesce(F.length(strip(x)) > 0, F.lit(False))
    body = F.coalesce(_answered(response)["relations"], F.array().cast(_RELATIONS))
    good = F.filter(body, lambda r: some(r["subject"]) & some(r["object"]))
    return F.transform(good, lambda r: F.struct(strip(r["subject"]).alias("subject"), strip(F.coalesce(r["predicate"], F.lit(EDGE_DEFAULTS["predicate"]))).alias("predicate"), strip(r["object"]).alias("object"), F.coalesce(r["confidence"], F.lit(0.8)).alias("confidence")))


def parse_entities(response: Column) -> Column:
    """Entities (name, type, confidence) of a model's answer: the JSON between its first and last brace; bad elements are dropped."""
    body = _answered(response)["entities"]
    good = F.filter(F.coalesce(body, F.array().cast(_ENTITIES)), lambda e: F.coalesce(F.length(strip(e["name"])) > 0, F.lit(False)) & e["type"].isNotNull())
    return F.transform(good, lambda e: F.struct(strip(e["name"]).alias("name"), strip(e["type"]).alias("type"), F.lit(0.8).alias("confidence")))


def chart_graph(charts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (axis labels, legend) and relations (a legend's series to the chart type) of charts (chunk_id, chart_type,
    axis_labels, legend_info), with their part (axes before legend) and place in it.
    """
    axes = charts.select("chunk_id", F.posexplode(F.map_entries("axis_labels")).alias("place", "e")).select("chunk_id", strip(F.col("e.value")).alias("name"), F.lit("CHART_AXIS").alias("type"), F.lit(0.9).alias("confidence"), F.lit(0).alias("part"), "place")
    series = charts.select("chunk_id", "chart_type", F.posexplode("legend_info").alias("place", "label")).select("chunk_id", "chart_type", strip(F.col("label")).alias("name"), "place").filter("name <> ''")
    entities = axes.filter("name <> ''").unionByName(series.select("chunk_id", "name", F.lit("CHART_SERIES").alias("type"), F.lit(0.8).alias("confidence"), F.lit(1).alias("part"), "place"))
    relations = series.filter("chart_type <> ''").select("chunk_id", "place", F.col("name").alias("subject"), F.lit("DISPLAYED_IN").alias("predicate"), F.col("chart_type").alias("object"), F.lit(0.8).alias("confidence"))
    return entities, relations


def image_entities(images: DataFrame) -> DataFrame:
    """Objects found in images (chunk_id, objects_detected), with their place."""
    return images.select("chunk_id", F.posexplode("objects_detected").alias("place", "name")).select("chunk_id", "place", strip(F.col("name")).alias("name"), F.lit("IMAGE_OBJECT").alias("type"), F.lit(0.8).alias("confidence")).filter("name <> ''")

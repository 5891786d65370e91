"""Queries over stored tables: what stands after commits to several tables, merges, and deletions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import upkeep
from ..operators.graph_store import GraphStore
from ..operators.vector_index import VectorIndex
from ..sources.folders import shared_folder, stored
from ..sources.store import Store
from ..sources.tables import load
from . import graph_plans, ingest_plans, retrieval_plans  # noqa: F401  the SQL of m01 is there
from .registry import SQL, query


def _filed(spark: SparkSession, sf_dir: str) -> tuple[Store, int]:
    """A store of files, chunks, vectors, media, nodes and edges, filled in one commit; and that commit."""
    own = {}
    d = load(spark, sf_dir, "documents").select(F.col("source").alias("file_id"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), "doc_id", "lang")
    own["files"], own["chunks"] = d.select("file_id").distinct(), d
    own["vectors"] = load(spark, sf_dir, "embeddings").join(d, F.col("vec_id") == F.col("doc_id")).select("file_id", "vec_id", "embedding")
    own["media"] = load(spark, sf_dir, "pages").select(F.concat(F.lit("c"), F.col("page_id").cast("string")).alias("chunk_id"))
    s, n = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    file = lambda k: F.concat(F.lit("src"), k.cast("string"))
    own["nodes"] = s.select(F.lit("SUPPLIER").alias("label"), F.col("s_name").alias("name"), file(F.col("s_nationkey")).alias("file_id")).union(n.select(F.lit("NATION"), "n_name", F.lit("other")))
    own["edges"] = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("SUPPLIER").alias("src_label"), F.col("s_name").alias("subject"), F.lit("NATION").alias("dst_label"), F.col("n_name").alias("object"), file(F.col("s_nationkey") % 5).alias("file_id"))
    store = Store(spark, shared_folder(spark, "store"), upkeep.FILE_KEYS)
    return store, store.run(lambda t: [t.append(name, df) for name, df in own.items()])


@query("m01_store_delete", SQL["m01_delete_file"])
def m01_store_delete(spark, sf_dir):
    """As m01_delete_file, from stored tables, in one commit."""
    store, _ = _filed(spark, sf_dir)
    store.run(lambda t: upkeep.delete_file(t, "src3"))
    return reduce(DataFrame.union, [store.read(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("store"), "n") for name in upkeep.FILE_KEYS])


@query(
    "s12_versions",
    """SELECT 'before' AS version, source AS file_id, count(*) AS chunks FROM documents GROUP BY source
       UNION ALL SELECT 'after', source, count(*) FROM documents WHERE source <> 'src3' GROUP BY source""",
)
def s12_versions(spark, sf_dir):
    """Chunks per file as they stand after a deletion, and as they stood at the version before it."""
    store, first = _filed(spark, sf_dir)
    store.run(lambda t: upkeep.delete_file(t, "src3"))
    per = lambda name, version: store.read("chunks", version=version).groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks")).select(F.lit(name).alias("version"), "file_id", "chunks")
    return per("before", first).union(per("after", None))


@query("s14_file_scan", "SELECT doc_id, lang, false AS all_opened FROM documents WHERE source = 'src7'")
def s14_file_scan(spark, sf_dir):
    """A file's chunks from a table whose folders each hold the files of some hash: only those that may hold it are opened."""
    store = Store(spark, shared_folder(spark, "store"), upkeep.FILE_KEYS)
    d = load(spark, sf_dir, "documents").select(F.col("source").alias("file_id"), "doc_id", "lang", F.pmod(F.xxhash64("source"), F.lit(8)).cast("int").alias("dealt"))
    store.run(lambda t: t.put("chunks", store.write_folder("chunks", d.repartition("dealt"), "dealt")))
    where = ("file_id", "src7")
    some = len(store.folders("chunks", where)) == len(store.folders("chunks"))
    return store.read("chunks", where).select("doc_id", "lang", F.lit(some).alias("all_opened"))


@query(
    "m02_maintained_counters",
    """SELECT source AS file_id, count(*) AS total, count(*) FILTER (WHERE lang = 'en') AS english, count(*) FILTER (WHERE n_chars > 1000) AS long
       FROM documents WHERE source <> 'src3' AND n_chars >= 100 GROUP BY source""",
)
def m02_maintained_counters(spark, sf_dir):
    """Counters of each file's chunks, kept through appends, the deletion of a file and that of short chunks."""
    store = Store(spark, shared_folder(spark, "store"), upkeep.FILE_KEYS)
    d = load(spark, sf_dir, "documents").select(F.col("source").alias("file_id"), "doc_id", "lang", "n_chars")
    counters = upkeep.Counters(store, "chunks", "file_id", {"english": F.col("lang") == "en", "long": F.col("n_chars") > 1000})
    for some in (F.col("lang") == "en", F.col("lang") == "fr", ~F.coalesce(F.col("lang").isin("en", "fr"), F.lit(False))):
        store.run(lambda t, some=some: t.append("chunks", d.filter(some)))
        counters.refresh()
    store.run(lambda t: t.delete_where("chunks", "file_id", "src3"))
    store.run(lambda t: t.delete("chunks", F.col("n_chars") < 100))
    counters.refresh()
    return counters.read()


@query("k14_stored_nodes", SQL["k11_node_upsert"])
def k14_stored_nodes(spark, sf_dir):
    """As k11_node_upsert, merged into stored nodes file by file."""
    store = Store(spark, shared_folder(spark, "store"))
    graph = GraphStore(store, 16)
    mentions = graph_plans._mentions(spark, sf_dir)
    for f in ("f2", "f1", "f3"):
        store.run(lambda t, f=f: graph.upsert(t, mentions.filter(F.col("file_id") == f)))
    return graph.nodes.read()


def _stored_places(spark: SparkSession, sf_dir: str) -> GraphStore:
    """Suppliers, nations and regions stored in three batches: the nodes, then the relations of each file."""
    store = Store(spark, shared_folder(spark, "store"))
    graph = GraphStore(store, 16)
    nodes, rel = graph_plans._places(spark, sf_dir)
    mentions = nodes.select(F.col("label").alias("type"), "name", "file_id", F.lit(1.0).alias("confidence"), F.lit("text").alias("source_type"), F.lit(1).cast("long").alias("seq"))
    store.run(lambda t: graph.upsert(t, mentions))
    for f in ("f1", "f2"):
        store.run(lambda t, f=f: graph.upsert(t, None, rel.filter(F.col("file_id") == f)))
    return graph


@query("k12_stored_edges", SQL["k12_edge_expand"])
def k12_stored_edges(spark, sf_dir):
    """As k12_edge_expand: relations of later batches find the nodes that earlier ones stored."""
    return _stored_places(spark, sf_dir).edges.read()


@query("j07_stored_paths", SQL["j07_paths"])
def j07_stored_paths(spark, sf_dir):
    """As j07_paths, over packed adjacency lists."""
    from ..operators.graph_store import Adjacency

    lists = Adjacency(graph_plans.places_edges(spark, sf_dir), shared_folder(spark, "adjacency"), 16, 64)
    return lists.trails(spark.createDataFrame([(t,) for t in graph_plans.TERMS], "term string")).select("term", F.col("hops").cast("int").alias("hops"), "key", "nodes")




def _indexed(spark: SparkSession, sf_dir: str) -> tuple[VectorIndex, DataFrame]:
    """The embeddings in an index, the second half inserted after the first; and every id divisible by 20 as a query."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = VectorIndex(Store(spark, shared_folder(spark, "store")))
    late = F.pmod(F.xxhash64("vec_id"), F.lit(2)) == 1
    index.create(v.filter(~late))
    index.insert(v.filter(late))
    return index, v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("r02_index_topk")
def r02_index_topk(spark, sf_dir):
    """The five nearest by codes and a short list; recall is held against the exact search in r02_index_recall."""
    index, queries = _indexed(spark, sf_dir)
    return index.search(queries).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("r02_index_recall", "SELECT count(*) AS queries, 5 * count(*) AS found, true AS recall_reached, true AS few_scored FROM embeddings WHERE vec_id % 20 = 0")
def r02_index_recall(spark, sf_dir):
    """Whether nine tenths of the nearest are found and at most a fifth of all vectors is scored exactly for a query."""
    index, queries = _indexed(spark, sf_dir)
    return recall(index, queries).select("queries", "found", (F.col("recall") >= 0.9).alias("recall_reached"), (F.col("scored") <= 0.2).alias("few_scored"))


def recall(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """One row: queries, rows found, recall, and the share of all vectors that is scored exactly."""
    listed = stored(index.shortlist(queries), "short")
    exact = index.exact(queries, short=listed).select("query_id", "vec_id")
    found = index.search(queries, short=listed).select("query_id", "vec_id", F.lit(1).alias("hit"))
    short = listed.agg(F.count(F.lit(1)).alias("scored"))
    all_ = index.store.read(index.table("vectors")).agg(F.count(F.lit(1)).alias("vectors"))
    both = exact.join(found, ["query_id", "vec_id"], "left").agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("found"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
    return both.crossJoin(short).crossJoin(all_).select("queries", "found", "recall", (F.col("scored") / (F.col("vectors") * F.col("queries"))).alias("scored"))


@query("j08_pruned_query", SQL["j08_multi_query"])
def j08_pruned_query(spark, sf_dir):
    """As j08_multi_query: only vectors whose bound reaches the fifth best are scored."""
    index, queries = _indexed(spark, sf_dir)
    return index.exact(queries).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")

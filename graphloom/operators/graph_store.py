"""The knowledge graph as stored tables: batches merge into what stands, and trails read packed adjacency lists."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.numbering import placed
from ..sources.store import KeyedTable, Store, Transaction
from . import graph

NODE_KEY, EDGE_KEY = ["label", "name"], ["src_label", "subject", "rel_type", "dst_label", "object"]


class GraphStore:
    """Nodes in buckets by name and edges by subject: a batch writes only the buckets again that its names fall in, the last
    write of a key wins, and relations find stored nodes of any earlier batch.
    """

    def __init__(self, store: Store, buckets: int = 64):
        self.store = store
        self.nodes = KeyedTable(store, "nodes", ["name"], lambda df: graph.latest(df, NODE_KEY), buckets)
        self.edges = KeyedTable(store, "edges", ["subject"], lambda df: graph.latest(df, EDGE_KEY), buckets)

    def upsert(self, t: Transaction, mentions: DataFrame | None = None, relations: DataFrame | None = None) -> dict[str, list[int]]:
        """Merges mentions (as of graph.upsert_nodes) and relations (as of graph.upsert_edges); the buckets written of each table."""
        written = {}
        if mentions is not None:
            written["nodes"] = self.nodes.merge(t, graph.upsert_nodes(mentions))
        if relations is not None:
            ends = relations.select(F.col("subject").alias("name")).union(relations.select("object"))
            stored = self.nodes.lookup(t, ends)
            if stored is not None:
                written["edges"] = self.edges.merge(t, graph.upsert_edges(relations, stored))
        return written

    def adjacency(self, buckets: int = 64, slice_size: int = 4096, version: int | None = None) -> Adjacency | None:
        rows = self.edges.read(version)
        if rows is None:
            return None
        key = F.concat_ws("|", *EDGE_KEY)
        return Adjacency(rows.select(key.alias("edge_id"), F.col("subject").alias("src"), F.col("object").alias("dst")), f"{self.store.root}/adjacency-{uuid.uuid4().hex}", buckets, slice_size)


class Adjacency:
    """Each node's edges, both ways, in order of their ids and packed in slices, as a table bucketed by node.

    A hop joins the trails' ends to the lists where these lie: only the trails are shuffled, never the edges. A node of
    very many edges has many rows, dealt before they are packed, so no task gathers them all.
    """

    def __init__(self, edges: DataFrame, path: str, buckets: int = 64, slice_size: int = 4096):
        self.spark, self.name, self.slice_size = edges.sparkSession, f"adjacency_{uuid.uuid4().hex}", slice_size
        steps = edges.select("edge_id", F.col("src").alias("node"), F.col("dst").alias("to")).union(edges.filter("src <> dst").select("edge_id", F.col("dst"), F.col("src")))
        rows = placed(steps, "node", ["edge_id", "to"])
        slices = rows.groupBy("node", F.col("place_of").alias("degree"), F.floor(F.col("place") / slice_size).cast("int").alias("slice")).agg(F.array_sort(F.collect_list(F.struct("edge_id", "to"))).alias("edges"))
        slices.write.bucketBy(buckets, "node").sortBy("node", "slice").option("path", path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def trails(self, starts: DataFrame, most_hops: int = 3, per_term: int = 10) -> DataFrame:
        """As graph.trails, with the same rows.

        Trails rank by hops and then edges in order, so of one trail's continuations only the first per_term can matter,
        and a term that has per_term trails goes no further: a hop reads the first slice of each list, and no more than
        per_term trails of a term go on. An edge of a trail is used once, so its list is read most_hops entries further.
        """
        if per_term + most_hops > self.slice_size:
            raise ValueError("a slice holds fewer edges than a hop may need")
        lists = self.read().filter("slice = 0").select("node", F.slice("edges", 1, per_term + most_hops).alias("edges"))
        now = starts.select("term", F.col("term").alias("end"), F.array().cast("array<string>").alias("path_edges"), F.array("term").alias("path_nodes"))
        rank = W.partitionBy("term").orderBy("hops", "key")
        kept = None
        for hop in range(1, most_hops + 1):
            own = F.slice(F.filter("edges", lambda e: ~F.array_contains("path_edges", e["edge_id"])), 1, per_term)
            now = now.join(lists, now["end"] == lists["node"]).select("term", "path_edges", "path_nodes", F.explode(own).alias("e"))
            now = now.select("term", F.col("e.to").alias("end"), F.concat("path_edges", F.array("e.edge_id")).alias("path_edges"), F.concat("path_nodes", F.array("e.to")).alias("path_nodes"))
            found = now.select("term", F.lit(hop).alias("hops"), F.array_join("path_edges", ">").alias("key"), F.array_join("path_nodes", ">").alias("nodes"))
            kept = found if kept is None else kept.union(found)
            kept = kept.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= per_term).drop("rank")
            if hop < most_hops:
                enough = kept.groupBy("term").count().filter(F.col("count") >= per_term)
                now = now.join(enough, "term", "left_anti")
        return kept

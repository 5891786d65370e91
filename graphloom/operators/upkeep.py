"""Upkeep of stored tables: counters that follow changes, and deletion of a file from every store at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import KeyedTable, Store, Transaction

#: Tables of a file store, and the columns by which their folders can be left closed.
FILE_KEYS = {"files": ["file_id"], "chunks": ["file_id"], "vectors": ["file_id"], "media": ["chunk_id"], "nodes": ["file_id"], "edges": ["file_id"]}


class Counters:
    """Counts of a stored table per key, kept beside it: a refresh reads only the folders that came or went since the last.

    `counts` are conditions by the names of their counters; `total` counts all rows.
    """

    def __init__(self, store: Store, table: str, key: str, counts: dict[str, Column], buckets: int = 16):
        self.store, self.table, self.key, self.counts = store, table, key, counts
        self.kept = KeyedTable(store, f"{table}_counters", [key], self._summed, buckets)
        self.note = f"{table}_counters"

    def _summed(self, rows: DataFrame) -> DataFrame:
        sums = rows.groupBy(self.key).agg(*[F.sum(c).alias(c) for c in ("total", *self.counts)])
        return sums.filter("total <> 0")

    def _counted(self, folders: dict[str, dict], sign: int) -> DataFrame | None:
        rows = self.store.open(folders)
        if rows is None:
            return None
        ones = [F.lit(sign).cast("long").alias("total"), *[(F.coalesce(c.cast("long"), F.lit(0)) * sign).alias(n) for n, c in self.counts.items()]]
        return self._summed_all(rows.select(self.key, *ones))

    def _summed_all(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.key).agg(*[F.sum(c).alias(c) for c in ("total", *self.counts)])

    def refresh(self) -> list[str]:
        """Brings the counters up to what stands; the folders that were read."""
        read: list[str] = []

        def change(t: Transaction) -> None:
            came, went = self.store.changes(self.table, t.reached_by(self.note), t.base)
            read[:] = [*came, *went]
            parts = [x for x in (self._counted(came, 1), self._counted(went, -1)) if x is not None]
            if parts:
                self.kept.merge(t, self._summed_all(parts[0].unionByName(parts[1])) if len(parts) > 1 else parts[0])
            t.reached(self.note, t.base.version)

        self.store.run(change)
        return read

    def read(self) -> DataFrame | None:
        return self.kept.read()


def delete_file(t: Transaction, file_id: str) -> dict[str, int]:
    """Removes a file from catalog, chunks, vectors, media of its chunks, nodes with their edges, and edges; how many folders of each were opened.

    All of it becomes visible with the transaction's commit, or nothing does.
    """
    opened = {}
    own, nodes = t.read("chunks", ("file_id", file_id)), t.read("nodes", ("file_id", file_id))
    if own is not None:
        opened["media"] = t.delete_keys("media", (own, ["chunk_id"]))
    ends = []
    if nodes is not None:
        ends = [(nodes.select(F.col("label").alias(label), F.col("name").alias(name)), [label, name]) for label, name in (("src_label", "subject"), ("dst_label", "object"))]
    opened["edges"] = t.delete_keys("edges", *ends, condition=F.col("file_id") == file_id) if ends else t.delete_where("edges", "file_id", file_id)
    for table in ("files", "chunks", "vectors", "nodes"):
        opened[table] = t.delete_where(table, "file_id", file_id)
    return opened

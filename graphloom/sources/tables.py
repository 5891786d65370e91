"""Input tables, and snapshots in place of upserts and deletes, which Parquet folders do not have."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import data_uri
from .store import Store

# The default rows of the settings table.
SETTINGS = [("max_file_size_mb", "100", "number"), ("allowed_file_types", '["pdf"]', "json"), ("chunk_size", "1000", "number"), ("chunk_overlap", "200", "number"), ("vector_similarity_threshold", "0.7", "number"), ("max_search_results", "10", "number"), ("session_timeout_hours", "24", "number")]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SETTINGS, "config_key string, config_value string, config_type string")


def missing_tables(spark: SparkSession, required: list[str]) -> list[str]:
    """Which of the required tables or views the session does not know."""
    return [t for t in required if not spark.catalog.tableExists(t)]


def sql(spark: SparkSession, query: str, args: dict | list | None = None, **views: DataFrame) -> DataFrame:
    """A query with bound parameters over the named frames."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query, args=args) if args else spark.sql(query)


def run_script(spark: SparkSession, script: str) -> int:
    """Runs the statements of a script, which semicolons outside quotes and comments end; how many there were."""
    statements, now, at = [], [], 0
    for m in re.finditer(r"'(?:[^'\\]|\\.)*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|;", script):
        now.append(script[at : m.start()])
        at = m.end()
        if m[0] == ";":
            statements.append("".join(now))
            now = []
        elif not m[0].startswith("--"):
            now.append(m[0])
    statements = [s for s in [*statements, "".join([*now, script[at:]])] if s.strip()]
    for s in statements:
        spark.sql(s)
    return len(statements)


def environment(spark: SparkSession, tables: list[str], folders: list[str], modules: list[str]) -> DataFrame:
    """A row (check, name, ok, advice) per thing that a deployment needs: tables of the session, folders that Spark reaches, Python modules."""
    from importlib.util import find_spec

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    rows = [("table", t, spark.catalog.tableExists(t), f"create the table {t}") for t in tables]
    rows += [("folder", f, path(f).getFileSystem(conf).exists(path(f)), f"make the folder {f}") for f in folders]
    rows += [("module", m, find_spec(m) is not None, f"install {m}") for m in modules]
    return spark.createDataFrame([(c, n, ok, None if ok else advice) for c, n, ok, advice in rows], "check string, name string, ok boolean, advice string")


class Snapshots:
    """A table of its own with versions: an append adds a folder without touching the others, a delete writes only the folders
    again that have such rows, and writers at the same time lose nothing (see Store).
    """

    TABLE = "rows"

    def __init__(self, spark: SparkSession, root: str, keys: list[str] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = Store(spark, root, {self.TABLE: keys or []}, "_manifests")

    def versions(self) -> list[int]:
        return self.store.numbers()

    def folders(self, where: tuple[str, object] | None = None) -> list[str]:
        """The folders that are read; where (column, value) is given, those that may have such rows."""
        return self.store.folders(self.TABLE, where)

    def read(self, where: tuple[str, object] | None = None) -> DataFrame | None:
        return self.store.read(self.TABLE, where)

    def _run(self, change) -> DataFrame | None:
        self.store.run(change)
        return self.read()

    def write(self, df: DataFrame) -> DataFrame:
        return self._run(lambda t: t.overwrite(self.TABLE, df))

    def append(self, df: DataFrame) -> DataFrame:
        entries = self.store.write_folder(self.TABLE, df)
        return self._run(lambda t: t.put(self.TABLE, entries))

    def delete(self, condition: Column, where: tuple[str, object] | None = None) -> DataFrame | None:
        """Without the rows that meet the condition, for which `where` must hold, if it is given."""
        return self._run(lambda t: t.delete(self.TABLE, condition, where))


class VectorTable(Snapshots):
    """Vectors with file_id, chunk_id, content, metadata and embedding; all embeddings have one dimension. Vectors of another
    dimension than the table's are no use beside its rows: their first insert takes the place of what stood.
    """

    def __init__(self, spark: SparkSession, root: str, dim: int):
        super().__init__(spark, root, ["file_id"])
        self.dim = dim

    def insert(self, rows: DataFrame) -> DataFrame:
        entries = self.store.write_folder(self.TABLE, assert_embeddings(rows, self.dim))

        def change(t) -> None:
            stands = t.noted("dimension")
            if stands != self.dim:
                t.note("dimension", self.dim)
            t.put(self.TABLE, entries, t.folders(self.TABLE) if stands not in (None, self.dim) else ())

        return self._run(change)

    def of_file(self, file_id: str) -> DataFrame | None:
        """The rows of a file: only folders that may have any are opened, and the filter reaches the scan."""
        return self.read(("file_id", file_id))

    def delete_file(self, file_id: str) -> DataFrame | None:
        return self.delete(F.col("file_id") == file_id, ("file_id", file_id))

    def has_data(self) -> bool:
        now = self.read()
        return now is not None and not now.isEmpty()


def assert_embeddings(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Fails, when it runs, on a vector of another dimension or a missing one."""
    wrong = F.coalesce(F.size(column) != dim, F.lit(True))
    return df.withColumn(column, F.when(wrong, F.raise_error(F.lit(f"an embedding is missing or not of dimension {dim}"))).otherwise(F.col(column)))


def with_media(chunks: DataFrame, media: DataFrame) -> DataFrame:
    """chunks with the payload of their image or chart as a data URI, and whether it was found; media (chunk_id, extension, bytes)."""
    own = media.select("chunk_id", data_uri(F.col("bytes"), F.col("extension")).alias("data_uri"))
    return chunks.join(own, "chunk_id", "left").withColumn("media_status", F.when(F.col("data_uri").isNotNull(), F.lit("loaded")).otherwise(F.lit("failed")))


def with_tables(chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """chunks (chunk_id, content, metadata as JSON) with their table (chunk_id, table_data): data, summary, rows beside the
    header, columns, types and insights from the metadata, and whether it was found.
    """
    t = F.col("table_data")
    out = chunks.join(tables.select("chunk_id", "table_data"), "chunk_id", "left")
    listed = lambda k: F.coalesce(F.from_json(F.get_json_object("metadata", f"$.{k}"), "array<string>"), F.array().cast("array<string>")).alias(k)
    return out.select(
        *chunks.columns, "table_data", F.col("content").alias("table_summary"), F.when(F.size(t) > 1, F.size(t) - 1).otherwise(F.lit(0)).alias("rows"),
        F.when(F.size(t) > 0, F.size(F.element_at(t, 1))).otherwise(F.lit(0)).alias("columns"), listed("data_types"), listed("key_insights"),
        F.when(F.size(t) > 0, F.lit("loaded")).otherwise(F.lit("failed")).alias("status"),
    )


#: What an answer shows of the metadata of a picture and of a chart.
IMAGE_METADATA = "width int, height int, format string, objects_detected array<string>, text_content string"
CHART_METADATA = "chart_type string, data_points array<double>, trend_analysis string, statistical_summary map<string,string>, axis_labels map<string,string>, legend_info array<string>"


def media_metadata(metadata: Column, fields: str) -> Column:
    """The named fields of a medium's metadata, which is JSON."""
    return F.from_json(metadata, fields)


def write_media(chunks: DataFrame, path: str) -> None:
    """Pictures of chunks (chunk_id, media_bytes, media_format) as a table beside the others; chunks without one are left out."""
    chunks.filter("media_bytes IS NOT NULL").select("chunk_id", F.col("media_format").alias("extension"), F.col("media_bytes").alias("bytes")).write.mode("append").parquet(path)


def write_table_csv(tables: DataFrame, path: str) -> None:
    """One CSV record per row of cells: chunk id, row number, cells; missing cells are empty."""
    rows = tables.select("chunk_id", F.posexplode("table_data").alias("row", "cells"))
    rows.select("chunk_id", "row", F.to_json(F.transform("cells", lambda c: F.coalesce(c, F.lit("")))).alias("cells")).write.mode("overwrite").csv(path, quote='"', escape='"')


def read_table_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, schema="chunk_id string, row int, cells string", quote='"', escape='"')
    cells = rows.select("chunk_id", F.struct("row", F.from_json("cells", "array<string>").alias("cells")).alias("r"))
    return cells.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["cells"]).alias("table_data"))

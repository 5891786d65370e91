"""Shared plumbing of the training-data operators: inputs, shared scratch tables, bounded broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that ends a word: space and tab to carriage return.
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACE_CLASS = r"[\x20\x09-\x0D]+"

#: A table may be broadcast if it has been counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 50_000


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """`documents` with only the columns that the operator needs, so the scan prunes the rest."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


_own_root: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of this session's own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        local = spark.sparkContext.master.split("[")[0] == "local"
        _own_root[app] = "file://" + tempfile.mkdtemp(prefix="graphloom-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return _own_root[app]


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor costs no recomputation.

    A table is deleted by drop(), or when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark).rstrip('/')}/graphloom-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, name: str) -> None:
        self._delete(self.path(name))

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the JVM may have ended first
            pass

    def _delete(self, where: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def attach(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", salts: int = 16, small_rows: int | None = None) -> DataFrame:
    """big joined to small on keys, nulls equal; small must have been written, as it is counted, unless its rows are known.

    Up to BROADCAST_ROWS rows small is broadcast. Beyond, its rows are copied once per salt and big is salted,
    so a key with a third of all rows is dealt to several tasks. The copies must then be merged: Spark goes by the size of
    small's files, which does not count them, and would broadcast millions of rows.
    """
    left = big
    right = small.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = [left[k].eqNullSafe(right[f"__{k}"]) for k in keys]
    if (small.limit(BROADCAST_ROWS + 1).count() if small_rows is None else small_rows) <= BROADCAST_ROWS:
        right = F.broadcast(right)
    else:
        left = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
        right = right.withColumn("__salt2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).hint("merge")
        on = [left[k].eqNullSafe(right[f"__{k}"]) for k in keys] + [left["__salt"] == right["__salt2"]]
    return left.join(right, on, how).drop("__salt", "__salt2", *[f"__{k}" for k in keys])


#: A key is hot if it holds more than one row in HOT_KEYS of all, so fewer keys than that are, and more than LEAST_HOT rows.
HOT_KEYS, LEAST_HOT = 1000, 1000


def attach_counted(big: DataFrame, small: DataFrame, key: str, count: str) -> DataFrame:
    """big inner-joined to small on key, where small has been written and has one row per key, and in `count` the rows that
    big has of it; that column is dropped.

    Hot keys, fewer than HOT_KEYS whatever the data, are broadcast, and their rows in big stay where they are. Only the
    other keys are shuffled, so no task gets more of a key than that share of all rows.
    """
    total = small.agg(F.sum(count)).first()[0] or 0
    edge = max(total // HOT_KEYS, LEAST_HOT)
    hot, cold = small.filter(F.col(count) > edge).drop(count), small.filter(F.col(count) <= edge).drop(count)
    if total <= edge or hot.isEmpty():
        return big.join(cold, key)
    near = big.join(F.broadcast(hot), key)
    return near.unionByName(big.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def dealt_by_bucket(df: DataFrame, parts: int) -> DataFrame:
    """df dealt over `parts` tasks by its column `bucket`, bucket after bucket in turn, and not by a hash of what is dealt already."""
    return df.withColumn("part", F.pmod("bucket", F.lit(parts)).cast("int")).repartitionById(parts, "part")


def by_bucket(df: DataFrame, parts: int):
    """df grouped by bucket, for a cogroup with another that is dealt alike: neither is shuffled again."""
    return dealt_by_bucket(df, parts).groupBy("part", "bucket")


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of an Arrow batch as UTF-8 bytes; null counts as empty."""
    return [t or b"" for t in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def pieces(sizes: list[int], most: int):
    """Row ranges (from, to) of about `most` bytes each, one row at least, so memory stays bounded by a row or `most`."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


def text_runs(batch: pa.RecordBatch, column: str, most: int):
    """(from, to, texts) of about `most` bytes each; null counts as empty. Only one run's texts are Python strings at a time."""
    col = batch.column(batch.schema.get_field_index(column))
    for a, b in pieces(pc.fill_null(pc.binary_length(col), 0).to_pylist(), most):
        yield a, b, [t or "" for t in col.slice(a, b - a).to_pylist()]


def with_columns(batch: pa.RecordBatch, keep: list[str], **new: pa.Array) -> pa.RecordBatch:
    cols = {c: batch.column(batch.schema.get_field_index(c)) for c in keep} | new
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns renamed c0, c1, ... by their places, so that an operator's own columns can clash with none, and
    the new names by the old; `back.toDF(*docs.columns)` gives the old ones again.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def hidden(docs: DataFrame, **needed: str) -> DataFrame:
    """Only the needed columns, renamed to the operator's own names; other columns cannot clash."""
    return docs.select(*[docs[src].alias(name) for name, src in needed.items()])

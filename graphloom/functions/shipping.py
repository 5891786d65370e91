"""Makes this package importable on executors, wherever the driver got it from."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from weakref import WeakSet

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: WeakSet = WeakSet()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the workers, once per context, as a zip file of a few KB."""
    sc = spark.sparkContext
    if sc in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.dirname(top)
    target = os.path.join(tempfile.mkdtemp(prefix="graphloom-src-"), "graphloom_src.zip")
    if os.path.isdir(top):
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(top):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, base))
        sc.addPyFile(target)
    _shipped.add(sc)


#: Bytes of an Arrow batch, at most: rows here are whole documents, and the default of 64 MB takes several times that in
#: the JVM's and the worker's memory.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ships the package, and bounds Arrow batches where the session allows larger ones."""
    ship(spark)
    now = (spark.conf.get(_BATCH_CONF, None) or "").rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, f"{BATCH_BYTES}b")


def _release() -> None:
    """Gives freed memory back: a worker is used again by later stages, beside which it would otherwise keep its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow, prepared; the worker's freed memory is given back at the end of a task."""
    prepare(df.sparkSession)

    def whole(batches):
        yield from run(batches)
        _release()

    return df.mapInArrow(whole, schema)

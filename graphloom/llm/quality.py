"""Quality classifier: sizes under zstandard dictionaries of good and of bad text, as a calibrated score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import map_arrow
from . import common
from .calibration import Curve

#: A text is compressed in blocks of this many bytes, each on its own, so that a long text is still judged by the
#: dictionaries and not by its own beginning.
BLOCK = 2048
DICT_BYTES, LEVEL = 64 * 1024, 3
#: The model is fitted on at most so many labelled rows per label, those of least hash, whole; on fewer where their texts
#: have more bytes.
FIT_ROWS, FIT_BYTES = 2500, 16 << 20
#: From this score on a document is predicted good.
THRESHOLD = 0.7
#: Bytes that each size has to begin with, so that those of very short texts do not jump.
PRIOR_BYTES = 8.0


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


class Model:
    """Two dictionaries, and a logistic curve over the normalised size difference.

    The same difference says less of a short text, and nothing of one that repeats itself, which any dictionary makes
    small: so the curve may bend with the text's length and with its size for its length.
    """

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = good, bad
        self.curve: Curve | None = None
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _compressors(self):
        if self._ready is None:
            self._ready = [zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (self.good, self.bad)]
        return self._ready

    def features(self, text: bytes) -> list[float]:
        good, bad = self._compressors()
        g = b = PRIOR_BYTES / 2
        for block in blocks(text):
            g += len(good.compress(block))
            b += len(bad.compress(block))
        difference, length = 2 * (b - g) / (g + b), float(np.log(len(text) + PRIOR_BYTES))
        rate = float(np.log((g + b) / 2 / (len(text) + PRIOR_BYTES)))
        return [difference, rate, rate * rate, length, difference * length, difference * rate]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.curve = Curve(x, y)

    def score(self, text: bytes) -> float:
        return self.curve(self.features(text))


def _train(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; of a few small samples, the samples themselves."""
    try:
        return zstd.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(id, t, y, key) of about twice `rows` rows per label 0 and 1 at most, by hash of the id; and all rows per label.

    The sample is of labels, counted, and so small that it goes to the documents: no text is shuffled. A null label, id
    or text is left out; an id that is labelled twice counts each time.
    """
    own = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"), F.xxhash64("doc_id", F.lit(11)).alias("key")).filter("id is not null and y in (0, 1)")
    sizes = {r[0]: r[1] for r in own.groupBy("y").count().collect()}
    rate = F.when(F.col("y") == 1, F.lit(min(1.0, 2 * rows / max(1, sizes.get(1, 0))))).otherwise(F.lit(min(1.0, 2 * rows / max(1, sizes.get(0, 0)))))
    some = common.Scratch(docs.sparkSession).write(own.filter(F.pmod(F.col("key"), F.lit(1 << 20)) < rate * (1 << 20)), "labelled")
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")).filter("t is not null")
    return common.attach(texts, some, ["id"], "inner"), sizes


def chosen(sample: DataFrame, rows: int, most_bytes: int) -> dict[int, list[int]]:
    """Per label the keys of the sampled rows (t, y, key) that a model is fitted on, in order: those of least key, at most
    `rows`, and as long as their texts add up to at most most_bytes (the first in any case).
    """
    found = sorted(tuple(r) for r in sample.select("y", "key", F.octet_length("t")).collect())
    out: dict[int, list[int]] = {0: [], 1: []}
    held = [0, 0]
    for y, key, size in found:
        if len(out[y]) < rows and (not out[y] or held[y] + size <= most_bytes):
            out[y].append(key)
            held[y] += size
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Model | None:
    """Learns from docs (doc_id, text) and labels (doc_id, label); None if one of the labels has no row with a text.

    Two thirds of the sampled rows make the dictionaries, the last third the calibration, where each counts as its label's
    share of all labelled rows is, so the score is a probability on whole data. All are read whole. Null and empty texts
    and null labels teach nothing; a row that is there, or labelled, several times counts as often; rows of equal hash
    are taken in the order of their texts' lengths.
    """
    sample, share = labelled(docs, labels, label, fit_rows)
    own = common.Scratch(docs.sparkSession).write(sample.filter("length(t) > 0").select("t", "y", "key"), "sample")
    by = chosen(own, fit_rows, fit_bytes)
    if not by[0] or not by[1]:
        return None
    cut = {y: sorted(x for i, x in enumerate(keys) if i % 3 != 2) for y, keys in by.items()}
    held = {y: [x for i, x in enumerate(keys) if i % 3 == 2] or keys for y, keys in by.items()}
    # Rows of the rarer label in full, of the other in the share it has.
    want = {y: max(1, min(len(held[y]), round(min(len(held[v]) / share[v] for v in (0, 1)) * share[y]))) for y in (0, 1)}
    model = Model(*(_train([b for t in _texts(own, y, cut[y]) for b in blocks(t)]) for y in (1, 0)))
    known = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in common.text_runs(batch, "t", 1 << 20):
                yield common.with_columns(batch.slice(a, b - a), ["y", "key"], x=pa.array([known.value.features(t.encode()) for t in texts], pa.list_(pa.float64())))

    calibration = [r for y in (0, 1) for r in map_arrow(_rows(own, y, held[y][: want[y]]), measure, "y int, key long, x array<double>").collect()]
    calibration.sort(key=lambda r: (r.y, r.key, r.x))
    model.calibrate(np.array([r.x for r in calibration]), np.array([r.y for r in calibration], float))
    return model


def _rows(sample: DataFrame, y: int, keys: list[int]) -> DataFrame:
    """The rows of a label that have one of the keys, which are few."""
    few = sample.sparkSession.createDataFrame([(k,) for k in sorted(set(keys))], "key long")
    return sample.filter(F.col("y") == y).join(F.broadcast(few), "key", "left_semi").select("t", "y", "key")


def _texts(sample: DataFrame, y: int, keys: list[int]) -> list[bytes]:
    return [r.t.encode() for r in sorted(_rows(sample, y, keys).collect(), key=lambda r: (r.key, r.t))]


def score(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted; columns of docs with these names give way.

    Whole texts are read, block by block. Null and empty texts get the score of no difference at no length. Rows that
    repeat a text get its score each; a score of just the threshold is predicted good. Without a model every score is
    0.5. An empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    src = docs.select(*keep)
    schema = T.StructType([*src.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            out = [own.score(t.encode()) if own else 0.5 for _, _, texts in common.text_runs(batch, text, 1 << 20) for t in texts]
            yield common.with_columns(batch, keep, score=pa.array(out, pa.float64()), predicted=pa.array([int(s >= threshold) for s in out], pa.int32()))

    return map_arrow(src, run, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    fold = common.fold(F.col("doc_id"), 4)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold != 2)
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (fold == 2).alias("held_out"), "score", "predicted")

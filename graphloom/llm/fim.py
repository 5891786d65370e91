"""Fill-in-middle transformation by an index of distinct texts.

Documents are dealt by the SHA-256 of their text and grouped by the text itself. Each distinct text gets one entry of the
index: where its code points begin, as an Elias-Fano list. The entries are joined back to the documents, and each document
selects the two places of its own cut.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import map_arrow, prepare
from . import common
from .token_store import EliasFano

SEED = 1
#: Of a hundred documents so many are transformed, and of a hundred of these so many put the suffix first.
RATE, SPM_RATE = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text that a task is sized for.
TASK_BYTES = 64 << 20
#: Bytes of a text whose boundaries are packed at once.
PIECE = 1 << 20

#: boundaries, bits of a low part, bytes of the low parts
_HEAD = struct.Struct("<QBQ")


def boundaries(text: bytes) -> bytes:
    """Byte offsets of the code points of a text, and its length, as an Elias-Fano list; made piece by piece."""
    data = np.frombuffer(text, np.uint8)
    begins = lambda i: np.flatnonzero((data[i : i + PIECE] & 0xC0) != 0x80) + i
    pieces = range(0, len(data), PIECE)
    n = sum(int(((data[i : i + PIECE] & 0xC0) != 0x80).sum()) for i in pieces) + 1
    bits = max(0, (len(data) // n).bit_length() - 1)
    high, low = np.zeros(((len(data) >> bits) + n) // 8 + 1, np.uint8), np.zeros((n * bits + 7) // 8, np.uint8)

    def put(into: np.ndarray, places: np.ndarray) -> None:
        if len(places):
            first = int(places[0]) // 8
            some = np.zeros((int(places[-1]) // 8 + 1 - first) * 8, np.uint8)
            some[places - first * 8] = 1
            own = np.packbits(some, bitorder="little")
            into[first : first + len(own)] |= own

    at = 0
    for own in [*map(begins, pieces), np.array([len(data)])]:
        place = np.arange(at, at + len(own))
        put(high, (own >> bits) + place)
        for b in range(bits):
            put(low, place[(own >> b) & 1 == 1] * bits + b)
        at += len(own)
    return _HEAD.pack(n, bits, len(low)) + low.tobytes() + high.tobytes()


def opened(entry: bytes) -> EliasFano:
    n, bits, low = _HEAD.unpack_from(entry)
    at = _HEAD.size
    return EliasFano(n, bits, entry[at : at + low], entry[at + low :])


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """Four numbers of 32 bits from the SHA-256 of the seed and the id; a null id counts as the empty text."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def cut(text: bytes, starts: EliasFano, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, bytes]:
    """(code points, form, those of the prefix and of the middle, output); a plain text's parts have no size."""
    n = starts.n - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not n or h3 % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = int(starts.select(one)[0]), int(starts.select(two)[0])
    p, s, m = marks
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", one, two - one, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", one, two - one, b"".join((p, prefix, s, suffix, m, middle))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def _entries(text: pa.Array) -> pa.Array:
    return pa.array([boundaries(t) for t in text.cast(pa.binary()).to_pylist()], pa.binary())


def dealt(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the SHA-256 of the text as its name and a block, and dealt by both: rows of one text meet.

    A text of more than one row in HOT_KEYS of all, and more than LEAST_HOT, is dealt over blocks of about so many rows by
    a hash of the id; such texts are fewer than HOT_KEYS whatever the data, so the table of them is broadcast.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    edge = max(n // common.HOT_KEYS, common.LEAST_HOT)
    hot = common.Scratch(spark).write(rows.groupBy(F.xxhash64("text").alias("key")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > edge), "hot")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // TASK_BYTES))
    block = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.ceil(F.col("n") / edge)))
    held = rows.join(F.broadcast(hot), F.xxhash64("text") == F.col("key"), "left")
    # Neither name nor block is ever null; said so, the join needs no filter that would hash each text again.
    name = F.coalesce(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), F.lit(b""))
    return held.select("doc_id", "text", name.alias("name"), F.coalesce(block, F.lit(0)).cast("int").alias("block")).repartition(parts, "name", "block")


def text_index(rows: DataFrame) -> DataFrame:
    """One entry per distinct text (and block of a hot one) of dealt rows: name, block, first (its least id), boundaries.

    Rows are grouped by the text itself, where they lie.
    """
    groups = rows.groupBy("name", "block", "text").agg(F.min("doc_id").alias("first"))
    return groups.select("name", "block", "first", F.arrow_udf(_entries, T.BinaryType())("text").alias("boundaries"))


_RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Per row: doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    Null texts are empty, and an empty text is plain, as is one that holds a mark. A null id draws as the empty text does;
    rows of one id and text are cut alike. An empty table gives no rows; other columns are not carried, so none can clash.
    """
    prepare(docs.sparkSession)
    rows = dealt(common.hidden(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")))
    # Texts are shuffled once: both sides read one exchange, as both need all its columns.
    joined = rows.join(text_index(rows), ["name", "block"]).select("doc_id", "text", "first", "boundaries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, starts = None, None
        for batch in batches:
            ids, entries = batch.column(0), batch.column(3)
            for a, b in common.pieces([len(x) for x in entries.to_pylist()], 1 << 20):
                own = []
                for d, t, e in zip(ids.slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).cast(pa.binary()).to_pylist(), entries.slice(a, b - a).to_pylist(), strict=True):
                    if e != known:
                        known, starts = e, opened(e)
                    own.append((d, *cut(t, starts, d, seed, rate, spm_rate)))
                d, n, form, prefix, middle, out = zip(*own, strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(d, pa.int64()), "n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()), "prefix_chars": pa.array(prefix, pa.int64()), "middle_chars": pa.array(middle, pa.int64()), "output": pa.array(out, pa.binary()).cast(pa.string())})

    return map_arrow(joined, run, _RESULT)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(common.documents(spark, sf_dir, "doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4
  FROM d),
c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (SELECT *, '<P>' || substr(t, 1, a) AS prefix, '<M>' || substr(t, a + 1, b - a) AS middle, '<S>' || substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN suffix || prefix || middle ELSE prefix || suffix || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

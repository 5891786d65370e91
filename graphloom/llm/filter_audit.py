"""How filters interact: what each removes after which others, over all orders, from packed bitmaps.

A task packs its documents into bitmaps: one per filter, one per label, and for each part a run of whole words in all of
them. AND-NOT with the union of a set of filters that came before, and a count of bits, gives what a filter removes after
that set; a set's order does not matter, so 16 sets for each of five filters make up all 120 orders. Counts of tasks are summed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import map_arrow
from . import common

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, SYMBOLS = 50, 65, 5, b"#$%&*|"
COPY, GOOD, TOXIC = 4, 5, 6
#: Documents whose bits are held at once, and parts whose bitmaps are.
CHUNK, PARTS = 1 << 20, 500

_UPPER, _INNER = bytes(range(65, 91)), bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    n = len(words)
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _INNER))
    bad = (n < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * n, 100 * upper > MOST_UPPER * points, len(text.translate(None, SYMBOLS)) < len(text))
    return sum(1 << i for i, b in enumerate(bad) if b)


def verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Per row: doc_id, part, bits (one per filter that the document fails).

    A null text is empty, a null part the empty string. A document fails E if its text is that of a smaller id, by length
    and SHA-256; a null id has no order, and neither fails E nor makes others fail it.
    """
    scratch = common.Scratch(docs.sparkSession)
    own = common.hidden(docs, doc_id=doc_id, text=text, part=part).select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.texts_of(batch)
            keys = [hashlib.sha256(t).digest() + len(t).to_bytes(6, "little") for t in texts]
            yield common.with_columns(batch, ["doc_id", "part"], bits=pa.array([failures(t) for t in texts], pa.int32()), key=pa.array(keys, pa.binary()))

    rows = scratch.write(map_arrow(own, run, "doc_id long, part string, bits int, key binary"), "rows")
    firsts = scratch.write(rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "firsts")
    again = F.coalesce((F.col("doc_id") > F.col("least")).cast("int"), F.lit(0))
    return common.attach_counted(rows, firsts, "key", "n").select("doc_id", "part", F.col("bits").bitwiseOR(again * (1 << COPY)).alias("bits"))


def bitmaps(part: np.ndarray, parts: int, bits: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns + 1, words): a bitmap per bit of `bits`, and one of what is there at all; and where each part's words begin.

    Rows stand in order of their part. A part has whole words of its own, so its counts are sums over these.
    """
    size = np.bincount(part, minlength=parts)
    begin = np.concatenate(([0], np.cumsum(-(-size // 64))))
    place = np.arange(len(part)) + np.repeat(begin[:-1] * 64 - (np.cumsum(size) - size), size)
    out = np.zeros((columns + 1, begin[-1] * 64), np.uint8)
    for k in range(columns):
        out[k, place] = bits >> k & 1
    out[columns, place] = 1
    return np.packbits(out, axis=1, bitorder="little").view("<u8"), begin[:-1]


#: (filters before as bits, filter) in the order in which counts are made
STEPS = [(s, f) for f in range(len(FILTERS)) for s in range(1 << len(FILTERS)) if not s >> f & 1]


def counts(maps: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(parts, steps, 5): kept, removed, redundant, good and toxic removed, of each part and step."""
    fails, good, toxic, there = maps[: len(FILTERS)], maps[GOOD], maps[TOXIC], maps[-1]
    union = [np.zeros_like(there)]
    for s in range(1, 1 << len(FILTERS)):
        f = s.bit_length() - 1
        union.append(union[s ^ 1 << f] | fails[f])
    per_part = lambda x: np.add.reduceat(np.bitwise_count(x), begin, dtype=np.int64)
    out = np.empty((len(begin), len(STEPS), 5), np.int64)
    for i, (s, f) in enumerate(STEPS):
        gone = fails[f] & ~union[s]
        for k, x in enumerate((there & ~union[s | 1 << f], gone, fails[f] & union[s], gone & good, gone & toxic)):
            out[:, i, k] = per_part(x)
    return out


COUNTED = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
_COUNTS = "part string, before int, filter int, " + ", ".join(f"{c} long" for c in COUNTED)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    before, own = np.array([s for s, _ in STEPS], np.int32), np.array([f for _, f in STEPS], np.int32)

    def out() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        named = table.column("part").combine_chunks().dictionary_encode()
        part, bits = named.indices.to_numpy(), table.column("bits").to_numpy()
        order = np.argsort(part, kind="stable")
        part, bits = part[order], bits[order]
        # Some parts at a time, as each takes whole words: there may be as many as documents.
        for i in range(0, len(named.dictionary), PARTS):
            a, b = np.searchsorted(part, (i, i + PARTS))
            n = min(PARTS, len(named.dictionary) - i)
            found = counts(*bitmaps(part[a:b] - i, n, bits[a:b], TOXIC + 1))
            columns = {"part": named.dictionary.take(pa.array(np.repeat(np.arange(i, i + n), len(STEPS)))), "before": pa.array(np.tile(before, n)), "filter": pa.array(np.tile(own, n))}
            yield pa.RecordBatch.from_pydict(columns | {c: pa.array(found[:, :, k].ravel()) for k, c in enumerate(COUNTED)})

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield from out()
            held = []
    if held:
        yield from out()


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Odd input as in `verdicts`. A document is good, or toxic, if any of its rows of labels says so; null labels and null
    ids of labels say nothing. Rows that repeat count each; parts without documents, and empty tables, give no rows.
    """
    scratch = common.Scratch(docs.sparkSession)
    said = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    marked = scratch.write(labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality").alias("good"), said("toxic").alias("bad")), "labels")
    rows = common.attach(verdicts(docs, doc_id, text, part), marked, ["doc_id"])
    label = lambda c, bit: F.coalesce(F.col(c), F.lit(0)) * (1 << bit)
    rows = rows.select("part", F.col("bits").bitwiseOR(label("good", GOOD)).bitwiseOR(label("bad", TOXIC)).alias("bits"))
    per_step = map_arrow(rows, _count_batches, _COUNTS).groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in COUNTED])
    # Of a part and filter 16 sets stand before it; each comes first in so many orders.
    n = len(FILTERS)
    orders_of = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("before") + 1)
    all_others = F.expr(f"before | shiftleft(1, filter) = {(1 << n) - 1}")
    sets = per_step.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * orders_of).alias("shapley"), F.max(F.when(all_others, F.col("removed"))).alias("unique_fails"),
        F.map_from_entries(F.collect_list(F.struct("before", F.struct(*COUNTED)))).alias("counted"),
    )
    steps = [("".join(o), i + 1, sum(1 << FILTERS.index(x) for x in o[:i]), FILTERS.index(o[i])) for o in permutations(FILTERS) for i in range(n)]
    orders = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, filter int")
    here = F.element_at("counted", F.col("before"))
    out = sets.join(F.broadcast(orders), "filter").withColumn("here", here)
    return out.select("part", "filter_order", "step", *[F.col(f"here.{c}").alias(c) for c in COUNTED], "unique_fails", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text", "source")
    return audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
b AS (
  SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS bits
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, bits, good, toxic, count(*) AS n FROM b GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT f1.x || f2.x || f3.x || f4.x || f5.x AS filter_order, [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] AS own
  FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.bit + f2.bit + f3.bit + f4.bit + f5.bit = 31 AND len(list_distinct([f1.bit, f2.bit, f3.bit, f4.bit, f5.bit])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, own[step] AS bit, CAST(coalesce(list_sum(own[1 : step - 1]), 0) AS INTEGER) AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN bits & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN bits & bit > 0 AND bits & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN bits & bit > 0 AND bits & before > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN bits = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN bits & bit > 0 AND bits & before = 0 AND good = 1 THEN n ELSE 0 END) AS good_lost,
         sum(CASE WHEN bits & bit > 0 AND bits & before = 0 AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""

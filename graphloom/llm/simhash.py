"""SimHash near-duplicates: exact fingerprints, bit-sliced distances, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import map_arrow
from . import common

BITS, SHINGLE, RADIUS, SEED = 64, 3, 3, 42
#: The bits are cut into BANDS bands; fingerprints within RADIUS agree on BANDS - RADIUS whole bands at least.
BANDS = 5
#: Fingerprints that one comparison holds at once; a larger bucket is compared block by block, in several tasks.
BLOCK = 2048
#: Shingles whose hashes are held at once.
HASHES = 1 << 16

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WEIGHTS = 1 << np.arange(BITS, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE, digest=xxhash.xxh64_intdigest) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes; a text without words has 0."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    # A shingle is a stretch of the joined text: from the start of its first word to the end of its last.
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[len(words) - n :].tolist()
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, HASHES):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + HASHES], ends[i : i + HASHES], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_WEIGHTS[counts * 2 > n].sum())


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs without its text, with fp, the fingerprint as a signed long. Nulls and blank texts have fingerprint 0."""
    keep = [c for c in docs.columns if c not in (text, "fp")]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in common.texts_of(batch, text)), np.uint64, batch.num_rows)
            yield common.with_columns(batch, keep, fp=pa.array(fp.view(np.int64)))

    return map_arrow(docs.select(*keep, text), run, schema)


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: word w of plane k holds bit k of 64 fingerprints, the first in its lowest bit."""
    padded = np.zeros(-(-len(fps) // 64) * 64, "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8")


def _closes(differences: Iterator[np.ndarray], shape, radius: int) -> np.ndarray:
    """Which of many pairs differ in at most radius places, from one plane of differences after another.

    Carry-save counters: counter j holds bit j of 64 counts in a word. A pair that passes the radius stays out, and the
    rest of the planes is abandoned once every pair has passed it.
    """
    width = max(1, radius.bit_length())
    counters = [np.zeros(shape, np.uint64) for _ in range(width)]
    out = np.zeros(shape, np.uint64)
    for k, carry in enumerate(differences):
        for j in range(width):
            carry, counters[j] = counters[j] & carry, counters[j] ^ carry
        out |= carry
        if k % 4 == 3 and k >= 8:
            over = out | _above(counters, radius)
            if (over == ~np.uint64(0)).all():
                break
    return ~(out | _above(counters, radius))


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Counts over radius, compared bit by bit from the highest."""
    more, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for j in range(len(counters) - 1, -1, -1):
        if radius >> j & 1:
            equal &= counters[j]
        else:
            more |= equal & counters[j]
            equal &= ~counters[j]
    return more


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with left[i] and right[j] within radius: the planes of right against 64 of left at a time."""
    table = planes(right)
    some_i, some_j = [], []
    for a in range(0, len(left), 64):
        part = left[a : a + 64].astype(np.uint64)
        signs = [(np.uint64(0) - (part >> np.uint64(k) & np.uint64(1)))[:, None] for k in range(BITS)]
        near = _closes((table[k][None, :] ^ signs[k] for k in range(BITS)), (len(part), table.shape[1]), radius)
        i, w = np.nonzero(near)
        if len(i):
            r, bit = np.nonzero(np.unpackbits(near[i, w].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            j = w[r] * 64 + bit
            real = j < len(right)
            some_i.append(i[r][real] + a)
            some_j.append(j[real])
    none = np.zeros(0, np.int64)
    return (np.concatenate(some_i), np.concatenate(some_j)) if some_i else (none, none)


def lagged_pairs(keys: np.ndarray, fps: np.ndarray, most: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at most `most` apart, with equal keys (sorted) and close fingerprints: planes against shifted planes."""
    some_i, some_j = [], []
    for lag in range(1, most + 1):
        at = np.flatnonzero(keys[lag:] == keys[:-lag])
        if not len(at):
            break
        a, b = planes(fps[at]), planes(fps[at + lag])
        near = _closes((a[k] ^ b[k] for k in range(BITS)), a.shape[1], radius)
        hit = np.flatnonzero(np.unpackbits(near.astype("<u8").view(np.uint8), bitorder="little")[: len(at)])
        some_i.append(at[hit])
        some_j.append(at[hit] + lag)
    none = np.zeros(0, np.int64)
    return (np.concatenate(some_i), np.concatenate(some_j)) if some_i else (none, none)


def forest(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links: as many components, fewer links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(ids[i].tolist(), ids[j].tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def bands() -> list[int]:
    """The bits of each choice of BANDS - RADIUS bands, as a mask: one table of buckets per choice."""
    edges = [round(BITS * k / BANDS) for k in range(BANDS + 1)]
    masks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(BANDS)]
    return [sum(masks[k] for k in chosen) for chosen in combinations(range(BANDS), BANDS - RADIUS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_LINKS = "a long, b long"


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of nodes (fp): every pair within RADIUS is joined by a path of links.

    Two fingerprints within RADIUS agree on some choice of bands, so they share a bucket of some table. Only buckets
    with two rows or more are compared. A bucket of more than `block` rows is cut into blocks by hash, and each pair of
    its blocks is a task's work of its own; no task holds more than two blocks. Of a bucket's links a spanning forest
    goes on, so a group of n near copies gives about n links, not n squared.
    """
    tables = F.explode(F.array(*[F.struct(F.lit(i).cast("int").alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(bands())]))
    keyed = nodes.select("fp", tables.alias("k")).select("fp", F.xxhash64("k.table", "k.bits").alias("key"))
    scratch = common.Scratch(nodes.sparkSession)
    sizes = scratch.write(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    keyed = common.attach_counted(keyed, sizes.withColumn("rows", F.col("n")), "key", "rows")
    n_blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), n_blocks).cast("int")
    # In a bucket of several blocks a row goes to each pair of blocks that holds its own.
    other = F.explode(F.sequence(F.lit(0), n_blocks - 1))
    spread = keyed.select("fp", "key", own.alias("own"), other.alias("other")).select("fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), (F.col("own") > F.col("other")).alias("side"), (F.col("own") == F.col("other")).alias("alone"))
    dealt = spread.repartition("key").sortWithinPartitions("key", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(keys: np.ndarray, fps: np.ndarray, sides: np.ndarray) -> pa.RecordBatch:
            found: list[tuple[int, int]] = []
            edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            size = np.diff(edge)
            small = np.repeat(size <= 16, size)
            i, j = lagged_pairs(keys[small], fps[small], 15)
            found += forest(i, j, fps[small].view(np.int64))
            for k in np.flatnonzero(size > 16).tolist():
                part, side = fps[edge[k] : edge[k + 1]], sides[edge[k] : edge[k + 1]]
                left, right = (part, part) if side.min() == side.max() else (part[~side], part[side])
                for x in range(0, len(left), 1024):
                    i, j = close_pairs(left[x : x + 1024], right)
                    ids = np.concatenate((left[x : x + 1024], right)).view(np.int64)
                    found += forest(i, j + len(left[x : x + 1024]), ids)
            a, b = zip(*{(min(p), max(p)) for p in found if p[0] != p[1]}, strict=True) if any(p[0] != p[1] for p in found) else ((), ())
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            sides = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if held:
                keys, fps, sides = (np.concatenate((h, x)) for h, x in zip(held.pop(), (keys, fps, sides), strict=True))
            if not len(keys):
                continue
            last = np.searchsorted(keys, keys[-1])  # the last key may go on in the next batch
            if last:
                yield compare(keys[:last], fps[:last], sides[:last])
            held.append((keys[last:], fps[last:], sides[last:]))
        for rest in held:
            yield compare(*rest)

    return map_arrow(dealt.select("fp", "key", "side"), run, _LINKS).distinct()


def components(scratch: common.Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root): the smallest node that each node of edges (a, b) reaches.

    Alternating large-star and small-star steps: each step links every node to the smallest neighbour, so a long chain
    shrinks by half or more; a step is two joins' worth of shuffle over the links that are left, and is written to the
    shared folder. It ends when the links form stars, which the count and sum of a step's links show.
    """
    edges = scratch.write(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}0")
    step, last = 0, None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Least neighbours are counted and written before they are joined: a node with very many links stays dealt over tasks.
        # large star: every larger neighbour of a node is linked to the smallest of the node and its neighbours
        least = scratch.write(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"), f"{name}least")
        large = scratch.write(common.attach_counted(both.filter("b > a"), least, "a", "n").select(F.col("m").alias("a"), "b").filter("a <> b").distinct(), f"{name}large")
        # small star: the smaller neighbours of a node, and the node, are linked to the smallest of them
        low = scratch.write(large.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n")), f"{name}low")
        small = common.attach_counted(large, low, "b", "n").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct()
        step += 1
        new = scratch.write(small, f"{name}{step}")
        sign = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}{step - 1}")
        edges = new
        if tuple(sign) == last:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        last = tuple(sign)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, fp, fingerprint (16 hex digits), component_id (smallest doc_id that links reach, itself included).

    Null and blank texts have fingerprint zero and link like any other. Null ids never name a component; a component of
    null ids only has a null name. Rows that repeat an id are rows of their own. An empty table gives no rows; other
    columns are not carried, so none can clash.
    """
    scratch = common.Scratch(docs.sparkSession)
    rows = scratch.write(fingerprints(common.hidden(docs, doc_id=doc_id, text=text), "text", shingle), "fingerprints")
    # Texts with one fingerprint are one node, so copies add no links; nodes and links are of the size of the distinct fingerprints.
    nodes = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = scratch.write(components(scratch, scratch.write(links(nodes.select("fp")), "links")), "roots")
    merged = scratch.write(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "merged")
    smallest = scratch.write(merged.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes")), "smallest")
    named = scratch.write(common.attach_counted(merged, smallest, "root", "nodes").select("fp", "root", "component_id", "n"), "named")
    out = common.attach_counted(rows, named, "fp", "n")
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("root").alias("component_root"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "fingerprint", "component_id")

"""Near copies at a similarity of 0.8: documents meet by the least hashes of their shingles, wide SimHash fingerprints are
compared bit-sliced where they meet, and the exact similarity of the shingles decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import map_arrow
from . import common, simhash
from .suffix_dedup import _mix

#: Words of a shingle, and 64-bit words of a fingerprint.
SHINGLE, WIDE = 5, 4
BITS = 64 * WIDE
#: Similarity (Jaccard, of shingles) that is sought.
SIMILARITY = 0.8
#: Keys of a document, and least hashes that each is made of. Two texts agree in a least hash with a chance of their
#: similarity, so those just as similar as is sought miss each other with 0.0008, and texts of nothing in common share no key:
#: the keys of a document are as many however many documents there are.
KEYS, LEAST_HASHES = 18, 5
#: Fingerprints that one comparison holds; a larger bucket is cut into blocks.
BLOCK = 2048
#: Texts of candidates whose shingles meet in one task are at most two such blocks.
EXACT_BLOCK = 256


def agreement(similarity: float) -> float:
    """Chance that a bit of two texts' fingerprints agrees: one less the angle of their shingle counts over pi."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


#: Bits in which texts of the similarity sought differ, and one standard deviation more; candidates lie within three, and
#: within a group of candidates pairs within five are checked.
DEVIATION = math.sqrt(BITS * agreement(SIMILARITY) * (1 - agreement(SIMILARITY)))
RADIUS = round(BITS * (1 - agreement(SIMILARITY)) + DEVIATION)
CANDIDATE_RADIUS, CHECKED = RADIUS + round(2 * DEVIATION), RADIUS + round(4 * DEVIATION)


def shingles(text: bytes, shingle: int = SHINGLE, digest=xxhash.xxh64_intdigest) -> np.ndarray:
    """Distinct hashes of a text's shingles in order; a text of fewer words is one shingle, and one without words has none."""
    words = text.translate(simhash._LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:n].tolist(), ends[len(words) - n :].tolist()
    return np.unique(np.fromiter((digest(joined[a:b], simhash.SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two texts' shingles (distinct, in order); texts without words are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return both / (len(a) + len(b) - both)


def _fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE words; each takes its own hash of every shingle, made from one. Each distinct shingle counts once."""
    counts = np.zeros((WIDE, 64), np.int64)
    for i in range(0, len(hashes), 8192):
        h = hashes[i : i + 8192]
        for k in range(WIDE):
            own = _mix(h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).astype("<u8")
            counts[k] += 2 * np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) - len(h)
    return ((counts > 0) * simhash._WEIGHTS).sum(axis=1, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE, digest=xxhash.xxh64_intdigest) -> np.ndarray:
    """WIDE words from a text's distinct shingles. A text without words has 0."""
    return _fingerprint(shingles(text, shingle, digest))


_ODD = _mix(np.arange(1, KEYS * LEAST_HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PLACES = _mix(np.arange(1, LEAST_HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def missed(similarity: float = SIMILARITY) -> float:
    """Chance that texts of a similarity share none of their keys."""
    return (1 - similarity**LEAST_HASHES) ** KEYS


def keys(hashes: np.ndarray) -> np.ndarray:
    """A text's keys: each from the least of its shingles' hashes in orders of the key's own. None of a text without words."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    x = hashes ^ (hashes >> np.uint64(29))
    least = np.full(len(_ODD), ~np.uint64(0))
    for i in range(0, len(x), 4096):
        np.minimum(least, (x[i : i + 4096, None] * _ODD).min(axis=0), out=least)
    joined = (least.reshape(KEYS, LEAST_HASHES) * _PLACES).sum(axis=1, dtype=np.uint64)
    return _mix(joined + np.arange(1, KEYS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _near(left: np.ndarray, right: np.ndarray, shape, radius: int) -> np.ndarray:
    """Close pairs from planes of left and right, which broadcast."""
    return simhash._closes((left[k] ^ right[k] for k in range(BITS)), shape, radius)


def _planes(fps: np.ndarray) -> np.ndarray:
    return np.concatenate([simhash.planes(fps[:, k]) for k in range(WIDE)])


def _compare(keys: np.ndarray, fps: np.ndarray, ids: np.ndarray, sides: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the close pairs of each key; rows are sorted by key. Of a key's two sides, pairs across are compared."""
    found: list[tuple[int, int]] = []
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    size = np.diff(edge)
    small = np.repeat(size <= 64, size)
    k, f, d = keys[small], fps[small], ids[small]
    for a in range(0, len(k), 8192):  # pieces overlap by the longest lag
        kk, ff, dd = k[a : a + 8192 + 63], f[a : a + 8192 + 63], d[a : a + 8192 + 63]
        for lag in range(1, 64):
            at = np.flatnonzero((kk[lag:] == kk[:-lag]) & (dd[lag:] != dd[:-lag]))
            if not len(at):
                if not (kk[lag:] == kk[:-lag]).any():
                    break
                continue
            near = _near(_planes(ff[at]), _planes(ff[at + lag]), (-(-len(at) // 64),), radius)
            hit = at[np.flatnonzero(np.unpackbits(near.astype("<u8").view(np.uint8), bitorder="little")[: len(at)])]
            found += zip(dd[hit].tolist(), dd[hit + lag].tolist(), strict=True)
    for x in np.flatnonzero(size > 64).tolist():
        part, own, side = fps[edge[x] : edge[x + 1]], ids[edge[x] : edge[x + 1]], sides[edge[x] : edge[x + 1]]
        (lf, li), (rf, ri) = ((part, own), (part, own)) if side.min() == side.max() else ((part[~side], own[~side]), (part[side], own[side]))
        table = _planes(rf)[:, None, :]
        for a in range(0, len(lf), 32):
            signs = np.concatenate([(np.uint64(0) - (lf[a : a + 32, w][None, :] >> np.arange(64, dtype=np.uint64)[:, None] & np.uint64(1))) for w in range(WIDE)])[:, :, None]
            near = _near(table, signs, (len(lf[a : a + 32]), table.shape[2]), radius)
            i, w = np.nonzero(near)
            if len(i):
                r, bit = np.nonzero(np.unpackbits(near[i, w].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                j = w[r] * 64 + bit
                real = j < len(rf)
                found += simhash.forest(i[r][real], j[real] + 32, np.concatenate((np.resize(li[a : a + 32], 32), ri)))
    if not found:
        return []
    pair = np.array(found, np.int64)
    return simhash.forest(np.arange(len(pair)), np.arange(len(pair)) + len(pair), np.concatenate((pair[:, 0], pair[:, 1])))


def links(nodes: DataFrame, radius: int = CANDIDATE_RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between nodes (id, fp: WIDE words as bytes, keys) within the radius that share a key.

    Ids and keys are shuffled first; fingerprints only of nodes whose key another node has too. A key with more than
    `block` rows is cut into blocks by hash, and each pair of its blocks is a task's work of its own; no comparison holds
    more than two blocks. Of a key's links a spanning forest goes on, so a group of n near copies gives about n links for
    a key.
    """
    scratch = common.Scratch(nodes.sparkSession)
    keyed = nodes.select("id", F.explode("keys").alias("key"))
    sizes = scratch.write(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    shared = common.attach_counted(keyed, sizes.withColumn("rows", F.col("n")), "key", "rows")
    n_blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(7)), n_blocks).cast("int")
    dealt = shared.select("id", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "id", (F.col("own") > F.col("other")).alias("side"))
    dealt = dealt.join(nodes.select("id", "fp"), "id").select("key", "id", "fp", "side")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            found = _compare(*parts, radius)
            return pa.RecordBatch.from_pydict({"a": pa.array([min(p) for p in found], pa.int64()), "b": pa.array([max(p) for p in found], pa.int64())})

        held: list[np.ndarray] | None = None
        for batch in batches:
            key, ids = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            fps = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(-1, WIDE)
            parts = [key, fps, ids, batch.column(3).to_numpy(zero_copy_only=False).astype(bool)]
            if held:
                parts = [np.concatenate(x) for x in zip(held, parts, strict=True)]
            last = int(np.searchsorted(parts[0], parts[0][-1])) if len(parts[0]) else 0  # the last key may go on in the next batch
            if last:
                yield out([x[:last] for x in parts])
            held = [x[last:] for x in parts]
        if held and len(held[0]):
            yield out(held)

    return map_arrow(dealt.repartition("key").sortWithinPartitions("key", "side"), meet, "a long, b long").filter("a <> b").distinct()


def _alike(ids: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], sides: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose similarity is reached, of one group or of two sides of one; nearest pairs are
    checked first, and a pair that is already joined needs no check.
    """
    two = sides.min() != sides.max()
    size = np.array([len(x) for x in sets])
    some: list[np.ndarray] = []
    for i in range(len(ids)):
        j = np.flatnonzero(sides != sides[i]) if two else np.arange(i + 1, len(ids))
        if two and sides[i]:
            break
        apart = np.bitwise_count(fps[j] ^ fps[i]).sum(axis=1, dtype=np.int64)
        ok = (apart <= CHECKED) & (np.minimum(size[j], size[i]) >= SIMILARITY * np.maximum(size[j], size[i])) & (ids[j] != ids[i])
        some.append(np.stack((apart[ok], np.full(ok.sum(), i), j[ok]), axis=1))
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    pairs = np.concatenate(some) if some else np.zeros((0, 3), np.int64)
    for _, i, j in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
        a, b = root(i), root(j)
        if a != b and similarity(sets[i], sets[j]) >= SIMILARITY:
            parent[a] = b
            out.append((int(ids[i]), int(ids[j])))
    return out


def verified(members: DataFrame, block: int = EXACT_BLOCK) -> DataFrame:
    """Links (a, b) of similarity SIMILARITY or more among members (id, root, text) of candidate groups, by their shingles.

    All pairs of a group are looked at, whatever table they met in. A group with more than `block` members is cut into
    blocks by hash, and each pair of its blocks is a task's work of its own. Of a group's links a spanning forest goes on.
    """
    scratch = common.Scratch(members.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in common.texts_of(batch)]
            fps = [_fingerprint(x).astype("<u8").tobytes() for x in sets]
            yield common.with_columns(batch, ["id", "root"], fp=pa.array(fps, pa.binary()), shingles=pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary()))

    sets = scratch.write(map_arrow(members.select("id", "root", "text"), cut, "id long, root long, fp binary, shingles binary"), "sets")
    large = scratch.write(sets.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > block), "large")
    n_blocks = F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(7)), n_blocks).cast("int")
    dealt = common.attach(sets, large, ["root"]).select("id", "fp", "shingles", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "id", "fp", (F.col("own") > F.col("other")).alias("side"), "shingles")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            ids, fps, sides, own = zip(*rows, strict=True)
            found = _alike(np.array(ids), np.frombuffer(b"".join(fps), "<u8").reshape(-1, WIDE), [np.frombuffer(x, "<u8") for x in own], np.array(sides))
            return pa.RecordBatch.from_pydict({"a": pa.array([min(p) for p in found], pa.int64()), "b": pa.array([max(p) for p in found], pa.int64())})

        now, held = None, []
        for batch in batches:
            for key, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and key != now:
                    yield out(held)
                    held = []
                now = key
                held.append(tuple(row))
        if held:
            yield out(held)

    return map_arrow(dealt.repartition("key").sortWithinPartitions("key", "side"), meet, "a long, b long").distinct()


def classes(docs: DataFrame, doc_id: str, text: str, key: str) -> DataFrame:
    """Per row: doc_id, carried (the column `key`, a hash of the row's id and text), component_root; rows with one root are
    copies, or near copies by the similarity of their shingles, of each other or by way of others.

    Null and blank texts are copies of each other. Texts with the same shingles are one node, however many rows have
    them; rows that repeat an id are rows of their own. An empty table gives no rows; other columns are not carried, so
    none can clash.
    """
    scratch = common.Scratch(docs.sparkSession)
    own = common.hidden(docs, doc_id=doc_id, text=text, carried=key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, ids, met = [], [], []
            for t in common.texts_of(batch):
                x = shingles(t)
                fps.append(_fingerprint(x).astype("<u8").tobytes())
                ids.append(xxhash.xxh64_intdigest(x.astype("<u8").tobytes(), simhash.SEED) - (1 << 63))
                met.append(keys(x).view(np.int64))
            yield common.with_columns(batch, ["doc_id", "carried"], id=pa.array(ids, pa.int64()), fp=pa.array(fps, pa.binary()), keys=pa.array(met, pa.list_(pa.int64())))

    rows = scratch.write(map_arrow(own, run, "doc_id long, carried long, id long, fp binary, keys array<long>"), "fingerprints")
    nodes = scratch.write(rows.groupBy("id").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min("carried").alias("carried"), F.count(F.lit(1)).alias("n")), "nodes")
    near = scratch.write(simhash.components(scratch, scratch.write(links(nodes), "links")), "near")
    # One row's text of each node that has candidates; only these texts move.
    asked = scratch.write(nodes.join(near, nodes.id == near.node).select("carried", "id", "root"), "asked")
    members = common.attach(own.select("carried", "text"), asked, ["carried"], "inner").select("id", "root", "text")
    roots = scratch.write(simhash.components(scratch, scratch.write(verified(members), "alike"), "exact"), "roots")
    named = scratch.write(nodes.join(roots, nodes.id == roots.node, "left").select("id", F.coalesce("root", "id").alias("component_root"), "n"), "named")
    return common.attach_counted(rows.drop("fp", "keys"), named, "id", "n").select("doc_id", "carried", "component_root")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, but one row only of each group of copies and near copies: that of the smallest id.

    Null ids come last; rows that share an id are told apart by a hash of their text, and of equal rows one stays.
    """
    scratch = common.Scratch(docs.sparkSession)
    key = F.xxhash64(F.col(doc_id), F.col(text))
    found = classes(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), key.alias("key")), "doc_id", "text", "key")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col("carried").alias("key"))
    keys = scratch.write(found.groupBy("component_root", "doc_id", "carried").agg(F.count("*").alias("times")), "keys")
    # A group's winner is an (id, key) of its own, so losers are found by that, and no large group meets in one task.
    won = scratch.write(keys.groupBy("component_root").agg(F.min(rank).alias("won")).select(F.col("won.doc_id").alias("w_id"), F.col("won.key").alias("w_key")), "won")
    placed = keys.join(won, keys["doc_id"].eqNullSafe(won["w_id"]) & (keys["carried"] == won["w_key"]), "left").select("doc_id", "carried", "times", F.col("w_key").isNotNull().alias("won"))
    # What goes is a table of ids; of rows that are there twice, one is taken back.
    lost = scratch.write(placed.filter(~F.col("won") | (F.col("times") > 1)), "lost")
    own, name = common.numbered(docs)
    rows = own.withColumn("key", F.xxhash64(name[doc_id], name[text]))
    on = lambda t: [rows[name[doc_id]].eqNullSafe(t["doc_id"]), rows["key"] == t["carried"]]
    # Where few rows go, their table is broadcast and the texts stay where they are.
    few = lost.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS
    kept = rows.join(F.broadcast(lost) if few else lost.hint("merge"), on(lost), "left_anti")
    twice = lost.filter("won and times > 1")
    if not twice.isEmpty():
        kept = kept.union(rows.join(twice, on(twice), "left_semi").dropDuplicates([name[doc_id], "key"]))
    return kept.select(*own.columns).toDF(*docs.columns)

"""Removal of repeated strings by prefix-free parsing.

Rolling-hash triggers cut texts into phrases, so texts that share a passage share its phrases. The parse of the corpus is
spread by phrase: a phrase with its continuation that has stood earlier repeats whole, and costs no more work. Only where
different continuations meet, suffix arrays of dictionary and parse put the suffixes in order, and suffixes that agree
on `length` bytes stand side by side.

How equal strings meet: the trigger of a window of `length` bytes is the place of the least rolling hash among its first
SPAN places. It depends on the window's bytes alone, so equal windows have their triggers at equal places. Windows that
share a trigger make up a phrase; all of them hold the `length - SPAN + 1` bytes from the trigger on, its anchor. So
phrases with different anchors have no window in common, and anchors spread the work.

What is equal: in a shard, bytes are compared; between tasks, digests of 96 bits (phrases) or 128 bits (windows) are.
Rolling hashes only choose triggers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shipping import map_arrow, prepare
from . import common

LENGTH = 100
#: Places among which a window's trigger is chosen, a power of two, and the bytes of the hash that chooses.
SPAN, GRAM = 64, 16
#: Bytes that are parsed, or sorted, at once; a longer text is cut into segments that overlap by length - 1 bytes.
SHARD = 3 << 19
#: Bytes of text that a task of a shuffle, and a group of texts in it, are sized for.
TASK_BYTES, GROUP_BYTES = 64 << 20, 8 << 20
#: Phrases of the inner parse, whose dictionary and parse get suffix arrays: bytes of a trigger, and one trigger in so many.
INNER_GRAM, INNER_RATE = 8, 32

_PLACE = np.uint64((1 << 28) - 1)
_LOW, _HIGH = np.uint64((1 << 32) - 1), np.uint64(((1 << 32) - 1) << 32)
#: The id that a null id is ordered as; a document that bears it counts with them.
_NULL = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2^64 and their inverses, and a number for each byte; grown as needed."""

    def __init__(self, seed: int):
        with np.errstate(over="ignore"):
            self.byte = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.base = int(self.byte[0]) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))


class Hashes:
    """Rolling hashes that choose triggers: differences of prefix sums, moved to the start. Equal ones prove nothing."""

    def __init__(self, data: np.ndarray, powers: _Powers):
        powers.grow(len(data) + 1)
        self.powers = powers
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(powers.byte[data] * powers.up[: len(data)], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        n = max(0, len(self.sums) - length)
        return (self.sums[length:] - self.sums[:n]) * self.powers.down[:n]


_POWERS = _Powers(2)


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of stretches of data, as two numbers each."""
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def parse(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """Phrases of segments [start, end) of data: first window, number of windows, anchor's and phrase's names.

    A phrase reaches from its first window's start to its last window's end. Its name is 64 bits of its digest; its
    anchor's name holds 32 bits of the anchor's digest, and below them 32 more of the phrase's.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    nothing = none, none, none.astype(np.uint64), none.astype(np.uint64)
    if n < length:
        return nothing
    key = _mix(Hashes(data, _POWERS).all(gram)) & ~_PLACE | (_PLACE - np.arange(n - gram + 1, dtype=np.uint64))
    step = 1
    while step < span:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    valid = np.zeros(n + 1, np.int8)
    long = ends - starts >= length
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]))
    if not len(at):
        return nothing
    trigger = (_PLACE - (key[at] & _PLACE)).astype(np.int64)
    new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(trigger) != 0)))
    # Segments that touch: a window that starts a segment starts a phrase.
    new |= np.isin(at, starts)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    begin, trigger = at[first], trigger[first]
    whole = data.tobytes()
    name, more = digests(whole, begin, begin + count + length - 1)
    anchor, _ = digests(whole, trigger, trigger + length - span + 1)
    return begin, count, anchor & _HIGH | more & _LOW, name


def doubled(rank: np.ndarray, end: np.ndarray, depth: int, known: int = 1) -> np.ndarray:
    """Ranks of suffixes by their first `depth` symbols, from ranks by `known`; a suffix ends at `end`. Equal ones share a rank."""
    place = np.arange(len(rank))
    while known < depth:
        next_ = place + known
        beyond = np.where(next_ < end, rank[np.minimum(next_, len(rank) - 1)], 0)
        _, rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + beyond, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        known *= 2
    return rank


def corpus_order(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Places of the segments of data in the order of their suffixes, to `depth` bytes.

    Prefix-free parsing: phrases begin at triggers and reach to the end of the next; the dictionary holds each distinct
    phrase once and gets a suffix array, the parse (phrases in order) another. No phrase's suffix is a proper prefix of
    another's, so a place is ordered by its phrase's suffix, and among equal ones by the rank of the parse after it.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n >= INNER_GRAM:
        cut[: n - INNER_GRAM + 1] = _mix(Hashes(data, _POWERS).all(INNER_GRAM)) % np.uint64(INNER_RATE) == 0
    segment = np.repeat(np.arange(len(starts)), ends - starts)
    # A trigger is whole inside its segment.
    room = ends[segment] - np.arange(n) >= INNER_GRAM
    cut[:n] &= room
    cut[starts[starts < ends]] = True
    begin = np.flatnonzero(cut[:n])
    seg = segment[begin]
    last = np.append(seg[1:] != seg[:-1], True)
    stop = np.where(last, ends[seg], np.append(begin[1:], n) + INNER_GRAM)
    stop = np.minimum(stop, ends[seg])
    # dictionary: phrases are told apart by their bytes
    whole, known = data.tobytes(), {}
    phrase = np.array([known.setdefault(whole[a:b], len(known)) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], np.int64)
    text = np.frombuffer(b"".join(known), np.uint8).astype(np.int64) + 1
    d_size = np.array([len(x) for x in known], np.int64)
    d_start = np.concatenate(([0], np.cumsum(d_size)[:-1]))
    d_end = np.repeat(d_start + d_size, d_size)
    place = np.arange(len(text))
    rank = text
    for k in (1, 2, 3):
        rank = rank * 257 + np.where(place + k < d_end, text[np.minimum(place + k, len(text) - 1)], 0)
    _, rank = np.unique(rank, return_inverse=True)
    d_rank = doubled(rank.astype(np.int64) + 1, d_end, depth, 4)
    # parse: a phrase's symbol is its rank as a suffix of the dictionary
    p_end = np.searchsorted(seg, seg, "right")
    p_rank = doubled(d_rank[d_start[phrase]], p_end, depth)
    after = np.where(last, 0, np.append(p_rank[1:], 0))
    owner = np.searchsorted(begin, np.arange(n), "right") - 1
    return np.lexsort((after[owner], d_rank[d_start[phrase[owner]] + np.arange(n) - begin[owner]]))


def agree(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each place in order has a common prefix of `length` bytes with the place before it: bytes are compared, eight at a time.

    Every place has `length` bytes after it.
    """
    out = np.zeros(len(order), bool)
    if len(order) < 2:
        return out
    if length < 8:
        words, step = data.astype(np.uint64), 1
    else:
        words, step = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view("<u8").ravel(), 8
    live = np.arange(1, len(order))
    for k in [*range(0, length - step, step), length - step]:
        live = live[words[order[live] + k] == words[order[live - 1] + k]]
        if not len(live):
            break
    out[live] = True
    return out


_PACKED = "kind int, bucket int, key array<long>, doc array<long>, pos array<long>, n array<int>"
REPS, MARKS, ASKED, MIXED = 0, 1, 2, 3


def _bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    """As _bucket_column."""
    return ((doc ^ (doc >> 9) ^ (doc >> 21)) % buckets).astype(np.int64)


def _bucket_column(doc, buckets: int):
    return F.pmod(doc.bitwiseXOR(F.shiftright(doc, 9)).bitwiseXOR(F.shiftright(doc, 21)), F.lit(buckets)).cast("int")


def _pack(kind: int, bucket: np.ndarray, key: np.ndarray | None, doc: np.ndarray, pos: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """One row per bucket, with arrays of what goes there."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    edge = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(edge, len(b)).astype(np.int32))
    lists = lambda x, t: pa.ListArray.from_arrays(offsets, pa.array(x[order].astype(t)))
    keys = pa.nulls(len(edge), pa.list_(pa.int64())) if key is None else lists(key, np.int64)
    columns = [pa.array(np.full(len(edge), kind, np.int32)), pa.array(b[edge].astype(np.int32)), keys, lists(doc, np.int64), lists(pos, np.int64), lists(n, np.int32)]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "bucket", "key", "doc", "pos", "n"])


def _flat(rows: list[pa.RecordBatch] | pa.Table, name: str) -> np.ndarray:
    parts = [r.column(r.schema.get_field_index(name)) for r in rows] if isinstance(rows, list) else rows.column(name).chunks
    parts = [p.flatten().to_numpy(zero_copy_only=False) for p in parts]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _split_first(keys: tuple[np.ndarray, ...], doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, doc and pos; and, in that order, whether an entry is the first with its keys."""
    order = np.lexsort((pos, doc, *reversed(keys)))
    first = np.zeros(len(order), bool)
    if len(order):
        first[0] = True
        for k in keys:
            first[1:] |= k[order][1:] != k[order][:-1]
    return order, first


def _shards(rows: Iterator[tuple[int, int, bytes]], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bytes, starts, ends, doc, base) of segments that add up to about SHARD bytes."""
    held: list[tuple[int, int, bytes]] = []
    total = 0

    def out():
        size = np.array([len(t) for _, _, t in held], np.int64)
        ends = np.cumsum(size)
        return np.frombuffer(b"".join(t for _, _, t in held), np.uint8), ends - size, ends, np.array([d for d, _, _ in held], np.int64), np.array([b for _, b, _ in held], np.int64)

    for doc, base, text in rows:
        for i in range(0, max(1, len(text) - length + 1), SHARD):
            part = text[i : i + SHARD + length - 1]
            if held and total + len(part) > SHARD:
                yield out()
                held, total = [], 0
            held.append((doc, base + i, part))
            total += len(part)
    if held:
        yield out()


def _parse_batches(batches: Iterator[pa.RecordBatch], length: int, span: int, gram: int, buckets: int, meets: int) -> Iterator[pa.RecordBatch]:
    """Phrases of documents: the first of each in a shard goes to its anchor's bucket, the others repeat."""
    for batch in batches:
        docs, bases = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for data, starts, ends, doc, base in _shards(zip(docs, bases, common.texts_of(batch), strict=True), length):
            begin, n, anchor, whole = parse(data, starts, ends, length, span, gram)
            if not len(begin):
                continue
            own = np.searchsorted(starts, begin, "right") - 1
            # An empty segment shares its start with the one after it, which is the one that holds windows.
            doc_of, pos = doc[own], base[own] + begin - starts[own]
            order, first = _split_first((whole, anchor), doc_of, pos)
            reps, again = order[first], order[~first]
            # An anchor with several phrases in this very shard is known to have several: they go by their own hash, and
            # the anchor's bucket gets one row without windows that says so. A hot anchor thus costs a row per shard.
            _, group, size = np.unique(anchor[reps] >> np.uint64(32), return_inverse=True, return_counts=True)
            mixed = size[group] > 1
            alone, several = reps[~mixed], reps[mixed]
            told = several[np.unique(anchor[several] >> np.uint64(32), return_index=True)[1]] if len(several) else several
            sent = np.concatenate((alone, told))
            windows = np.concatenate((n[alone], np.zeros(len(told), n.dtype)))
            bucket = (anchor[sent] >> np.uint64(32)).astype(np.int64) % meets
            yield _pack_pair(REPS, bucket, anchor[sent], whole[sent], doc_of[sent], pos[sent], windows)
            if len(several):
                yield _pack_pair(MIXED, (whole[several] % np.uint64(meets)).astype(np.int64), anchor[several], whole[several], doc_of[several], pos[several], n[several])
            if len(again):
                yield _pack(MARKS, _bucket(doc_of[again], buckets), None, doc_of[again], pos[again], n[again])


def _pack_pair(kind: int, bucket: np.ndarray, a: np.ndarray, b: np.ndarray, doc: np.ndarray, pos: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """As _pack, with key b, and a in a column of its own."""
    packed = _pack(kind, bucket, b.view(np.int64), doc, pos, n)
    more = _pack(kind, bucket, a.view(np.int64), doc, pos, n)
    return pa.RecordBatch.from_arrays([*packed.columns, more.column(2)], names=[*packed.schema.names, "a"])


_REPS = _PACKED + ", a array<long>"


def _with_a(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch if "a" in batch.schema.names else pa.RecordBatch.from_arrays([*batch.columns, pa.array([None] * batch.num_rows, pa.list_(pa.int64()))], names=[*batch.schema.names, "a"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table | None, pa.Table | None, pa.Table | None]]:
    """Of each bucket (batches are sorted by it): rows of kind REPS, of kind MIXED and of kind MARKS, each or None."""
    held: list[pa.RecordBatch] = []
    now = None

    def out():
        t = pa.Table.from_batches(held)
        kinds = t.column("kind").to_numpy()
        some = lambda mask: t.filter(pa.array(mask)) if mask.any() else None
        rest = some((kinds != REPS) & (kinds != MIXED))
        return some(kinds == REPS), some(kinds == MIXED), rest

    for batch in batches:
        b = batch.column(1).to_numpy(zero_copy_only=False)
        edge = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
        for x, y in zip(edge, edge[1:], strict=False):
            if y == x:
                continue
            if now is not None and int(b[x]) != now:
                yield out()
                held = []
            now = int(b[x])
            held.append(batch.slice(x, y - x))
    if held:
        yield out()


def _meet_phrases(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Equal phrases that are not the first repeat; the firsts are asked for where their anchor has several phrases.

    Equal phrases that went different ways, by anchor and by their own hash, are both asked for, and meet as windows.
    """

    for reps, mixed, passing in _by_bucket(batches):
        marks, asked = _Ranges(), _Ranges()
        if passing is not None:
            marks.add(*(_flat(passing, c) for c in ("doc", "pos", "n")))
        if reps is not None:
            key, a, *ranges = (_flat(reps, c) for c in ("key", "a", "doc", "pos", "n"))
            doc, pos, n = ranges
            anchor = a >> 32
            known = np.unique(anchor[n == 0])
            real = np.flatnonzero(n > 0)
            order, first = _split_first((anchor[real], key[real], a[real]), doc[real], pos[real])
            order = real[order]
            marks.add(*(x[order[~first]] for x in ranges))
            firsts = order[first]
            if len(firsts):
                same = anchor[firsts]
                edge = np.concatenate(([True], same[1:] != same[:-1]))
                size = np.diff(np.append(np.flatnonzero(edge), len(firsts)))
                own = firsts[np.repeat(size > 1, size) | np.isin(same, known)]
                asked.add(*(x[own] for x in ranges))
        if mixed is not None:
            key, a, *ranges = (_flat(mixed, c) for c in ("key", "a", "doc", "pos", "n"))
            order, first = _split_first((key, a), *ranges[:2])
            marks.add(*(x[order[~first]] for x in ranges))
            asked.add(*(x[order[first]] for x in ranges))
        yield from marks.packed(MARKS, buckets)
        yield from asked.packed(ASKED, buckets)


class _Ranges:
    """Ranges (doc, pos, n) gathered, to go out as one packed row per bucket of documents."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, *part: np.ndarray) -> None:
        if len(part[0]):
            self.parts.append(part)

    def packed(self, kind: int, buckets: int) -> Iterator[pa.RecordBatch]:
        if self.parts:
            doc, pos, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            yield _pack(kind, _bucket(doc, buckets), None, doc, pos, n)


def _runs(pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of the ranges [pos, pos + n)."""
    order = np.argsort(pos, kind="stable")
    start, end = pos[order], np.maximum.accumulate((pos + n)[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def _rows_of(texts: pa.Table, packed: pa.Table) -> Iterator[tuple[int, int, int, bytes, np.ndarray, np.ndarray]]:
    """(row, doc, base, text, pos, n) of a bucket's texts with the ranges that lie in them."""
    doc, pos, n = (_flat(packed, c) for c in ("doc", "pos", "n"))
    order = np.lexsort((pos, doc))
    doc, pos, n = doc[order], pos[order], n[order]
    ids, bases = texts.column("doc").to_pylist(), texts.column("base").to_pylist()
    for i, t in enumerate(texts.column("text").cast(pa.binary()).to_pylist()):
        t = t or b""
        a, b = np.searchsorted(doc, ids[i], "left"), np.searchsorted(doc, ids[i], "right")
        x = a + np.searchsorted(pos[a:b], bases[i], "left")
        y = a + np.searchsorted(pos[a:b], bases[i] + len(t), "left")
        yield i, ids[i], bases[i], t, pos[x:y], n[x:y]


def _sort_asked(texts: pa.Table, asked: pa.Table, length: int, buckets: int, meets: int) -> pa.Table:
    """Windows of the phrases that were asked for, in the order of their suffixes: the first of each in a shard goes to the bucket of its digest."""
    out: list[pa.RecordBatch] = []

    def stretches():
        for _, doc, base, text, pos, n in _rows_of(texts, asked):
            if len(pos):
                for a, b in zip(*_runs(pos, n), strict=True):
                    yield doc, int(a), text[a - base : b - base + length - 1]

    for data, starts, ends, doc, base in _shards(stretches(), length):
        order = corpus_order(data, starts, ends, length)
        own = np.searchsorted(starts, np.arange(len(data)), "right") - 1
        order = order[(ends[own] - np.arange(len(data)) >= length)[order]]
        if not len(order):
            continue
        d, p = doc[own[order]], (base[own] + np.arange(len(data)) - starts[own])[order]
        # Windows that agree stand side by side; in each run the earliest is the one that stays.
        run = np.cumsum(~agree(data, order, length))
        inside, first = _split_first((run,), d, p)
        one = inside[first]
        again = inside[~first]
        name, more = digests(data.tobytes(), order[one], order[one] + length)
        out.append(_pack_pair(REPS, (name % np.uint64(meets)).astype(np.int64), more, name, d[one], p[one], np.ones(len(one), np.int64)))
        if len(again):
            out.append(_with_a(_pack(MARKS, _bucket(d[again], buckets), None, d[again], p[again], np.ones(len(again), np.int64))))
    return pa.Table.from_batches(out, schema=_REPS_ARROW)


_REPS_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("key", pa.list_(pa.int64())), ("doc", pa.list_(pa.int64())), ("pos", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("a", pa.list_(pa.int64()))])


def _meet_windows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Windows of a digest: all but the first repeat."""
    for reps, _, passing in _by_bucket(batches):
        marks = _Ranges()
        if passing is not None:
            marks.add(*(_flat(passing, c) for c in ("doc", "pos", "n")))
        if reps is not None:
            key, a, *ranges = (_flat(reps, c) for c in ("key", "a", "doc", "pos", "n"))
            order, first = _split_first((key, a), *ranges[:2])
            marks.add(*(x[order[~first]] for x in ranges))
        yield from marks.packed(MARKS, buckets)


_RESULT = "doc long, base long, n_bytes long, spans array<struct<start:long,end:long>>, n_removed long, kept_sha256 string"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _remove(texts: pa.Table, marks: pa.Table, length: int) -> pa.Table:
    """Per text: the maximal runs of bytes that marked windows cover, and what is left."""
    docs, bases, sizes, spans, removed, digests = [], [], [], [], [], []
    for _, doc, base, text, pos, n in _rows_of(texts, marks):
        own = []
        if len(pos):
            own = [(int(a) - base, int(b) - base) for a, b in zip(*_runs(pos, n + length - 1), strict=True)]
        kept, at = hashlib.sha256(), 0
        for a, b in own:
            kept.update(text[at:a])
            at = b
        kept.update(text[at:])
        docs.append(doc)
        bases.append(base)
        sizes.append(len(text))
        spans.append([{"start": a, "end": b} for a, b in own])
        removed.append(sum(b - a for a, b in own))
        digests.append(kept.hexdigest())
    return pa.Table.from_pydict({"doc": pa.array(docs, pa.int64()), "base": pa.array(bases, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "spans": pa.array(spans, _SPANS), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})


def _placed(scratch: common.Scratch, docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs (doc_id, text) as doc, base, text; and whether an id is repeated.

    Rows that share an id stand one behind the other, in the order of their hashes: `base` is where a row starts. Rows
    that are equal share a base.
    """
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(_NULL)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    twice = scratch.write(rows.groupBy("doc").agg(F.count("*").alias("times")).filter("times > 1"), "twice")
    if twice.isEmpty():
        return rows.select("doc", F.lit(0).cast("long").alias("base"), "text"), False
    hashed = rows.withColumn("h", F.xxhash64("text"))
    same = common.attach(hashed.select("doc", "h", F.octet_length("text").alias("size")), twice, ["doc"], "inner").groupBy("doc", "h").agg(F.max("size").alias("size"))
    before = W.partitionBy("doc").orderBy("h").rowsBetween(W.unboundedPreceding, -1)
    bases = scratch.write(same.select("doc", "h", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("base")), "bases")
    return common.attach(hashed, bases, ["doc", "h"]).select("doc", F.coalesce("base", F.lit(0)).cast("long").alias("base"), "text"), True


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, n_bytes, spans (byte ranges removed), n_removed, n_spans, kept_sha256.

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a smaller id, or further ahead in
    the same text. Null ids come first; rows that share an id count as one document, in the order of their texts'
    hashes; equal rows are copies of the first of them. Null and empty texts have no bytes; a table without rows gives
    none. gram + span - 1 may be `length` at most.
    """
    if gram + span - 1 > length or span & (span - 1):
        raise ValueError("span is a power of two, and gram + span - 1 at most length")
    spark = docs.sparkSession
    prepare(spark)
    scratch = common.Scratch(spark)
    rows, repeated = _placed(scratch, common.hidden(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")))
    # Texts are dealt over `buckets`, phrases and windows over `meets`, both in measure of the texts' bytes; what goes from
    # one to another is one packed row.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    meets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    buckets = meets * max(2, -(-size // (meets * GROUP_BYTES)))
    by_bucket = lambda df: common.by_bucket(df, meets)
    dealt = lambda df: common.dealt_by_bucket(df, meets).drop("part").sortWithinPartitions("bucket")
    phrases = map_arrow(rows, lambda it: (_with_a(b) for b in _parse_batches(it, length, span, gram, buckets, meets)), _REPS)
    met = scratch.write(map_arrow(dealt(phrases), lambda it: _meet_phrases(it, buckets), _PACKED), "met")
    texts = rows.select(_bucket_column(F.col("doc"), buckets).alias("bucket"), "doc", "base", "text")
    packed = ("bucket", "doc", "pos", "n")
    asked = met.filter(F.col("kind") == ASKED).select(*packed)
    sorted_ = by_bucket(texts).cogroup(by_bucket(asked)).applyInArrow(lambda a, b: _sort_asked(a, b, length, buckets, meets), _REPS)
    windows = map_arrow(dealt(sorted_), lambda it: _meet_windows(it, buckets), _PACKED)
    marks = met.filter(F.col("kind") == MARKS).select(*packed).union(windows.select(*packed))
    out = by_bucket(texts).cogroup(by_bucket(marks)).applyInArrow(lambda a, b: _remove(a, b, length), _RESULT)
    if repeated:
        # The second of equal rows is a copy from its first byte on.
        copy = (F.row_number().over(W.partitionBy("doc", "base", "kept_sha256").orderBy("n_removed")) > 1) & (F.col("n_bytes") >= length)
        gone = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
        out = out.withColumn("copy", copy).select("doc", "n_bytes", F.when(F.col("copy"), gone).otherwise(F.col("spans")).alias("spans"), F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(F.col("copy"), F.sha2(F.lit(b""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
    return out.select(F.when(F.col("doc") != _NULL, F.col("doc")).alias("doc_id"), "n_bytes", "spans", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(common.documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
f AS (SELECT k, min((doc_id, i)) AS first FROM w GROUP BY k HAVING count(*) > 1),
s AS (SELECT w.doc_id, w.i, CASE WHEN w.i <= lag(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) + 100 THEN 0 ELSE 1 END AS new FROM w JOIN f ON w.k = f.k WHERE (w.doc_id, w.i) > f.first),
r AS (SELECT doc_id, g, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s) GROUP BY doc_id, g),
p AS (SELECT r.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER o, 0) + 1, 2 * (a - coalesce(lag(b) OVER o, 0))) AS kept FROM r JOIN d ON r.doc_id = d.doc_id WINDOW o AS (PARTITION BY r.doc_id ORDER BY a)),
t AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(kept, '' ORDER BY a) AS kept FROM p GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""

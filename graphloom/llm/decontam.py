"""Benchmark decontamination: suffix arrays over shards of documents, searched for every suffix of the benchmark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import map_arrow
from . import common

WINDOW = 10
#: Bytes of documents that one suffix array covers.
SHARD_BYTES = 2 << 20
#: Bytes of benchmark text that are searched at once; a larger benchmark is searched in several such blocks, each for so
#: many bytes of documents.
BLOCK_BYTES, ROUND_BYTES = 8 << 20, 16 << 20

#: ASCII letters fold to lower case, digits and bytes from 0x80 stay, all else parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Patterns:
    """The windows of some benchmark items as word ids; word 0 stands for words of no item, and ends an item.

    Each distinct window is searched once: `first` is where one of its occurrences begins and `need` its words;
    `at` and `of` are all its occurrences' places and items, those of window w from `since[w]` to `since[w + 1]`.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        self.window = window
        ids: list[int] = []
        starts: list[int] = []
        for name, text in items:
            own = words(text)
            if own:
                self.names.append(name)
                starts.append(len(ids))
                ids += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own]
                ids.append(0)
        self.ids, self.starts = np.array(ids + [0], np.int32), np.array(starts, np.int64)
        self.ends = np.append(self.starts[1:], len(ids)) - 1 if starts else self.starts
        known: dict[bytes, int] = {}
        raw, first, need, win, at, of = self.ids.tobytes(), [], [], [], [], []
        for k, (a, b) in enumerate(zip(self.starts.tolist(), self.ends.tolist(), strict=True)):
            n = min(window, b - a)
            for o in range(a, b - n + 1):
                w = known.setdefault(raw[4 * o : 4 * (o + n)], len(known))
                if w == len(first):
                    first.append(o)
                    need.append(n)
                win.append(w)
                at.append(o)
                of.append(k)
        self.first, self.need = np.array(first, np.int64), np.array(need, np.int64)
        order = np.argsort(np.array(win, np.int64), kind="stable")
        self.at, self.of = np.array(at, np.int64)[order], np.array(of, np.int64)[order]
        self.since = np.concatenate(([0], np.cumsum(np.bincount(np.array(win, np.int64), minlength=len(first)))))
        self.shortest = int(self.need.min()) if first else 0
        self.rank = np.argsort(np.argsort(np.array(self.names, object), kind="stable"), kind="stable") if self.names else np.zeros(0, np.int64)

    def occurrences(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the windows found, and which occurrence, of each occurrence of these."""
        n = self.since[found + 1] - self.since[found]
        of = np.repeat(np.arange(len(found)), n)
        return of, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.since[found][of]


def suffix_array(ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions `at` of ids in the order of the suffixes that start there, to `depth` words; 0 ends a suffix.

    Prefix doubling. `at` holds, with a position, those after it up to the 0, so that each rank needed is known.
    """
    rank = np.zeros(len(ids) + 1, np.int64)
    rank[at] = ids[at]
    k = 1
    while True:
        key = rank[at] * (len(ids) + int(ids.max(initial=0)) + 2) + rank[np.minimum(at + k, len(ids))] if k < depth else rank[at]
        order = np.argsort(key, kind="stable")
        if k >= depth:
            return at[order]
        sorted_key = key[order]
        new = np.cumsum(np.concatenate(([1], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64))))
        rank[at[order]] = new
        if new[-1] == len(at):
            return at[order]
        k *= 2


def lcp(ids: np.ndarray, text_at: np.ndarray, pat: Patterns, which: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Common words of the text suffixes and the pattern suffixes, up to limit."""
    out = np.zeros(len(which), np.int64)
    live = np.arange(len(which))
    k = 0
    while len(live):
        p, t = pat.first[which[live]] + k, text_at[live] + k
        same = (k < limit[live]) & (t < len(ids))
        same[same] = ids[t[same]] == pat.ids[p[same]]
        live = live[same]
        k += 1
        out[live] = k
    return out


def bounds(ids: np.ndarray, sa: np.ndarray, pat: Patterns, which: np.ndarray, limit: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of every pattern suffix at once: first place in sa not below (right: above) its first `limit` words."""
    lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(sa), np.int64)
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) // 2
        w, lim, t = which[live], limit[live], sa[mid]
        same = lcp(ids, t, pat, w, lim)
        whole = same >= lim
        in_text = np.where(t + same < len(ids), ids[np.minimum(t + same, len(ids) - 1)], 0)
        below = np.where(whole, right, in_text < pat.ids[pat.first[w] + np.where(whole, 0, same)])
        lo[live] = np.where(below, mid + 1, lo[live])
        hi[live] = np.where(below, hi[live], mid)


class Prefixes:
    """Ranks of all places of ids by their first 1, 2, 4, ... words, up to `depth`, in which any two places' common words are counted."""

    def __init__(self, ids: np.ndarray, depth: int):
        n = len(ids)
        stops = np.flatnonzero(ids == 0)
        self.end = stops[np.searchsorted(stops, np.arange(n))]
        self.levels = [ids.astype(np.int32)]
        k = 1
        while k < depth:
            rank = self.levels[-1].astype(np.int64)
            then = np.arange(n) + k
            beyond = np.where(then < self.end, rank[np.minimum(then, n - 1)], 0)
            _, rank = np.unique(rank * (int(rank.max()) + 2) + beyond, return_inverse=True)
            self.levels.append((rank + 1).astype(np.int32))
            k *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words of the places a and b, up to the ends of their runs."""
        out = np.zeros(len(a), np.int64)
        most = np.minimum(self.end[a] - a, self.end[b] - b)
        for k in reversed(range(len(self.levels))):
            left = np.flatnonzero(out < most)
            same = left[self.levels[k][a[left] + out[left]] == self.levels[k][b[left] + out[left]]]
            out[same] += 1 << k
        return np.minimum(out, most)


def least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo:hi] of each range, none of them empty."""
    table, k = [values], 1
    while 2 * k <= len(values):
        table.append(np.minimum(table[-1][:-k], table[-1][k:]))
        k *= 2
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    for i in np.unique(level).tolist():
        own = level == i
        out[own] = np.minimum(table[i][lo[own]], table[i][hi[own] - (1 << i)])
    return out


def longest(ids: np.ndarray, places: np.ndarray, pat: Patterns, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places where whole windows stand, the words of the longest verbatim match with an item and that item: of as long ones, the first by name.

    `found` are the windows that stand there. Text and items are ranked together; a place's longest matches stand beside
    it in the order of all suffixes, so no place meets every occurrence.
    """
    _, which = pat.occurrences(found)
    items = np.unique(pat.of[which])
    stops = np.flatnonzero(ids == 0)
    runs = np.unique(np.searchsorted(stops, places))
    begins = np.where(runs > 0, stops[runs - 1] + 1, 0)
    moved_text = np.concatenate(([0], np.cumsum(stops[runs] + 1 - begins)))
    moved_item = moved_text[-1] + np.concatenate(([0], np.cumsum(pat.ends[items] + 1 - pat.starts[items])))
    both = np.concatenate([*(ids[a : b + 1] for a, b in zip(begins.tolist(), stops[runs].tolist(), strict=True)), *(pat.ids[a : b + 1] for a, b in zip(pat.starts[items].tolist(), pat.ends[items].tolist(), strict=True))])
    run = np.searchsorted(begins, places, "right") - 1
    here = moved_text[run] + places - begins[run]
    own = np.searchsorted(items, pat.of[which])
    there = moved_item[own] + pat.at[which] - pat.starts[pat.of[which]]
    x = Prefixes(both, int((pat.ends[items] - pat.starts[items]).max()))
    order = np.argsort(x.levels[-1][there], kind="stable")
    there, name = there[order], pat.rank[pat.of[which]][order]
    spot = np.searchsorted(x.levels[-1][there], x.levels[-1][here])
    words_ = np.zeros(len(here), np.int64)
    for near in (spot - 1, spot):
        some = np.flatnonzero((near >= 0) & (near < len(there)))
        words_[some] = np.maximum(words_[some], x.common(here[some], there[near[some]]))
    # The places in order that share as many words with it stand together around its own spot.
    edge = []
    for side in (-1, 1):
        inner, outer = np.where(side < 0, spot, spot - 1), np.full(len(here), -1 if side < 0 else len(there))
        while True:
            live = np.flatnonzero(np.abs(outer - inner) > 1)
            if not len(live):
                break
            mid = (inner[live] + outer[live]) // 2
            good = x.common(here[live], there[mid]) >= words_[live]
            inner[live], outer[live] = np.where(good, mid, inner[live]), np.where(good, outer[live], mid)
        edge.append(inner)
    first = least_between(name, edge[0], edge[1] + 1)
    return words_, np.argsort(pat.rank)[first]


def search(texts: list[bytes], pat: Patterns) -> dict:
    """Matches of the benchmark in one shard of texts.

    n_words per text; pairs (of_text, item) of items found; and for each place (text, at) where a window is found the
    length of the longest verbatim match that starts there and its item (with). Each distinct window is an interval of the
    suffix array, and intervals of one length meet nowhere, so work grows with texts and windows, not with their pairs.
    """
    get = pat.vocabulary.get
    parts, starts, n_words = [], [], []
    at = 0
    for t in texts:
        own = words(t)
        starts.append(at)
        n_words.append(len(own))
        parts.append(np.fromiter((get(w, 0) for w in own), np.int32, len(own)))
        parts.append(np.zeros(1, np.int32))
        at += len(own) + 1
    ids, starts = np.concatenate([*parts, np.zeros(1, np.int32)]), np.array(starts, np.int64)
    none = np.zeros(0, np.int64)
    found = {"n_words": np.array(n_words, np.int64), "of_text": none, "item": none, "text": none, "at": none, "length": none, "with": none}
    # Only runs of benchmark words as long as the shortest window can hold a match, so only their suffixes are sorted.
    stops = np.flatnonzero(ids == 0)
    begins = np.concatenate(([0], stops[:-1] + 1))
    long = stops - begins >= max(1, pat.shortest)
    if not len(pat.first) or not long.any():
        return found
    sizes = (stops - begins)[long]
    places = np.repeat(begins[long] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    sa = suffix_array(ids, places, pat.window)
    there = np.zeros(len(pat.vocabulary) + 1, bool)
    there[ids[places]] = True
    which = np.flatnonzero(there[pat.ids[pat.first]])
    low = bounds(ids, sa, pat, which, pat.need[which], False)
    n = bounds(ids, sa, pat, which, pat.need[which], True) - low
    which, low, n = which[n > 0], low[n > 0], n[n > 0]
    if not len(which):
        return found
    window = np.repeat(np.arange(len(which)), n)
    where = sa[low[window] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    text = np.searchsorted(starts, where, "right") - 1
    # Items of a text: of each window that it has, once.
    pair = np.unique(text * len(which) + window)
    items = [np.zeros((2, 0), np.int64)]
    for t, own in _by(pair // len(which), pair % len(which)):
        _, occurrence = pat.occurrences(which[own])
        some = np.unique(pat.of[occurrence])
        items.append(np.stack((np.full(len(some), t), some)))
    found["of_text"], found["item"] = np.concatenate(items, axis=1)
    # A window shorter than others is a whole item, and its match is as long.
    whole = pat.need[which[window]] == pat.window
    name = least_between(pat.rank[pat.of], pat.since[which], pat.since[which + 1])
    length, with_ = pat.need[which[window]], np.argsort(pat.rank)[name[window]]
    if whole.any():
        length[whole], with_[whole] = longest(ids, where[whole], pat, which[pat.need[which] == pat.window])
    order = np.lexsort((pat.rank[with_], -length, where))
    order = order[np.concatenate(([True], np.diff(where[order]) != 0))]
    found |= {"text": text[order], "at": (where - starts[text])[order], "length": length[order], "with": with_[order]}
    return found


def _by(key: np.ndarray, value: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Values of each key; keys are in order."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else [0]
    for a, b in zip(edge, edge[1:], strict=False):
        yield int(key[a]), value[a:b]


def item_blocks(items: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about `most` bytes, by hash of their id, one block on the driver at a time."""
    total = items.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))))).first()[0] or 0
    n = -(-total // most) or 1
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    for k in range(n):
        yield [(name, text.encode()) for name, text in own.filter(F.pmod(F.xxhash64("name"), F.lit(n)) == k).collect()]


_MATCH = pa.list_(pa.struct([("at", pa.int64()), ("item_id", pa.string()), ("length", pa.int64())]))
_NEW = "n_words long, n_hit long, item_ids array<string>, matches array<struct<at:bigint,item_id:string,length:bigint>>, contaminated boolean"


class Findings:
    """What has been found in some texts, over blocks of the benchmark: words hit, items, and the longest match of each place."""

    def __init__(self, texts: int):
        self.n_words = np.zeros(texts, np.int64)
        self.items: list[set[str]] = [set() for _ in range(texts)]
        #: place -> (length, item), per text with any
        self.longest: dict[int, dict[int, tuple[int, str]]] = {}

    def add(self, found: dict, pat: Patterns, first: int) -> None:
        """Findings of a shard whose first text is number `first`."""
        self.n_words[first : first + len(found["n_words"])] = found["n_words"]
        for t, i in zip(found["of_text"].tolist(), found["item"].tolist(), strict=True):
            self.items[first + t].add(pat.names[i])
        for t, p, i, n in zip(*(found[c].tolist() for c in ("text", "at", "with", "length")), strict=True):
            own = self.longest.setdefault(first + t, {})
            old = own.get(p)
            if old is None or (-n, pat.names[i]) < (-old[0], old[1]):
                own[p] = (n, pat.names[i])

    def matches(self, t: int) -> list[dict]:
        return [{"at": p, "item_id": name, "length": n} for p, (n, name) in sorted(self.longest.get(t, {}).items())]

    def hit(self, t: int) -> int:
        """Words that lie in any match."""
        total = end = 0
        for p, (n, _) in sorted(self.longest.get(t, {}).items()):
            total += max(0, p + n - max(end, p))
            end = max(end, p + n)
        return total


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, item_ids (sorted), matches and contaminated; columns of docs with these names give way.

    A match is a place (word number) where a window of an item starts in the text, with the longest verbatim match there
    and its item (of as long ones, the first by name). Null and empty texts have no words; null and empty items are no
    windows; items that share an id count as one; a null item id reads `null`; rows that repeat are judged alike. Empty
    tables give no rows, or no hits. Documents are read once: a benchmark of more than block_bytes is searched block
    after block for some ROUND_BYTES of documents at a time, so a task holds one block's patterns.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("n_words", "n_hit", "item_ids", "matches", "contaminated")]
    src = docs.select(*keep)
    schema = T.StructType([*src.schema.fields, *T.StructType.fromDDL(_NEW).fields])
    blocks = [spark.sparkContext.broadcast(b) for b in item_blocks(items.select("item_id", "text"), block_bytes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = Patterns(blocks[0].value, window) if len(blocks) == 1 else None
        for held in _rounds(batches, ROUND_BYTES if only is None else 1):
            texts = [common.texts_of(b, text) for b in held]
            found = [Findings(len(t)) for t in texts]
            for block in blocks:
                pat = only or Patterns(block.value, window)
                if only is None:
                    vars(block).pop("_value", None)  # the next block takes its place in memory
                for own, some in zip(found, texts, strict=True):
                    for a, b in common.pieces([len(t) for t in some], SHARD_BYTES):
                        own.add(search(some[a:b], pat), pat, a)
            for batch, own in zip(held, found, strict=True):
                every = range(batch.num_rows)
                hit = [own.hit(t) for t in every]
                yield common.with_columns(
                    batch, keep, n_words=pa.array(own.n_words), n_hit=pa.array(hit, pa.int64()), item_ids=pa.array([sorted(own.items[t]) for t in every], pa.list_(pa.string())),
                    matches=pa.array([own.matches(t) for t in every], _MATCH), contaminated=pa.array([h > 0 for h in hit], pa.bool_()),
                )

    return map_arrow(src, run, schema)


def _rounds(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches that add up to about `most` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS window_text
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS window_text
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.window_text = bw.window_text),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id COLLATE "binary") AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

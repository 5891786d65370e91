"""Removal of passages that an earlier document has, located by sharded Aho-Corasick automata.

A window of 50 words has a trigger, the place of the least hash among its first SPAN places, which depends on its words
alone. Windows that share a trigger make up a phrase, and all of them hold the words from the trigger on, its anchor: so a
passage of two documents shows as an anchor that both have. Such anchors are confirmed: where all documents have the same
phrase around one, the phrase recurs whole; where phrases differ, their windows are told apart one by one.

What is confirmed goes, one row for each bucket of documents that has it, with the least id that has it. A bucket compiles
its passages - phrases that recur whole, and of others the runs of windows that do - into automata of bounded size and
streams its documents through them; every occurrence found in a document of a larger id goes. Words are compared there;
before, 128 bits of digests are.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import map_arrow, prepare
from . import common
from .suffix_dedup import _NULL, _mix, _placed

WINDOW = 50
#: Places among which a window's trigger is chosen, a power of two, and the words of the hash that chooses.
SPAN, GRAM = 32, 4
#: Words of a text that are parsed at once; a longer one is cut into segments that overlap by WINDOW - 1 words.
SEGMENT = 1 << 18
#: Words of the passages that one automaton holds.
AUTOMATON_WORDS = 200_000
#: Bytes of text that a task of a shuffle, and a bucket of texts, are sized for.
TASK_BYTES, BUCKET_BYTES = 64 << 20, 8 << 20

_PLACE = np.uint64((1 << 28) - 1)


def phrases(words: list[bytes], window: int = WINDOW, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Phrases of a text: first window, number of windows, names of anchor and phrase."""
    none = np.zeros(0, np.int64)
    parts: list[tuple[np.ndarray, ...]] = []
    for i in range(0, len(words) - window + 1, SEGMENT):
        own = words[i : i + SEGMENT + window - 1]
        first, *rest = _segment(own, window, span, gram)
        parts.append((first + i, *rest))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none, none, none, none)


def _segment(words: list[bytes], window: int, span: int, gram: int) -> tuple[np.ndarray, ...]:
    n = len(words)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    key = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        key = _mix(key ^ h[k : n - gram + 1 + k])
    key = key & ~_PLACE | (_PLACE - np.arange(len(key), dtype=np.uint64))
    step = 1
    while step < span:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    trigger = (_PLACE - (key[: n - window + 1] & _PLACE)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], trigger[1:] != trigger[:-1])))
    count = np.diff(np.append(first, len(trigger)))
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    at = trigger[first]
    name = lambda a, b: np.array([xxhash.xxh3_64_intdigest(joined[x:y]) for x, y in zip(start[a].tolist(), end[b - 1].tolist(), strict=True)], np.uint64).view(np.int64)
    return first, count, name(at, at + window - span + 1), name(first, first + count + window - 1)


def windows(words: list[bytes], first: int, count: int, window: int = WINDOW) -> list[bytes]:
    """Digests of 128 bits of windows first to first + count - 1."""
    return [xxhash.xxh3_128_digest(b" ".join(words[i : i + window])) for i in range(first, first + count)]


class Automata:
    """Passages (words, number of windows, least id that has it) in Aho-Corasick automata, each of bounded size.

    A word is two characters, so that no node has many children: its number's upper part, from U+0100 on, and its last
    byte; the two ranges do not meet, so no match begins inside a word. Words of no passage are number 0.
    """

    def __init__(self, passages: list[tuple[list[bytes], int]], most: int = AUTOMATON_WORDS):
        self.parts: list[tuple[dict[bytes, int], ahocorasick.Automaton, list[tuple[int, int]], int]] = []
        held, size = [], 0
        for p in passages:
            held.append(p)
            size += len(p[0])
            if size >= most:
                self._compile(held)
                held, size = [], 0
        if held:
            self._compile(held)

    def _compile(self, passages: list[tuple[list[bytes], int]]) -> None:
        number: dict[bytes, int] = {}
        automaton, values, known = ahocorasick.Automaton(ahocorasick.STORE_INTS), [], {}
        for own, least in passages:
            key = self._written([number.setdefault(w, len(number) + 1) for w in own])
            k = known.setdefault(key, len(values))
            if k == len(values):
                values.append((len(own), least))
                automaton.add_word(key, k)
            else:
                values[k] = (len(own), min(least, values[k][1]))
        automaton.make_automaton()
        self.parts.append((number, automaton, values, min(n for n, _ in values)))

    @staticmethod
    def _written(numbers: list[int] | np.ndarray) -> str:
        x = np.array(numbers, np.uint32)
        out = np.empty(2 * len(x), "<u4")
        out[0::2], out[1::2] = 0x100 + (x >> 8), x & 255
        return out.tobytes().decode("utf-32-le")

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(first word, word after the last, least id) of every occurrence of every passage.

        Only runs of words of passages as long as the shortest of these can hold one, so only they go through an automaton.
        """
        for number, automaton, values, shortest in self.parts:
            get = number.get
            ids = np.fromiter((get(w, 0) for w in words), np.uint32, len(words))
            edge = np.concatenate(([-1], np.flatnonzero(ids == 0), [len(ids)]))
            for i in np.flatnonzero(np.diff(edge) > shortest).tolist():
                first = int(edge[i]) + 1
                for last, k in automaton.iter(self._written(ids[first : edge[i + 1]])):
                    n, least = values[k]
                    end = first + last // 2 + 1
                    yield end - n, end, least


_PHRASES = "anchor long, phrase long, bucket int, doc long, at long, n int"
_WINDOWS = "key binary, bucket int, doc long, phrase_at long, at long, low long, high long"
_RESULT = "doc long, n_words long, spans array<struct<start:long,end:long>>, n_removed long, kept string"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _parse_batches(batches: Iterator[pa.RecordBatch], options: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, bases, buckets = (batch.column(i).to_pylist() for i in (0, 1, 2))
        for a, b, texts in common.text_runs(batch, "text", 1 << 20):
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for doc, base, bucket, text in zip(docs[a:b], bases[a:b], buckets[a:b], texts, strict=True):
                first, n, anchor, phrase = phrases(text.encode().split(), *options)
                whole = lambda x, k=len(first): np.full(k, x, np.int64)
                for to, x in zip(out, (anchor, phrase, whole(bucket), whole(doc), first + base, n), strict=True):
                    to.append(x)
            anchor, phrase, bucket, doc, at, n = (np.concatenate(x) for x in out)
            yield pa.RecordBatch.from_pydict({"anchor": anchor, "phrase": phrase, "bucket": bucket.astype(np.int32), "doc": doc, "at": at, "n": n.astype(np.int32)})


def _texts(texts: pa.Table) -> dict[tuple[int, int], list[bytes]]:
    """Words of each row (doc, base) of a bucket. Equal rows are one here; an empty text, which shares its base with the next row of its id, is none."""
    rows = zip(texts.column("doc").to_pylist(), texts.column("base").to_pylist(), texts.column("text").cast(pa.binary()).to_pylist(), strict=True)
    return {(doc, base): t.split() for doc, base, t in rows if t}


def _sources(texts: dict[tuple[int, int], list[bytes]], doc: np.ndarray, at: np.ndarray) -> Iterator[tuple[list[bytes], int]]:
    """The words, and the place in them, of each (doc, at) of a bucket."""
    bases: dict[int, list[int]] = {}
    for d, base in sorted(texts):
        bases.setdefault(d, []).append(base)
    for d, p in zip(doc.tolist(), at.tolist(), strict=True):
        own = bases[d]
        base = own[0] if len(own) == 1 else own[np.searchsorted(own, p, "right") - 1]
        yield texts[d, base], p - base


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _tell_apart(texts: pa.Table, asked: pa.Table, window: int) -> pa.Table:
    """The windows of phrases that differ around their anchor, each with the least and largest id that has its phrase in the bucket."""
    if not asked.num_rows:
        asked = asked.slice(0, 0)
    bucket, doc, at, n, low, high = _columns(asked, "bucket", "doc", "at", "n", "low", "high")
    keys = [k for (words, p), count in zip(_sources(_texts(texts), doc, at), n.tolist(), strict=True) for k in windows(words, p, count, window)] if len(n) else []
    each = lambda x, t: pa.array(np.repeat(x, n), t)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at, n)
    return pa.Table.from_pydict({"key": pa.array(keys, pa.binary()), "bucket": each(bucket, pa.int32()), "doc": each(doc, pa.int64()), "phrase_at": each(at, pa.int64()), "at": pa.array(place, pa.int64()), "low": each(low, pa.int64()), "high": each(high, pa.int64())})


def _runs(passages: pa.Table) -> tuple[np.ndarray, ...]:
    """(doc, at, n, least) of passages, windows of one phrase that follow each other with one least id joined."""
    doc, phrase, at, n, least = (x.astype(np.int64) for x in _columns(passages, "doc", "phrase_at", "at", "n", "least"))
    order = np.lexsort((at, phrase, doc))
    doc, phrase, at, n, least = (x[order] for x in (doc, phrase, at, n, least))
    new = np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(phrase) != 0) | (at[1:] != at[:-1] + n[:-1]) | (np.diff(least) != 0)))
    first = np.flatnonzero(new)
    return doc[first], at[first], np.add.reduceat(n, first), least[first]


def _remove(texts: pa.Table, passages: pa.Table, window: int) -> pa.Table:
    """Per row: words that occurrences of passages of smaller ids cover, and what is left."""
    found = []
    if passages.num_rows:
        doc, at, n, least = _runs(passages)
        found = [(words[p : p + k + window - 1], i) for (words, p), k, i in zip(_sources(_texts(texts), doc, at), n.tolist(), least.tolist(), strict=True)]
    automata = Automata(found)
    out = []
    for doc, text in zip(texts.column("doc").to_pylist(), texts.column("text").cast(pa.binary()).to_pylist(), strict=True):
        words = text.split()
        edge = np.zeros(len(words) + 1, np.int64)
        for a, b, least in automata.find(words):
            if least < doc:
                edge[a] += 1
                edge[b] -= 1
        gone = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
        turns = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2).tolist()
        kept, at = [], 0
        for a, b in turns:
            kept += words[at:a]
            at = b
        kept += words[at:]
        out.append((doc, len(words), [{"start": a, "end": b} for a, b in turns], sum(b - a for a, b in turns), b" ".join(kept)))
    doc, n, spans, removed, kept = list(zip(*out, strict=True)) or [[]] * 5
    return pa.Table.from_pydict({"doc": pa.array(doc, pa.int64()), "n_words": pa.array(n, pa.int64()), "spans": pa.array(spans, _SPANS), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, n_words, spans (ranges of words removed), n_removed, kept (the other words, joined by a space).

    A word goes if `window` words in a row that hold it also stand in a document of a smaller id. Null ids are the
    smallest, and rows that share an id, or have none, take nothing from each other. Null and empty texts have no words; a
    table without rows gives none; other columns are not carried, so none can clash. gram + span - 1 may be `window` at most.
    """
    if gram + span - 1 > window or span & (span - 1):
        raise ValueError("span is a power of two, and gram + span - 1 at most window")
    spark = docs.sparkSession
    prepare(spark)
    scratch = common.Scratch(spark)
    rows, _ = _placed(scratch, common.hidden(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    buckets = parts * max(2, -(-size // (parts * BUCKET_BYTES)))
    rows = rows.select("doc", "base", F.pmod(F.xxhash64("doc", "base"), F.lit(buckets)).cast("int").alias("bucket"), "text")
    options = (window, span, gram)
    parsed = scratch.write(map_arrow(rows, lambda it: _parse_batches(it, options), _PHRASES), "phrases")
    # Anchors that several documents have. Each group is one row before it is shuffled, however many documents it has.
    anchors = parsed.groupBy("anchor").agg(F.min("doc").alias("least"), F.max("doc").alias("last"), (F.min("phrase") != F.max("phrase")).alias("several"), F.count(F.lit(1)).alias("rows"))
    anchors = scratch.write(anchors.filter("least < last").drop("last"), "anchors")
    shared = common.attach_counted(parsed, anchors, "anchor", "rows")
    source = F.struct("doc", "at", "n")
    in_bucket = shared.groupBy("bucket", "anchor", "phrase", "least", "several").agg(F.min(source).alias("source"), F.max("doc").alias("high"))
    in_bucket = scratch.write(in_bucket.select("bucket", "source.doc", "source.at", "source.n", "least", "several", "high"), "shared")
    scratch.drop("phrases")
    by_bucket = lambda df: common.by_bucket(df, parts)
    told = by_bucket(rows).cogroup(by_bucket(in_bucket.filter("several").select("bucket", "doc", "at", "n", F.col("doc").alias("low"), "high")))
    told = scratch.write(told.applyInArrow(lambda a, b: _tell_apart(a, b, window), _WINDOWS), "windows")
    seen = told.groupBy("key").agg(F.min("low").alias("least"), F.max("high").alias("last"), F.count(F.lit(1)).alias("rows"))
    seen = scratch.write(seen.filter("least < last").drop("last"), "seen")
    alone = common.attach_counted(told, seen, "key", "rows").select("bucket", "doc", "phrase_at", "at", F.lit(1).alias("n"), "least", "high")
    whole = in_bucket.filter("NOT several").select("bucket", "doc", F.col("at").alias("phrase_at"), "at", "n", "least", "high")
    passages = whole.union(alone).filter("high > least").drop("high")
    out = by_bucket(rows).cogroup(by_bucket(passages)).applyInArrow(lambda a, b: _remove(a, b, window), _RESULT)
    return out.select(F.when(F.col("doc") != _NULL, F.col("doc")).alias("doc_id"), "n_words", "spans", "n_removed", "kept")


def op11_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats(common.documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, i, md5_number(array_to_string(w[i : i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT k, min(doc_id) AS least FROM n GROUP BY k HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM n JOIN f ON n.k = f.k WHERE n.doc_id > f.least),
o AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
r AS (
  SELECT o.doc_id, count(*) AS n_words, count(c.p) AS n_removed, string_agg(CASE WHEN c.p IS NULL THEN o.word END, ' ' ORDER BY o.p) AS kept
  FROM o LEFT JOIN c ON o.doc_id = c.doc_id AND o.p = c.p GROUP BY o.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""

"""Token ids in binary blocks: one concatenated id array, with document boundaries in Elias-Fano form."""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import map_arrow
from . import common

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Ids in a block, about: a block is written when it has as many, and never splits a document.
BLOCK_IDS = 1 << 19
#: Distinct words, and distinct stretches between spaces, whose ids a worker remembers.
REMEMBERED = 300_000
#: Characters of what is remembered, at most.
LONGEST = 64
#: How the tokenizer's file states its words; a tokenizer with another rule gets whole texts.
_FIXED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

MAGIC = b"GLTK0002"
#: magic, documents, those of them with a null id, least id, ids of tokens, bytes of such an id; then, of the documents' ids
#: and of their ends, low bits of a number and bytes of the high bits
_HEAD = struct.Struct("<8sQQqQBBQBQ")


class EliasFano:
    """A list of n numbers that never falls, up to u, in about n * (2 + log2(u / n)) bits.

    The low bits stand packed; the high part of the i-th number is a one at place high + i of a bit array, so that select
    (place of the i-th one, less i) returns it. Opened, the list keeps its two strings of bits and the place of every
    512th one, from which select looks on: 8 bytes for 512 numbers, and no table of them.
    """

    STEP = 512
    #: Bytes of the high bits that are looked through at once.
    PIECE = 1 << 16

    def __init__(self, n: int, bits: int, low: bytes, high: bytes):
        self.n, self.bits = n, bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        places, seen = [], 0
        for at in range(0, len(self.high), self.PIECE):
            ones = np.flatnonzero(np.unpackbits(self.high[at : at + self.PIECE], bitorder="little"))
            places.append(ones[-seen % self.STEP :: self.STEP] + at * 8)
            seen += len(ones)
        self.samples = np.concatenate(places) if places else np.zeros(0, np.int64)

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        """From unsigned 64-bit numbers."""
        numbers = numbers.astype(np.uint64)
        n, most = len(numbers), int(numbers[-1]) if len(numbers) else 0
        bits = max(0, (most // max(n, 1)).bit_length() - 1)
        low = ((numbers[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel() if bits else np.zeros(0, np.uint8)
        ones = np.zeros((most >> bits) + n + 1, np.uint8)
        ones[(numbers >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, bits, np.packbits(low, bitorder="little").tobytes(), np.packbits(ones, bitorder="little").tobytes())

    def select(self, i: int, count: int = 1) -> np.ndarray:
        """Numbers i to i + count - 1, as unsigned 64-bit: the sample before the first gives the byte to look on from."""
        if not 0 <= i <= i + count <= self.n:
            raise IndexError(i)
        if not count:
            return np.zeros(0, np.uint64)
        first, beyond = i // self.STEP, (i + count - 1) // self.STEP + 1
        at = int(self.samples[first]) // 8
        stop = int(self.samples[beyond]) // 8 + 1 if beyond < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[at:stop], bitorder="little")) + at * 8
        skip = int(np.searchsorted(ones, self.samples[first])) + i - first * self.STEP
        out = (ones[skip : skip + count] - np.arange(i, i + count)).astype(np.uint64) << np.uint64(self.bits)
        if self.bits:
            a, b = i * self.bits, (i + count) * self.bits
            own = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].reshape(count, self.bits)
            out |= (own.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A block: head, Elias-Fano ids of the documents (ascending, nulls first) and ends of the documents, ids of tokens."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    names = EliasFano.of(np.array([d - least for d in known], np.uint64))
    ends = EliasFano.of(np.cumsum(lengths.astype(np.int64)))
    head = _HEAD.pack(MAGIC, len(doc_ids), len(doc_ids) - len(known), least, len(ids), width, names.bits, len(names.high), ends.bits, len(ends.high))
    return b"".join((head, names.low.tobytes(), names.high.tobytes(), ends.low.tobytes(), ends.high.tobytes(), ids.astype(f"<u{width}").tobytes()))


class Block:
    """Reads a block: ids of its documents and of their tokens, by select, without tables of ids or offsets."""

    def __init__(self, data: bytes):
        magic, self.n, self.nulls, self.least, self.n_ids, width, *shapes = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = _HEAD.size
        lists = []
        for n, bits, high in ((self.n - self.nulls, *shapes[:2]), (self.n, *shapes[2:])):
            low = (n * bits + 7) // 8
            lists.append(EliasFano(n, bits, data[at : at + low], data[at + low : at + low + high]))
            at += low + high
        self.names, self.ends = lists
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, at)

    def doc_ids(self, i: int, count: int) -> pa.Array:
        """Ids of documents i to i + count - 1."""
        nulls = max(0, min(self.nulls - i, count))
        some = (self.names.select(max(0, i - self.nulls), count - nulls) + np.uint64(self.least & (1 << 64) - 1)).view(np.int64)
        return pa.concat_arrays([pa.nulls(nulls, pa.int64()), pa.array(some, pa.int64())])

    def bounds(self, i: int, count: int) -> np.ndarray:
        """Where documents i to i + count - 1 start, and where the last of them ends."""
        before = self.ends.select(i - 1, 1) if i else np.zeros(1, np.uint64)
        return np.concatenate((before, self.ends.select(i, count))).astype(np.int64)

    def __getitem__(self, i: int) -> np.ndarray:
        a, b = self.bounds(i, 1).tolist()
        return self.ids[a:b]


def _plain(kind: str) -> str:
    """Characters below U+0250 of a Unicode category, as a class of a regular expression."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


@lru_cache(maxsize=None)
def _packer(n: int):
    return struct.Struct(f"<{n}I").pack


class _Memory(dict):
    """Results of a function, remembered until there are more than `most` at a trim."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def learn(self, key: str) -> bytes:
        found = self.make(key)
        if len(key) <= LONGEST:
            self[key] = found
        return found

    __missing__ = learn

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


class Encoder:
    """Ids as the library gives them for whole texts.

    The tokenizer drops white space, folds case character by character, and cuts a text into words by a pattern, beyond
    which no rule of it looks: a text's ids are those of its words, in order. So the library's model encodes each
    distinct word once, as long as it is remembered. Words are cut here by the same pattern where a stretch between
    spaces has plain Latin characters only, on which all Unicode versions and both engines agree; any other stretch, and
    one that may hold a special token, goes to the whole library as it is, as do all texts if the tokenizer's file
    states other rules.
    """

    _LETTER, _NUMBER = _plain("L"), _plain("N")
    _WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^ {_LETTER}{_NUMBER}]+")
    _ODD = re.compile(r"[^\t\n\r -~\u00a1-\u012f\u0131-\u024f]")

    def __init__(self, tokenizer_file: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(tokenizer_file)
        self.model = self.library.model
        self.words = _Memory(self._word, remembered)
        self.stretches = _Memory(self.stretch, remembered)
        #: Stretches of the texts at hand that only the whole library may encode.
        self.odd: set[str] = set()
        stated = self.library.to_str()
        self.own_words = _FIXED_PATTERN in stated and all(f'"type":"{kind}"' in stated for kind in ("NFC", "Lowercase", "ByteLevel", "BPE"))
        # How the model writes the bytes of a character; lower case may add U+0307 to a Latin letter.
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in (*range(0xA1, 0x250), 0x307)}

    def _odd(self, text: str) -> bool:
        return "<|" in text or self._ODD.search(text) is not None

    def _split(self, text: str) -> list[str]:
        """Stretches between spaces: folded where they are plain, else as they are, and noted as odd."""
        if not self.own_words:
            self.odd.add(text)
            return [text]
        if not self._odd(text):
            return text.lower().split()
        out = []
        for s in re.split("[ \t\n\r]+", text):
            if self._odd(s):
                self.odd.add(s)
                out.append(s)
            elif s:
                out.append(s.lower())
        return out

    def _word(self, word: str) -> bytes:
        tokens = self.model.tokenize(word if word.isascii() else word.translate(self.written))
        return _packer(len(tokens))(*[t.id for t in tokens])

    def stretch(self, s: str) -> bytes:
        """Ids of a stretch that is not remembered."""
        if s in self.odd:
            ids = self.library.encode(s, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        words = self.words
        if s.isalpha():
            return words.get(s) or words.learn(s)
        # Most other stretches are letters and one mark; the pattern cuts the rest.
        own = [s[:-1], s[-1]] if s[-1] in ".,!" and s[:-1].isalpha() else self._WORDS.findall(s)
        return b"".join([words.get(w) or words.learn(w) for w in own])

    def encode(self, texts: list[str], end_id: int | None = END_ID) -> list[bytes]:
        """Per text its ids as little-endian 32-bit numbers, and end_id after them."""
        self.odd.clear()
        self.stretches.trim()
        self.words.trim()
        end = b"" if end_id is None else struct.pack("<I", end_id)
        find = self.stretches.__getitem__
        return [b"".join(map(find, self._split(t))) + end for t in texts]


@lru_cache(maxsize=1)
def encoder(tokenizer_file: str) -> Encoder:
    return Encoder(tokenizer_file)


_BLOCKS = "partition int, block int, first_id long, n_docs long, n_ids long, payload binary"
_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer_file: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of all texts to `path` in ascending doc_id order (null first, ties by text), end_id after each.

    Ranges of ids are partitions; a partition is a run of blocks of about block_ids ids, each a row with its binary
    payload, so that any store Spark can write to will do, and a lost task is written again whole. Null texts are empty.
    A text longer than a block is a block of its own. An empty table writes no blocks.
    """
    rows = common.hidden(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")
    # Rows of one id, or of none, are dealt by how their texts begin, so a hot id is no single task's.
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 32).asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_file:
            path_ = tokenizer_file
        else:
            import public_tokenizers

            path_ = public_tokenizers.path(TOKENIZER)
        own = encoder(path_)
        part, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, bytes]] = []
        held_ids = 0

        def out() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            data = pack([d for d, _ in held], np.array([len(x) // 4 for _, x in held], np.int64), ids)
            return pa.RecordBatch.from_pydict({"partition": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "first_id": pa.array([first], pa.int64()), "n_docs": pa.array([len(held)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "payload": pa.array([data], pa.binary())})

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b, texts in common.text_runs(batch, "text", 1 << 20):
                for d, x in zip(keys[a:b], own.encode(texts, end_id), strict=True):
                    held.append((d, x))
                    held_ids += len(x) // 4
                    if held_ids >= block_ids:
                        yield out()
                        block, first, held, held_ids = block + 1, first + held_ids, [], 0
        if held:
            yield out()

    map_arrow(rows, run, _BLOCKS).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A block knows its start in its partition; the partitions' totals, one row each, give the rest.
    """
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    totals = sorted(tuple(r) for r in blocks.groupBy("partition").agg(F.sum("n_ids")).collect())
    base, at = {}, 0
    for part, n in totals:
        base[part] = at
        at += n
    bases = spark.sparkContext.broadcast(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                b = Block(data)
                for i in range(0, b.n, EliasFano.STEP):
                    n = min(EliasFano.STEP, b.n - i)
                    at = b.bounds(i, n)
                    crc = [zlib.crc32(b.ids[x:y].astype("<u4")) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": b.doc_ids(i, n), "start": pa.array(at[:-1] + (bases.value[part] + first)), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(crc, pa.int64())})

    return map_arrow(blocks.select("partition", "first_id", "payload"), run, _DOCS)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes docs to a scratch table of blocks and reads it back."""
    scratch = common.Scratch(docs.sparkSession)
    path = scratch.path("blocks")
    write(docs, path, **options)
    return read(docs.sparkSession, path)


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.documents(spark, sf_dir, "doc_id", "text"))

"""Token counts, with overlap resynchronisation for huge documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.shipping import map_arrow
from . import common

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Characters from which a document is encoded in chunks; a chunk's length and the first overlap of two chunks.
HUGE, CHUNK, OVERLAP = 32_768, 16_384, 256
#: Bytes of texts that are encoded in one call.
CALL_BYTES = 1 << 20
#: How the model writes a space.
SPACE = "▁"


class Counter:
    """Counts as the library encodes whole texts.

    A chunk may be cut and spliced only where no piece of the vocabulary holds the two characters beside the cut next to
    each other: the library makes tokens by joining neighbours into longer pieces, so no token of any text crosses such
    a place. That proof needs a model that neither rewrites its input nor splits it by rules of its own; others are
    encoded whole.
    """

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        with open(model_file, "rb") as f:
            m = pb.ModelProto.FromString(f.read())
        spec, kinds = m.normalizer_spec, pb.ModelProto.SentencePiece
        self.width = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in m.pieces], np.int64)
        ordinary = [p.piece for p in m.pieces if p.type not in (kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN)]
        self.joined = {a + b for p in ordinary for a, b in zip(p, p[1:], strict=False)}
        inside = {c for pair in self.joined for c in pair}
        # A chunk that is not the first starts with a character that joins with nothing, so the space which the library puts before a text stays apart.
        self.guard = next((g for g in "\n\x01\x02" if g not in inside), "")
        plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix and spec.escape_whitespaces
        self.splits = bool(plain and self.guard and m.trainer_spec.byte_fallback and m.trainer_spec.model_type == pb.TrainerSpec.BPE and not any(p.type == kinds.USER_DEFINED for p in m.pieces))
        self.guard_tokens = len(self.sp.encode(self.guard)) if self.guard else 0

    def ends(self, text: str, first: bool) -> np.ndarray:
        """Where the tokens of a chunk end, in bytes of its text as the model writes it."""
        ids = self.sp.encode(text if first else self.guard + text)
        ids = ids if first else ids[self.guard_tokens :]
        ends = np.cumsum(self.width[np.array(ids, np.int64)]) if ids else np.zeros(0, np.int64)
        return ends - len(SPACE.encode()) if first else ends

    def stable(self, text: str, at: int) -> bool:
        """No token of any text that goes on like this crosses the place before character `at`."""
        return text[at - 1] + text[at] not in self.joined

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a huge text: chunks overlap, and are spliced where both have a token boundary at a stable place."""
        if not self.splits:
            return len(self.sp.encode(text))
        text = text.replace(" ", SPACE)
        total = 0
        start, left = 0, None  # where the current chunk starts, and its tokens' ends (None: not encoded)
        size, over = chunk, overlap
        counted = 0  # tokens of the current chunk before its splice with the one before it
        while True:
            stop = min(len(text), start + size)
            left = self.ends(text[start:stop], start == 0) if left is None else left
            if stop == len(text):
                return total + len(left) - counted
            at = stop - over
            right = self.ends(text[at : min(len(text), at + chunk)], False)
            splice = next((c for c in range(at + over // 2, stop) if self.stable(text, c)), None) or next((c for c in range(at + 1, at + over // 2) if self.stable(text, c)), None)
            if splice is not None:
                a = len(text[start:splice].encode())
                b = len(text[at:splice].encode())
                i, j = np.searchsorted(left, a), np.searchsorted(right, b)
                if i < len(left) and left[i] == a and j < len(right) and right[j] == b:
                    total += int(i) + 1 - counted
                    counted, start, left, size, over = int(j) + 1, at, right, chunk, overlap
                    continue
            # No place where both agree for certain: widen the overlap, and the chunk once the overlap fills half of it.
            over *= 2
            if over * 2 > size:
                size *= 2
                left = None

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        small = []
        for i, t in enumerate(texts):
            if len(t) >= HUGE:
                out[i] = self.count(t)
            else:
                small.append(i)
        for i, ids in zip(small, self.sp.encode([texts[i] for i in small], num_threads=1), strict=True):
            out[i] = len(ids)
        return out


@lru_cache(maxsize=2)
def counter(model_file: str) -> Counter:
    return Counter(model_file)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, text: str = "text", model_file: str | None = None, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit; columns of docs with these names give way.

    Null and empty texts have no tokens; ids are not read, and rows that repeat are counted each. A text of just `limit`
    tokens is not over it. An empty table gives no rows. A text of any length is counted as the library encodes it whole,
    without begin or end tokens; memory is bounded by a text and its chunks. Without model_file each worker takes its own copy of the
    public model.
    """
    keep = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    src = docs.select(*keep)
    schema = T.StructType([*src.schema.fields, *T.StructType.fromDDL("n_bytes long, n_tokens long, over_limit boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_file or model_path())
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            n = [x for a, b in common.pieces(sizes, CALL_BYTES) for x in own.counts(texts[a:b])]
            yield common.with_columns(batch, keep, n_bytes=pa.array(sizes, pa.int64()), n_tokens=pa.array(n, pa.int64()), over_limit=pa.array([x > limit for x in n], pa.bool_()))

    return map_arrow(src, run, schema)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.documents(spark, sf_dir, "doc_id", "text")).drop("text")

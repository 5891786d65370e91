"""Text chunks: paragraphs packed to a size, long paragraphs cut at sentences, and fixed windows."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import prepare
from ..functions.text import blank, language, strip

SIZE, OVERLAP = 1000, 200
_SENTENCE_END = re.compile("[.!?。！？]")


def _joined(held: str, parts: list[str], at: int, ends: list[int], glue: str, size: int) -> tuple[str, int]:
    """held and the parts from `at` on that still fit beside it, and the number of the first that doesn't.

    A part fits if it and what is held so far have `size` characters at most; ends are sums of the parts' lengths with their
    glue, so the place is found by halving.
    """
    stop = bisect_right(ends, size + len(glue) - len(held) + ends[at], lo=at) - 1
    return glue.join([held, *parts[at:stop]]), max(stop, at)


def _ends(parts: list[str], glue: str) -> list[int]:
    return list(accumulate((len(p) + len(glue) for p in parts), initial=0))


def _sentence_pieces(paragraph: str, size: int) -> list[str]:
    """Sentences packed to `size` characters, joined by an ideographic full stop; a first sentence that is longer is cut once."""
    parts = [s for s in map(str.strip, _SENTENCE_END.split(paragraph)) if s]
    if not parts:
        return []
    out = [parts[0][:size]] if len(parts[0]) > size else []
    held, at, ends = parts[0][size if out else 0 :], 1, _ends(parts, "。")
    while True:
        held, at = _joined(held, parts, at, ends, "。", size)
        out.append(held.strip())
        if at == len(parts):
            return out
        held, at = parts[at], at + 1


def _paragraph_chunks(text: str, size: int, overlap: int) -> list[str]:
    parts = [p for p in map(str.strip, text.split("\n\n")) if p]
    ends, out, held, at = _ends(parts, "\n\n"), [], "", 0
    while at < len(parts):
        if not held:
            *done, held = (_sentence_pieces(parts[at], size) or [""]) if len(parts[at]) > size else [parts[at]]
            out += done
            at += 1
            continue
        held, at = _joined(held, parts, at, ends, "\n\n", size)
        if at < len(parts):
            out.append(held.strip())
            held = (held[-overlap:] + "\n" if 0 < overlap < len(held) else "") + parts[at]
            at += 1
    return out + [held.strip()] * bool(held.strip())


def paragraph_chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Paragraphs (between empty lines) packed to `size`; a paragraph that is longer is packed by sentences, if it starts a
    chunk; after a full chunk its last `overlap` characters come again.

    In Arrow batches, as a fold in SQL copies all chunks so far at each step: here time is linear in a text.
    """
    prepare(SparkSession.active())

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _paragraph_chunks(t, size, overlap) for t in texts], dtype=object)

    return chunks(text)


def fixed_windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda s: strip(F.substring(text, s + 1, F.lit(size)))), lambda c: c != "")


def chunk_records(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Text chunks of pages (file_id, page_number, text), with their metadata; blank pages have none."""
    rows = pages.filter(~blank(F.col("text"))).select("file_id", "page_number", F.posexplode(paragraph_chunks(F.col("text"), size, overlap)).alias("chunk_index", "content"))
    return rows.select(
        F.concat_ws("_", "file_id", F.lit("page"), "page_number", F.lit("text"), "chunk_index").alias("chunk_id"), "file_id", F.lit("text").alias("content_type"), "content", "page_number", "chunk_index",
        F.struct(F.col("page_number").alias("page"), F.lit("text").alias("type"), F.length("content").alias("length"), language(F.col("content")).alias("language")).alias("metadata"),
    )


def parse_chunk_id(chunk_id: Column, file_id: Column) -> dict[str, Column]:
    """Page, type and index of a chunk id; the file id may itself hold underscores."""
    parts = F.split(F.substring(chunk_id, F.length(file_id) + F.length(F.lit("_page_")) + 1, F.length(chunk_id)), "_")
    return {"page_number": F.get(parts, F.lit(0)).try_cast("int"), "content_type": F.get(parts, F.lit(1)), "chunk_index": F.get(parts, F.lit(2)).try_cast("int")}

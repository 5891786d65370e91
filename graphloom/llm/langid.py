"""Language identification: cosine to several clustered centroids per language, with rejection by distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import map_arrow
from . import common

#: Hash buckets of n-grams.
DIMS = 4096
#: Learnt rows per language that the centroids are fitted on, whole, and over all languages; and bytes of their texts over
#: all languages, beyond which fewer rows are taken (one per language at least). Document frequencies count all learnt rows.
FIT_ROWS, ALL_FIT_ROWS, ALL_FIT_BYTES = 700, 10_000, 32 << 20
CENTROIDS = 4
STEPS = 12
#: Languages whose centroids (64 KB each) go to a task at once; more go block after block, with the same results.
BLOCK_LANGUAGES = 500
#: A document is rejected if its cosine is below a floor for its language and length. This share of the language's fitted
#: rows, cut to that length, falls under `own`; this share of other languages' rows exceeds `other`. Where these lie apart
#: the floor is below `own` by REJECT_GAP of the way to `other`, else it is `own`.
REJECT_SHARE, REJECT_GAP = 0.005, 0.25
#: Characters that fitted rows are cut to: five, and twice as many each time, while so many rows of a language are as long.
LEAST_CUT, LEAST_CUT_ROWS = 5, 20
#: Sharpness of the score.
TEMPERATURE = 0.05
#: Bytes of text whose n-grams are held at once.
CALL_BYTES = 1 << 18

_MIX = np.uint32(2654435761)


_LETTER = np.zeros(0x110000, bool)
_ready = False


def _letters() -> np.ndarray:
    global _ready
    if not _ready:
        _LETTER[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        _ready = True
    return _LETTER


def _folded(codes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """`before` and codes after it, all but letters as one space."""
    c = np.concatenate((before, np.where(_letters()[codes], codes, np.uint32(32))))
    return c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]


def _buckets(c: np.ndarray, known: int) -> np.ndarray:
    """Hash buckets of the 2- and 3-grams of folded characters that end after the first `known`."""
    two = c[:-1] * np.uint32(0x10001) + c[1:] * np.uint32(0x3D4D51CB)
    three = two[:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)
    return np.concatenate((two[known - 1 :] * _MIX >> np.uint32(20), three[max(0, known - 2) :] * _MIX >> np.uint32(20))).astype(np.int64)


def counts(text: str, stretch: int = CALL_BYTES) -> np.ndarray | None:
    """Counts of a whole text's n-grams by hash bucket, stretch by stretch; None if it has no letters.

    Lower case; all but letters fold to one space, and a space stands at both ends. The last characters of a stretch go
    before the next, so the counts are those of the text as one.
    """
    out = np.zeros(DIMS, np.int64)
    low = text.lower()
    c = np.array([32], np.uint32)
    some = False
    for i in range(0, len(low) + 1, stretch):
        codes = np.frombuffer(low[i : i + stretch].encode("utf-32-le", "surrogatepass"), np.uint32)
        some = some or bool(_letters()[codes].any())
        if i + stretch > len(low):
            codes = np.append(codes, np.uint32(32))
        before = c[-2:]
        c = _folded(codes, before)
        out += np.bincount(_buckets(c, len(before)), minlength=DIMS)
    return out.astype(np.float32) if some else None


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


class Model:
    """Languages, their centroids, document frequencies' weights, and the cosine below which each rejects, by length."""

    def __init__(self, idf: np.ndarray, texts: dict[str, list[str]], centroids: int = CENTROIDS):
        self.idf = idf.astype(np.float32)
        self.languages = sorted(texts)
        parts, self.of = [], []
        for k, lang in enumerate(self.languages):
            x = self.vectors(np.stack([counts(t) for t in texts[lang]]))
            c = _cluster(x, centroids)
            parts.append(c)
            self.of += [k] * len(c)
        self.centres = np.concatenate(parts) if parts else np.zeros((0, DIMS), np.float32)
        self.of = np.array(self.of, np.int64)
        self.floors = self._floors(texts)

    def _floors(self, texts: dict[str, list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per language the floors, and the logs of the n-grams of a text that they hold for."""
        found: list[list[tuple[float, float]]] = [[] for _ in self.languages]
        cut = LEAST_CUT
        while any(sum(len(t) >= cut for t in x) >= LEAST_CUT_ROWS for x in texts.values()):
            self._floor(texts, cut, found)
            cut *= 2
        self._floor(texts, None, found)
        return [(np.array([x for x, _ in f]), np.array([y for _, y in f])) for f in found]

    def _floor(self, texts: dict[str, list[str]], cut: int | None, found: list[list[tuple[float, float]]]) -> None:
        """Adds the floors of texts cut to a length; without one, those of whole texts, where no cut had rows enough."""
        best, size, of = [], [], []
        for k, lang in enumerate(self.languages):
            if cut is None and found[k]:
                continue
            n = [c for t in texts[lang] if cut is None or len(t) >= cut if (c := counts(t[:cut])) is not None]
            if n:
                n = np.stack(n)
                best.append(self.cosines(n))
                size.append(np.log(n.sum(axis=1)))
                of.append(np.full(len(n), k))
        if not of:
            return
        best, size, of = np.concatenate(best), np.concatenate(size), np.concatenate(of)
        for k in range(len(self.languages)):
            if (of == k).sum() < (LEAST_CUT_ROWS if cut else 1):
                continue
            own = other = np.quantile(best[of == k, k], REJECT_SHARE)
            if (of != k).any():
                other = min(own, np.quantile(best[of != k, k], 1 - REJECT_SHARE))
            found[k].append((float(size[of == k].mean()), float(own - REJECT_GAP * (own - other))))

    def vectors(self, n: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(n) * self.idf)

    def cosines(self, n: np.ndarray) -> np.ndarray:
        """To the nearest centroid of each language, of rows of counts."""
        cos = self.vectors(n) @ self.centres.T
        best = np.full((len(n), len(self.languages)), -1.0)
        for k in range(len(self.languages)):
            best[:, k] = cos[:, self.of == k].max(axis=1)
        return best

    def blocks(self, most: int) -> list[Model]:
        """The model in parts of at most so many languages."""
        out = []
        for a in range(0, len(self.languages), most):
            part = object.__new__(Model)
            part.idf, part.languages, part.floors = self.idf, self.languages[a : a + most], self.floors[a : a + most]
            own = (self.of >= a) & (self.of < a + most)
            part.centres, part.of = self.centres[own], self.of[own] - a
            out.append(part)
        return out

    def predict(self, n: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cosine and rejection of rows of counts."""
        names, top, floor, weight = self.nearest(n)
        return names, 1 / weight, top, top < floor

    def nearest(self, n: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of rows of counts: the nearest language (the first of equals), its cosine, the floor it has to reach, and the
        weight of all languages, in which the nearest has 1.
        """
        best = self.cosines(n)
        at = best.argmax(axis=1)
        top = best[np.arange(len(n)), at]
        floor = np.array([np.interp(x, *self.floors[k]) for x, k in zip(np.log(n.sum(axis=1)), at, strict=True)])
        return [self.languages[k] for k in at], top, floor, np.exp((best - top[:, None]) / TEMPERATURE).sum(axis=1)


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts are rows far from those before, so it needs no random numbers."""
    first = int((x @ x.mean(axis=0)).argmax())
    centres = [x[first]]
    near = x @ x[first]
    while len(centres) < min(k, len(x)):
        far = int(near.argmin())
        if near[far] > 0.999:
            break
        centres.append(x[far])
        near = np.maximum(near, x @ x[far])
    c = np.stack(centres)
    for _ in range(STEPS):
        own = (x @ c.T).argmax(axis=1)
        c = _unit(np.stack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))]))
    # A centroid of a few stray rows would draw in whatever is odd in any language.
    own = (x @ c.T).argmax(axis=1)
    size = np.bincount(own, minlength=len(c))
    return c[size >= min(len(x) * 0.02, size.max())].astype(np.float32)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", fit_rows: int = FIT_ROWS) -> Model | None:
    """Learns from rows with a text with letters and a non-null lang; None if there are none.

    Document frequencies are counted over all rows, in vectors of DIMS numbers. Centroids are fitted on at most fit_rows
    rows per language (fewer if languages are many, or texts long), whole, those of least hash: a bounded sample. Rows
    that repeat teach as often as they are there; rows of equal hash are taken in the order of their texts.
    """
    rows = common.hidden(docs, text=text, lang=lang, order=order).filter("lang is not null and text is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                c = counts(t)
                if c is not None:
                    total += c > 0
                    n += 1
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(-1, DIMS), pa.int32()), "n": pa.array([n, *total.tolist()], pa.int64())})

    df = dict(map_arrow(rows.select("text"), frequencies, "k int, n long").groupBy("k").agg(F.sum("n")).collect())
    if not df.get(-1):
        return None
    idf = np.log((1 + df[-1]) / (1 + np.array([df[k] for k in range(DIMS)]))) + 1
    scratch = common.Scratch(docs.sparkSession)
    sizes = scratch.write(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "sizes")
    languages = max(1, sizes.count())
    fit_rows = max(20, min(fit_rows, ALL_FIT_ROWS // languages))
    # About twice the rows wanted, by hash, so the exact choice is of a bounded number of rows.
    key = F.xxhash64("order", "text")
    some = common.attach(rows.select("lang", "text", key.alias("key")), sizes, ["lang"], "inner", small_rows=languages)
    some = scratch.write(some.filter(F.pmod("key", F.lit(1 << 20)) < F.lit(2.0 * fit_rows) / F.col("n") * (1 << 20)).select("lang", "key", "text"), "sample")
    held: dict[str, list[int]] = {}
    took: dict[str, int] = {}
    for name, k, size in sorted(tuple(r) for r in some.select("lang", "key", F.octet_length("text")).collect()):
        own = held.setdefault(name, [])
        if len(own) < fit_rows and (not own or took[name] + size <= ALL_FIT_BYTES // languages):
            own.append(k)
            took[name] = took.get(name, 0) + size
    few = docs.sparkSession.createDataFrame(sorted({(name, k) for name, own in held.items() for k in own}), "lang string, key long")
    by: dict[str, list[str]] = {}
    for name, _, t in sorted(tuple(r) for r in some.join(F.broadcast(few), ["lang", "key"], "left_semi").select("lang", "key", "text").collect()):
        if any(c.isalpha() for c in t):
            by.setdefault(name, []).append(t)
    return Model(idf, by) if by else None


_NEW = "lang_pred string, score double, cosine double, rejected boolean"


def predict(docs: DataFrame, model: Model | None, text: str = "text", block: int = BLOCK_LANGUAGES) -> DataFrame:
    """docs with lang_pred, score, cosine and rejected; columns of docs with these names give way.

    Texts that are null or have no letter are `und`, with score 0, and rejected. Whole texts are read, in stretches. Of
    languages that are as near the first by name is taken; rows that repeat are judged alike. Without a model every text
    is `und`; an empty table gives no rows. A model of more than `block` languages is asked block after block: each step
    holds one block's centroids, and goes on from the nearest language of the steps before it.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "cosine", "rejected")]
    out = docs.select(*keep)
    schema = T.StructType([*out.schema.fields, *T.StructType.fromDDL(_NEW).fields])

    def step(before: DataFrame, part: Model | None, first: bool) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = held.value
            for batch in batches:
                of = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: E731, B023
                lang, score, cosine, rejected = ([x] * batch.num_rows for x in ("und", 0.0, 0.0, True)) if first else map(of, ("lang_pred", "score", "cosine", "rejected"))
                col = batch.column(batch.schema.get_field_index(text))
                for a in range(0, batch.num_rows if own else 0, 256):
                    n = [counts(t) if t else None for t in col.slice(a, 256).to_pylist()]
                    at = [i for i, c in enumerate(n) if c is not None]
                    if not at:
                        continue
                    for i, name, top, floor, weight in zip(at, *own.nearest(np.stack([n[i] for i in at])), strict=True):
                        k = a + i
                        if score[k] == 0:  # no language has been asked yet
                            lang[k], cosine[k], rejected[k], score[k] = name, float(top), bool(top < floor), float(1 / weight)
                            continue
                        # Weights are in measure of the nearest language of those asked so far.
                        both = max(cosine[k], float(top))
                        total = np.exp((cosine[k] - both) / TEMPERATURE) / score[k] + weight * np.exp((top - both) / TEMPERATURE)
                        if top > cosine[k]:
                            lang[k], cosine[k], rejected[k] = name, float(top), bool(top < floor)
                        score[k] = float(1 / total)
                yield common.with_columns(batch, keep, lang_pred=pa.array(lang, pa.string()), score=pa.array(score, pa.float64()), cosine=pa.array(cosine, pa.float64()), rejected=pa.array(rejected, pa.bool_()))

        return map_arrow(before, run, schema)

    for k, part in enumerate(model.blocks(block) if model else [None]):
        out = step(out, part, k == 0)
    return out


def learnt(docs: DataFrame) -> DataFrame:
    """The rows that the query may learn from."""
    return docs.filter(common.fold(F.col("doc_id"), 4) != 2)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text", "lang")
    out = predict(docs.select("doc_id", "text"), fit(learnt(docs)))
    return out.select("doc_id", (common.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "cosine", "rejected")

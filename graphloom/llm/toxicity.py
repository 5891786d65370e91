"""Toxicity: text is restored from leetspeak, spacing and repetition by Viterbi search, then scored by its words."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import map_arrow
from . import common
from .calibration import Curve
from .quality import FIT_BYTES, chosen, labelled

# Letters that a character may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}

#: Costs of the channel, in nats: a letter written as a symbol, a symbol that is meant, a letter run that is shortened to
#: one or to two, a run that is meant, and a break between words of a spaced stretch.
AS_SYMBOL, MEANT_SYMBOL, TO_ONE, TO_TWO, MEANT_RUN, BREAK = 0.7, 9.0, 0.3, 0.8, 9.0, 1.0
#: Decoded stretches that a worker remembers, and the length of the longest of them; longer ones are decoded each time.
REMEMBERED, LONGEST_REMEMBERED = 50_000, 48

#: Letters of the language model: a to z, any other letter, and a space for all else.
OTHER, SPACE = 26, 27
SIZE = 28

#: Labelled rows per label that the lexicon is learnt from, whole, those of least hash; fewer where their texts have more
#: than FIT_BYTES.
FIT_ROWS = 1500
PREFIXES = (4, 5, 6)
LEAST_SUPPORT, LEAST_ODDS = 3, 2.0
THRESHOLD = 0.5

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SYMBOL = re.escape("".join(LEET))
_ANY_SYMBOL, _ANY_LETTER = re.compile(f"[{_SYMBOL}]"), re.compile("[a-z]")
#: What stands between spaced letters: some of the usual marks, or one of those that else part words.
_BETWEEN = r"(?:[ .\-_*]{1,4}|[/,:~\n])"
_SPACED = re.compile(rf"(?<!\S)(?:[a-z{_SYMBOL}]{_BETWEEN}){{2,}}[a-z{_SYMBOL}](?![a-z{_SYMBOL}])")
_GAP = re.compile(r"[ .\-_*/,:~\n]+")
#: Characters that are not seen.
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
#: A stretch of three spaced letters may be initials or a list: it is a word if a letter of it costs so much more, at most,
#: than one of the corpus does.
SHORT, SHORT_COST = 3, 1.5
_RUN = re.compile(r"([a-z])\1\1")
_EDGE = ".,;:?\"'()[]{}<>#%&*"


def _codes(text: str) -> np.ndarray:
    table = _table()
    return table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


_cached: list[np.ndarray] = []


def _table() -> np.ndarray:
    if not _cached:
        t = np.full(0x110000, SPACE, np.uint8)
        t[[c for c in range(128, 0x110000) if chr(c).isalpha()]] = OTHER
        t[ord("a") : ord("z") + 1] = np.arange(26)
        t[ord("A") : ord("Z") + 1] = np.arange(26)
        _cached.append(t)
    return _cached[0]


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of all character trigrams of all texts: SIZE ** 3 numbers, whatever the corpus."""
    n = SIZE**3

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for _, _, texts in common.text_runs(batch, text, 1 << 20):
                c = _codes("  ".join(["", *texts, ""])).astype(np.int32)
                total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"k": pa.array(some.astype(np.int32)), "n": pa.array(total[some])})

    out = np.zeros(n, np.int64)
    for k, v in map_arrow(docs.select(text), count, "k int, n long").groupBy("k").agg(F.sum("n")).collect():
        out[k] = v
    return out


class LanguageModel:
    """Costs of a character after two others, from counts: trigrams backed off to bigrams and single letters."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(SIZE, SIZE, SIZE).astype(float)
        bi = tri.sum(axis=0)
        uni = bi.sum(axis=0)
        p1 = (uni + 1) / (uni.sum() + SIZE)
        p2 = (bi + 4 * p1[None, :]) / (bi.sum(axis=1, keepdims=True) + 4)
        p3 = (tri + 4 * p2[None, :, :]) / (tri.sum(axis=2, keepdims=True) + 4)
        cost = -np.log(p3)
        self.cost = cost.tolist()
        #: what a character of the corpus costs
        self.mean = float((tri * cost).sum() / max(tri.sum(), 1))


def _code(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else OTHER if c.isalpha() else SPACE


def _text(chain: tuple | None) -> str:
    out = []
    while chain:
        chain, s = chain
        out.append(s)
    return "".join(reversed(out))


class Restorer:
    """Finds obfuscated stretches of lower-case text and decodes each to what it most likely was."""

    def __init__(self, model: LanguageModel):
        self.cost, self.mean = model.cost, model.mean
        self.remembered: dict[str, str] = {}

    def lattice(self, stretch: str) -> list[list[tuple[str, float]]]:
        """Per place of the stretch the strings that it may stand for, with their channel costs.

        In a spaced stretch a word may end before any place, and does where the gap is wider than others.
        """
        spaced = _SPACED.fullmatch(stretch) is not None
        out: list[list[tuple[str, float]]] = []
        i = 0
        chars, ends = stretch, set()
        if spaced:
            # A gap that is wider than the least one ends a word.
            chars, gaps = "".join(_GAP.split(stretch)), [len(g) for g in _GAP.findall(stretch)]
            ends = {k + 1 for k, g in enumerate(gaps) if g > min(gaps)}
        first: list[int] = []
        while i < len(chars):
            c, n = chars[i], 1
            while i + n < len(chars) and chars[i + n] == c and i + n not in ends:
                n += 1
            before = len(out)
            if c in LEET and n > 2:
                out.append([o for x in LEET[c] for o in ((x, n * AS_SYMBOL + TO_ONE), (x * 2, n * AS_SYMBOL + TO_TWO))] + [(c * n, n * MEANT_SYMBOL)])
            elif c in LEET:
                for _ in range(n):
                    out.append([(x, AS_SYMBOL) for x in LEET[c]] + [(c, MEANT_SYMBOL)])
            elif spaced and n == 2:
                out += [[(c, 0.0)], [(c, 0.0)]]  # a word may end between them
            elif c.isalpha() and n > 2:
                out.append([(c, TO_ONE), (c * 2, TO_TWO), (c * n, MEANT_RUN)])
            else:
                out.append([(c * n, 0.0)])
            first += [i] * (len(out) - before)
            i += n
        if spaced:
            for k in range(1, len(out)):
                broken = [(" " + x, cost) for x, cost in out[k]]
                whole_word = first[k] in ends and first[k] != first[k - 1]
                out[k] = broken if whole_word else out[k] + [(x, cost + BREAK) for x, cost in broken]
        return out

    def decode(self, stretch: str) -> str:
        """The cheapest path through the lattice; the state is the last two letters.

        A path is a chain of its pieces, and what all paths share is put out as soon as one is left, so time and memory
        are linear in the stretch.
        """
        done: list[str] = []
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(SPACE, SPACE): (0.0, None)}
        for options in [*self.lattice(stretch), [(" ", 0.0)]]:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, chain) in paths.items():
                for s, channel in options:
                    x, y, total = a, b, cost + channel
                    for c in s:
                        k = _code(c)
                        total += self.cost[x][y][k]
                        x, y = y, k
                    old = new.get((x, y))
                    if old is None or total < old[0] or total == old[0] and _text((chain, s)) < _text(old[1]):
                        new[x, y] = (total, (chain, s))
            paths = new
            if len(paths) == 1:
                state, (cost, chain) = paths.popitem()
                done.append(_text(chain))
                paths = {state: (cost, None)}
        best = min(x for x, _ in paths.values())
        return ("".join(done) + min(_text(chain) for x, chain in paths.values() if x == best))[:-1]

    def restore(self, text: str) -> str:
        """The text (lower case) with its obfuscated stretches decoded; what lies between them stays as it is, but for
        characters that are not seen.

        A stretch between white space is decoded if, without the marks at its edges, it has letters and symbols that may
        stand for letters, wherever these are, or a run of one letter. Symbols alone stay: they are numbers and rulers.
        """
        text = _SPACED.sub(lambda m: self._known(m[0]), _UNSEEN.sub("", text))
        spans: list[tuple[int, int, str]] = []
        for pattern in (_ANY_SYMBOL, _RUN):
            at = 0
            while m := pattern.search(text, at):
                # The whole stretch between white space around the find.
                a, b = m.start(), m.end()
                while a > at and not text[a - 1].isspace():
                    a -= 1
                while b < len(text) and not text[b].isspace():
                    b += 1
                core = text[a:b].strip(_EDGE)
                core = core.rstrip("!") or core
                if pattern is _RUN or _ANY_SYMBOL.search(core) and _ANY_LETTER.search(core):
                    spans.append((a, b, core))
                at = b
        if not spans:
            return text
        out, at = [], 0
        for a, b, core in sorted(spans):
            if a < at:
                continue
            out += [text[at:a], text[a:b].replace(core, self._known(core), 1) if core else text[a:b]]
            at = b
        return "".join([*out, text[at:]])

    def _spaced(self, stretch: str) -> str:
        """A spaced stretch decoded; one of three letters stays as it is unless it makes a likely word."""
        found = self.decode(stretch)
        letters = _GAP.split(stretch)
        if len(letters) > SHORT:
            return found
        if len(set(letters)) == 1 or not all(map(str.isalpha, found)):
            return stretch
        a = b = SPACE
        total = 0.0
        for c in found + " ":
            k = _code(c)
            total += self.cost[a][b][k]
            a, b = b, k
        return found if total <= (len(found) + 1) * (self.mean + SHORT_COST) else stretch

    def _known(self, stretch: str) -> str:
        if len(stretch) > LONGEST_REMEMBERED:
            return self.decode(stretch)
        found = self.remembered.get(stretch)
        if found is None:
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            found = self.remembered[stretch] = self._spaced(stretch) if _SPACED.fullmatch(stretch) else self.decode(stretch)
        return found


def words(text: str) -> set[bytes]:
    """Distinct words of letters; bytes from 0x80 count as letters."""
    return set(text.encode("utf-8", "replace").translate(_LETTERS).split())


def features(some: set[bytes]) -> set[bytes]:
    """Words, and beginnings of longer words with a mark after them."""
    out = set(some)
    for k in PREFIXES:
        out.update([w[:k] + b"-" for w in some if len(w) > k])
    return out


class Lexicon:
    """Log odds of words and beginnings of words between the labels, and a curve from a text's highest to its score.

    Support counts rows whose least word hash differs, so near copies of one text count about once.
    """

    def __init__(self, rows: list[tuple[int, int, bytes]], support: int = LEAST_SUPPORT):
        learn = [r for i, r in enumerate(rows) if i % 3 != 2]
        self.odds: dict[bytes, float] = {}
        seen: tuple[defaultdict, defaultdict] = defaultdict(set), defaultdict(set)
        totals = [len({m for y, m, _ in learn if y == k}) for k in (0, 1)]
        bad = Counter(f for y, _, w in learn if y for f in features(set(w.split())))
        bad_features = {f for f, n in bad.items() if n >= support}
        for y, m, w in learn:
            for f in features(set(w.split())) & bad_features:
                seen[y][f].add(m)
        odds = {}
        for f in bad_features:
            t, n = len(seen[1][f]), len(seen[0][f])
            x = np.log((t + 0.5) / (totals[1] + 1)) - np.log((n + 0.5) / (totals[0] + 1))
            if t >= support and x >= LEAST_ODDS:
                odds[f] = float(x)
        self.odds = odds
        held = [r for i, r in enumerate(rows) if i % 3 == 2]
        x = np.array([self.summary(set(w.split())) for _, _, w in held] or [[0.0] * 5])
        self.curve = Curve(x, np.array([y for y, _, _ in held] or [0], float), decay=0.1)

    def summary(self, some: set[bytes]) -> list[float]:
        """The three highest odds of distinct words, how many words have any, and that for the text's words."""
        found: dict[bytes, float] = {w: self.odds[w] for w in some & self.odds.keys()}
        for k in PREFIXES:
            for w in some:
                x = self.odds.get(w[:k] + b"-") if len(w) > k else None
                if x is not None and x > found.get(w, 0):
                    found[w] = x
        top = sorted(found.values(), reverse=True)[:3] + [0.0] * 3
        return [*top[:3], float(np.log1p(len(found))), float(np.log1p(100 * len(found) / (len(some) + 20)))]

    def score(self, text: str) -> float:
        return self.curve(self.summary(words(text)))


def sample(docs: DataFrame, labels: DataFrame, model: LanguageModel, label: str, rows: int, most_bytes: int = FIT_BYTES) -> list[tuple[int, int, bytes]]:
    """(label, least word hash, distinct words of the restored text, parted by spaces) of at most `rows` rows per label, by hash."""
    some = common.Scratch(docs.sparkSession).write(labelled(docs, labels, label, rows)[0].select("y", "key", "t"), "sample")
    keys = [(y, k) for y, own in chosen(some, rows, most_bytes).items() for k in own]
    few = docs.sparkSession.createDataFrame(sorted(set(keys)), "y int, key long")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Restorer(held.value)
        for batch in batches:
            for a, b, texts in common.text_runs(batch, "t", 1 << 20):
                found = [sorted(words(own.restore(t.lower()))) for t in texts]
                least = [min(map(xxhash.xxh64_intdigest, x)) >> 1 if x else 0 for x in found]
                yield common.with_columns(batch.slice(a, b - a), ["y", "key"], m=pa.array(least, pa.int64()), w=pa.array([b" ".join(x) for x in found], pa.binary()))

    got = map_arrow(some.join(F.broadcast(few), ["y", "key"], "left_semi").select("y", "key", "t"), run, "y int, key long, m long, w binary").collect()
    return [(r.y, r.m, bytes(r.w)) for r in sorted(got, key=lambda r: (r.key, bytes(r.w)))]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = FIT_ROWS) -> tuple[LanguageModel, Lexicon | None]:
    """The language model of all docs (doc_id, text), and the lexicon of labelled rows; None if a label has no row."""
    model = LanguageModel(trigram_counts(docs))
    rows = sample(docs, labels, model, label, fit_rows)
    return model, Lexicon(rows) if len({y for y, _, _ in rows}) == 2 else None


def score(docs: DataFrame, models: tuple[LanguageModel, Lexicon | None], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score, predicted and restored (whether decoding changed the text); columns with these names give way.

    Whole texts are restored and scored. Null and empty texts have no words, and get the score of that. Rows that repeat
    a text get its score each; of paths that cost the same the first in code point order is taken. Without a lexicon
    every score is 0.5 and nothing is predicted toxic. An empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted", "restored")]
    src = docs.select(*keep)
    schema = T.StructType([*src.schema.fields, *T.StructType.fromDDL("score double, predicted int, restored boolean").fields])
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lexicon = held.value
        own = Restorer(model)
        for batch in batches:
            scores, changed = [], []
            for _, _, texts in common.text_runs(batch, text, 1 << 20):
                for t in texts:
                    low = t.lower()
                    plain = own.restore(low)
                    changed.append(plain != low)
                    scores.append(lexicon.score(plain) if lexicon else 0.5)
            yield common.with_columns(batch, keep, score=pa.array(scores, pa.float64()), predicted=pa.array([int(bool(lexicon) and s >= threshold) for s in scores], pa.int32()), restored=pa.array(changed, pa.bool_()))

    return map_arrow(src, run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    fold = common.fold(F.col("doc_id"), 5)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold != 0)
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted", "restored")

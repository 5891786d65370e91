import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import suffix_dedup as sd


def plain(rows, length):
    """Rows (id, text) in order of their ids: marks of every byte under a string that starts earlier."""
    seen, out = set(), {}
    for k, (_, text) in sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0)):
        t = (text or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[k] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return [out[k] for k in range(len(rows))]


def check(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows], "doc_id long, text string, doc string, base double").repartition(3)
    got = sd.repeats(docs, **options).collect()
    want = plain(rows, options.get("length", 100))
    mine = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert mine == sorted((str(i), *w) for (i, _), w in zip(rows, want, strict=True))
    return got


def corpus(seed, n, letters, size):
    r = random.Random(seed)
    new = lambda k: "".join(r.choice(letters) for _ in range(k))
    passages = [new(r.randint(size // 3, size * 2)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages) if r.random() < 0.5 else new(r.randint(1, size * 2))
            if r.random() < 0.3:
                a = r.randrange(len(p))
                p = p[a : a + r.randint(1, size * 2)]
            if p and r.random() < 0.2:
                a = r.randrange(len(p))
                p = p[:a] + r.choice(letters) + p[a + 1 :]
            parts.append(p)
        rows.append((i * 3 - 20, "".join(parts) if r.random() < 0.95 else None))
        if r.random() < 0.1:
            rows.append((1000 + i, rows[-1][1]))
    return rows


@pytest.mark.parametrize("seed,letters,options", [(1, "abcdefgh é\n", {}), (2, "ab", {"length": 20, "span": 8, "gram": 4}), (3, "a", {"length": 12, "span": 4, "gram": 4}), (4, "abc ", {"length": 30, "span": 16, "gram": 8}), (5, "xyz wvuts", {"length": 40, "span": 32, "gram": 8})])
def test_equals_brute_force(spark, seed, letters, options):
    check(spark, corpus(seed, 60, letters, options.get("length", 100)), **options)


def test_small_shards_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(sd, "SHARD", 150)
    rows = corpus(9, 40, "abcd", 30)
    data = [(i, 0, (t or "").encode()) for i, t in rows]
    cut = [(d.tolist(), bytes(x[a:b])) for x, s, e, doc, base in sd._shards(iter(data), 30) for a, b, d in zip(s, e, doc, strict=True)]
    for i, _, t in data:
        parts = [x for d, x in cut if d == i]
        assert {p[k : k + 30] for p in parts for k in range(len(p) - 29)} == {t[k : k + 30] for k in range(len(t) - 29)}


LONG = "The quick brown fox jumps over the lazy dog while seventeen other animals of the wood look on in silence and wonder."


def test_odd_rows(spark):
    rows = [(None, None), (None, LONG), (1, ""), (2, LONG), (3, "x" * 500), (5, "short"), (6, "short"), (9, "é" * 49 + "ab"), (10, "é" * 50), (11, "z" + "é" * 50)]
    check(spark, rows)
    check(spark, [])
    check(spark, [(1, "a")])


def test_repeated_rows_are_copies_of_the_first(spark):
    docs = spark.createDataFrame([(4, LONG), (4, LONG), (4, "short"), (4, "short"), (4, LONG + "!"), (7, LONG[1:])], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in sd.repeats(docs).collect())
    n = len(LONG)
    assert [g for g in got if g[1] == 5] == [(4, 5, 0)] * 2
    assert (7, n - 1, n - 1) in got
    # Rows of one id stand in the order of their texts' hashes; the second of the equal ones is a copy.
    hashes = {r.t: r.h for r in spark.createDataFrame([(LONG,), (LONG + "!",)], "t string").selectExpr("t", "xxhash64(t) AS h").collect()}
    rest = [(4, n, 0), (4, n, n), (4, n + 1, n)] if hashes[LONG] < hashes[LONG + "!"] else [(4, n, n), (4, n, n), (4, n + 1, 0)]
    assert [g for g in got if g[0] == 4 and g[1] >= n] == rest


@pytest.mark.parametrize("seed", range(6))
def test_corpus_order_is_the_order_of_suffixes(seed):
    r = random.Random(seed)
    letters = ["ab", "abcdefgh", "a", "abc", "ab\n", "zyx"][seed]
    parts = ["".join(r.choice(letters) for _ in range(r.randint(1, 300))) for _ in range(20)]
    parts += [p[r.randrange(len(p)) :] for p in parts]
    data = np.frombuffer("".join(parts).encode(), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    order = sd.corpus_order(data, starts, ends, 64)
    assert sorted(order.tolist()) == list(range(len(data)))
    own = np.searchsorted(starts, np.arange(len(data)), "right") - 1
    suffixes = [bytes(data[i : ends[own[i]]])[:64] for i in order.tolist()]
    assert suffixes == sorted(suffixes)
    whole = order[(ends[own] - np.arange(len(data)) >= 64)[order]]
    windows = [bytes(data[i : i + 64]) for i in whole.tolist()]
    assert sd.agree(data, whole, 64).tolist() == [i > 0 and windows[i] == windows[i - 1] for i in range(len(windows))]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [64, 128, 1024])
def test_structured_strings_are_told_apart(spark, n):
    """A Thue-Morse string and its complement agree in polynomial hashes modulo powers of two, not in their bytes."""
    one = thue_morse(n)
    other = one.translate(str.maketrans("ab", "ba"))
    check(spark, [(1, one), (2, other), (3, "x" + one), (4, other + one)], length=n, span=32, gram=16)
    check(spark, [(1, thue_morse(4096)), (2, thue_morse(4096).translate(str.maketrans("ab", "ba")))], length=n, span=32, gram=16)


def test_the_order_decides(spark, monkeypatch):
    """Repeats inside a shard are found as neighbours in the order of suffixes: in another order they are missed."""
    rows = corpus(2, 60, "ab", 20)
    asked = pa.table({"doc": [[i] for i in range(len(rows))], "pos": [[0] for _ in rows], "n": pa.array([[max(0, len((t or "").encode()) - 19)] for _, t in rows], pa.list_(pa.int32()))})
    texts = pa.table({"doc": list(range(len(rows))), "base": [0] * len(rows), "text": [t or "" for _, t in rows]})
    kinds = lambda: sum(len(d) for k, d in zip(*(sd._sort_asked(texts, asked, 20, 7, 5).column(c).to_pylist() for c in ("kind", "doc")), strict=True) if k == sd.MARKS)
    found = kinds()
    seen, want = set(), 0
    for _, t in rows:
        for i in range(len((t or "").encode()) - 19):
            w = (t or "").encode()[i : i + 20]
            want += w in seen
            seen.add(w)
    assert found == want
    monkeypatch.setattr(sd, "corpus_order", lambda data, *_: np.random.default_rng(0).permutation(len(data)))
    assert kinds() < found / 2


def test_many_small_groups_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(sd, "TASK_BYTES", 2000)
    monkeypatch.setattr(sd, "GROUP_BYTES", 500)
    check(spark, corpus(6, 60, "abcdefgh é\n", 100))

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import near_copies as nc


def bits(a, b):
    return sum(int(x).bit_count() for x in a ^ b)


def chain(r, n, flips):
    out = []
    while len(out) < n:
        x = np.array([r.getrandbits(64) for _ in range(nc.WIDE)], np.uint64)
        for _ in range(r.choice([1, 2, 6, 100])):
            out.append(x.copy())
            for _ in range(flips):
                x[r.randrange(nc.WIDE)] ^= np.uint64(1 << r.randrange(64))
    return np.stack(out[:n])


@pytest.mark.parametrize("seed,keys", [(1, 1), (2, 7), (3, 60)])
def test_comparison_equals_brute_force(seed, keys):
    r = random.Random(seed)
    fps = chain(r, 260, 12)
    key = np.sort(np.array([r.randrange(keys) for _ in fps]))
    ids = np.arange(1000, 1000 + len(fps))
    side = np.zeros(len(fps), bool)
    found = nc._compare(key, fps, ids, side, nc.RADIUS)
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    want = {}
    for k in set(key.tolist()):
        own = np.flatnonzero(key == k)
        for a in own:
            for b in own:
                if a < b and bits(fps[a], fps[b]) <= nc.RADIUS:
                    want.setdefault(ids[a], set()).add(ids[b])
                    parent[root(ids[b])] = root(ids[a])
    merged = {}
    for a, b in found:
        assert b in want.get(a, ()) or a in want.get(b, ())
        merged[a] = merged.get(a, a)
    plain = {x: root(x) for x in ids.tolist()}
    parent.clear()
    for a, b in found:
        parent[root(b)] = root(a)
    mine = {x: root(x) for x in ids.tolist()}
    groups = lambda m: sorted(sorted(x for x in m if m[x] == v) for v in set(m.values()))
    assert groups(mine) == groups(plain)


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [nc.BLOCK, 8])
def test_one_of_each_group_stays(spark, monkeypatch, block):
    monkeypatch.setattr(nc.links, "__defaults__", (nc.RADIUS, block))
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7)))
    rows, group = [], []
    for g in range(60):
        base = [word() for _ in range(r.randint(80, 300))]
        for k in range([1, 1, 3, 30][g % 4]):
            rows.append((len(rows) * 2, edited(r, base, k % 2 * max(1, len(base) // 90)) if k else " ".join(base), "x", g))
            group.append(g)
    docs = spark.createDataFrame([(*x, True) for x in rows], "doc_id long, text string, key string, carried long, won boolean")
    kept = nc.one_of_each(docs).collect()
    assert sorted(x.carried for x in kept) == list(range(60))
    assert nc.one_of_each(docs).columns == docs.columns
    first = {}
    for (i, *_), g in zip(rows, group, strict=True):
        first.setdefault(g, i)
    assert all(x.doc_id == first[x.carried] for x in kept)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f", 1), (5, "a b c d e f", 1), (5, "a b c d e f", 1), (5, "other words that are not alike at all", 2), (6, None, 3), (7, "", 3), (8, " \n", 3), (None, "q w e r t y", 4), (None, "q w e r t y", 4), (9, "long " * 100_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, g long")
    kept = nc.one_of_each(docs).collect()
    assert sorted((x.g, x.doc_id or 0) for x in kept) == [(1, 5), (2, 5), (3, 6), (4, 0), (5, 9)]
    assert nc.one_of_each(docs.limit(0)).count() == 0


def test_links_are_those_of_exact_similarity(spark):
    r = random.Random(3)
    rows, pairs = [], []
    for g in range(240):
        base = [f"w{r.randrange(10**9)}" for _ in range(250)]
        other = list(base)
        for k in r.sample(range(2, 248), r.randint(4, 8)):
            other[k] = f"x{r.randrange(10**9)}"
        pairs.append((2 * g, 2 * g + 1, *({tuple(w[i : i + 5]) for i in range(246)} for w in (base, other))))
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    true = {b: len(x & y) / len(x | y) for _, b, x, y in pairs}
    assert sum(0.75 <= s < 0.8 for s in true.values()) > 20 and sum(0.8 <= s < 0.85 for s in true.values()) > 20
    kept = {x.doc_id for x in nc.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = [s for b, s in true.items() if (b in kept) != (s < 0.8)]
    assert not [s for s in wrong if s < 0.8]  # nothing below the threshold goes
    assert len(wrong) <= 1  # and a pair above it is missed with a chance of 0.002


@pytest.mark.parametrize("block", [nc.EXACT_BLOCK, 16])
def test_a_large_group_is_joined_across_blocks(spark, block):
    r = random.Random(9)
    base = [f"w{r.randrange(10**9)}" for _ in range(200)]
    rows = [(i, i // 40, edited(r, base if i < 40 else base[:100] + ["z"] * 100, 1)) for i in range(80)]
    found = nc.verified(spark.createDataFrame(rows, "id long, root long, text string").withColumn("root", F.lit(5).cast("long")), block).collect()
    text = {i: nc.shingles(t.encode()) for i, _, t in rows}
    assert all(nc.similarity(text[x.a], text[x.b]) >= nc.SIMILARITY for x in found)
    parent = {i: i for i in text}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in found:
        parent[root(x.a)] = root(x.b)
    assert len({root(i) for i in range(40)}) == 1 == len({root(i) for i in range(40, 80)}) and root(0) != root(79)


def test_a_shingle_counts_once_however_often_it_comes(spark):
    rows = [(1, "a b c d e " * 20_000 + " ".join(f"u{i}" for i in range(60))), (2, "a b c d e " * 20_000 + " ".join(f"v{i}" for i in range(60)))]
    assert nc.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).count() == 2


def test_texts_share_a_key_as_their_similarity_says():
    """Shares of pairs without a common key, beside what the formula gives; texts of nothing in common share none."""
    r = random.Random(11)
    for edits, n in ((1, 400), (4, 400), (9, 400), (25, 400)):
        apart, expected = 0, 0.0
        for _ in range(n):
            base = [f"w{r.randrange(10**9)}" for _ in range(120)]
            a, b = (nc.shingles(t.encode()) for t in (" ".join(base), edited(r, base, edits)))
            apart += not set(nc.keys(a).tolist()) & set(nc.keys(b).tolist())
            expected += nc.missed(nc.similarity(a, b))
        assert abs(apart - expected) < 4 * (expected + 1) ** 0.5 + 2
    assert nc.missed() < 0.001
    every = [nc.keys(nc.shingles(" ".join(f"w{r.randrange(10**9)}" for _ in range(50)).encode())) for _ in range(500)]
    assert len({k for x in every for k in x.tolist()}) == 500 * nc.KEYS
    assert len(nc.keys(nc.shingles(b""))) == 0


def test_recall_of_all_pairs(spark):
    """Groups of edited copies of all degrees, against the exact similarity of all pairs."""
    r = random.Random(5)
    rows = []
    for _ in range(50):
        base = [f"w{r.randrange(300)}" for _ in range(r.randint(20, 150))]
        for _ in range(6):
            rows.append((len(rows), edited(r, base, r.randint(0, max(1, len(base) // 40)))))
    text = [nc.shingles(t.encode()) for _, t in rows]
    want = {(i, j) for i in range(len(rows)) for j in range(i) if nc.similarity(text[i], text[j]) >= 0.8}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.xxhash64("doc_id", "text"))
    root = {x.doc_id: x.component_root for x in nc.classes(docs, "doc_id", "text", "key").collect()}
    assert len(want) > 200
    assert sum(root[i] == root[j] for i, j in want) >= 0.99 * len(want)
    # No two texts are in one class that no chain of similar pairs joins.
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in want:
        parent[find(i)] = find(j)
    assert all(find(i) == find(j) for i in root for j in root if root[i] == root[j])

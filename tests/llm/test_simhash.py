import random
import re

import numpy as np
import pytest
import xxhash

from graphloom.llm import common, simhash


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(fps, radius=3):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(root(i), []).append(i)
    return {i: min(g) for g in groups.values() for i in g}


def planted(r, n, flips):
    """Random fingerprints, each followed by a chain of changed copies."""
    out = []
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 2, 5, 40])):
            out.append(x)
            for _ in range(r.randint(0, flips)):
                x ^= 1 << r.randrange(64)
    return out[:n]


def as_rows(spark, fps):
    return spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in set(fps)], "fp long")


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 20), (3, 3)])
def test_links_lose_no_pair(spark, seed, block):
    fps = planted(random.Random(seed), 700, 4)
    got = [(r.a, r.b) for r in simhash.links(as_rows(spark, fps), block).collect()]
    for a, b in got:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
    distinct = sorted(set(fps))
    plain = plain_components(distinct)
    roots = simhash.components(common.Scratch(spark), spark.createDataFrame(got, "a long, b long"))
    root = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in roots.collect()}
    groups = {}
    for i, f in enumerate(distinct):
        groups.setdefault(plain[i], set()).add(f)
    for g in groups.values():
        assert len({root.get(f, f) for f in g}) == 1
    assert len({root.get(f, f) for f in distinct}) == len(groups)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_slices_equal_plain_distances(radius):
    r = random.Random(radius)
    left, right = (np.array(planted(r, n, 3), np.uint64) for n in (150, 333))
    right[:100] = left[:100] ^ np.uint64(5)
    i, j = simhash.close_pairs(left, right, radius)
    want = {(a, b) for a in range(150) for b in range(333) if (int(left[a]) ^ int(right[b])).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_a_hub_and_a_hot_fingerprint(spark, monkeypatch):
    """A node of 10,000 links, and a fingerprint with a third of the rows: components are whole, and hot keys are not shuffled."""
    hub, n = 5, 10_000
    edges = spark.range(n).selectExpr(f"{hub}L AS a", "id * 3 + 100 AS b").union(spark.range(300).selectExpr("id * 3 + 100 AS a", "id * 3 + 101 AS b"))
    got = {r.node: r.root for r in simhash.components(common.Scratch(spark), edges).collect()}
    assert len(got) == n + 1 + 300 and set(got.values()) == {hub}
    docs = spark.createDataFrame([(i, None if i % 3 == 0 else f"w{i} x{i} y{i} z{i}") for i in range(3600)], "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in simhash.classes(docs).collect()}
    assert {want[i] for i in range(0, 3600, 3)} == {0}
    monkeypatch.setattr(common, "LEAST_HOT", 10**9)
    assert {r.doc_id: r.component_id for r in simhash.classes(docs).collect()} == want


def test_hot_keys_are_broadcast(spark):
    big = spark.range(40_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "id AS v")
    small = big.groupBy("k").count().withColumn("name", common.F.col("k") * 2)
    out = common.attach_counted(big, small, "k", "count")
    assert out.columns == ["k", "v", "name"] and out.count() == 40_000 and out.filter("name <> k * 2").isEmpty()
    assert "Union" in out._jdf.queryExecution().toString()
    assert common.attach_counted(big.limit(0), small.limit(0), "k", "count").count() == 0


ODD = [None, "", " \n", "Wörter ÀÉ", "one", "ONE", "two words", "a b c", "a b c d", "x " * 3000, "\x85 \xa0 a\x0bb"]


def test_query_equals_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()] + ODD + ODD
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, fp string, component_id long")
    got = {r.doc_id: r for r in simhash.classes(docs).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    plain = plain_components(fps)
    assert len(got) == len(texts)
    for i, f in enumerate(fps):
        assert got[i].fingerprint == f"{f:016x}"
        assert got[i].component_id == plain[i]


def test_null_and_repeated_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "q r s t u v w x y z")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.classes(docs).collect())
    assert got == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]
    assert simhash.classes(docs.limit(0)).count() == 0

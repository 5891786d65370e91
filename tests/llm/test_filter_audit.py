import itertools
import random
import re

import numpy as np
import pytest

from graphloom.llm import filter_audit as fa


def fails(rows, i):
    doc_id, text, _ = rows[i]
    t = text or ""
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t).split(" ") if w]
    own = set()
    if len(words) < 50:
        own.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        own.add("B")
    if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
        own.add("C")
    if set(t) & set("#$%&*|"):
        own.add("D")
    if doc_id is not None and any(d is not None and d < doc_id and (x or "") == t for d, x, _ in rows):
        own.add("E")
    return own


def plain(rows, labels):
    """(part, order, step) -> counts, each order applied filter by filter."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    own = [fails(rows, i) for i in range(len(rows))]
    out = {}
    for part in {p or "" for _, _, p in rows}:
        mine = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        total = dict.fromkeys(fa.FILTERS, 0)
        for order in map("".join, itertools.permutations(fa.FILTERS)):
            left = set(mine)
            for step, f in enumerate(order, 1):
                gone = {i for i in left if f in own[i]}
                redundant = sum(f in own[i] for i in mine) - len(gone)
                left -= gone
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(own[i] == {f} for i in mine), sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone)]
        for order in map("".join, itertools.permutations(fa.FILTERS)):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(total[f])
    return out


def check(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, b"k") for r in rows], "doc_id long, text string, source string, bits int, key binary").repartition(3)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in fa.audit(docs, said).collect()}
    assert got == plain(rows, labels)
    return got


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["Up", "é", "TOP"]
    rows = []
    for i in range(n):
        size = r.choice((0, 3, 49, 50, 51, 120))
        text = " ".join(r.choice(words[: r.choice((5, 203))]) for _ in range(size)) + ("#" if r.random() < 0.2 else "")
        if rows and r.random() < 0.3:
            text = r.choice(rows)[1]
        rows.append((r.choice((i, i // 2)), text if r.random() < 0.9 else None, r.choice(("a", "b", None, ""))))
    labels = [(r.randrange(n), r.choice((0, 1, None)), r.choice((0, 1))) for _ in range(n)] + [(None, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    got = check(spark, *corpus(seed, 150))
    assert len(got) == 3 * 600


def test_odd_rows(spark):
    rows = [(None, None, None), (None, "x y", None), (None, "x y", "s"), (1, "x y", "s"), (1, "x y", "s"), (2, "x y", "s"), (3, "", ""), (4, "A" * 20 + " b" * 300, "only")]
    check(spark, rows, [(1, 1, 0), (1, 0, 1), (2, None, None)])
    check(spark, rows, [])
    check(spark, [], [(1, 1, 1)])


def test_many_labels_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(fa.common, "BROADCAST_ROWS", 20)
    rows, labels = corpus(3, 100)
    check(spark, rows, labels)
    out = fa.audit(spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search("SortMergeJoin .*LeftOuter", plan) and not re.search("BroadcastHashJoin .*LeftOuter", plan)


@pytest.mark.parametrize("text,want", [(b"", 1), (b"w " * 50, 2), (b" ".join(b"w%d" % i for i in range(50)), 0), (b" ".join(b"W%d" % i for i in range(50)), 4), (b" ".join(b"w%d" % i for i in range(50)) + b"|", 8), ("É".encode() * 3, 1)])
def test_failures(text, want):
    assert fa.failures(text) == want


def test_bitmaps_count_many_parts(monkeypatch):
    monkeypatch.setattr(fa, "PARTS", 3)
    import pyarrow as pa

    r = np.random.default_rng(4)
    part, bits = r.integers(0, 20, 900), r.integers(0, 128, 900).astype(np.int32)
    batch = pa.RecordBatch.from_pydict({"part": pa.array([f"p{i}" for i in part]), "bits": pa.array(bits)})
    rows = [x for b in fa._count_batches(iter([batch.slice(0, 400), batch.slice(400)])) for x in b.to_pylist()]
    assert len(rows) == 20 * len(fa.STEPS)
    for x in rows:
        own = bits[part == int(x["part"][1:])]
        f, gone = own >> x["filter"] & 1, own & x["before"]
        assert (x["removed"], x["redundant"], x["kept"]) == ((f & (gone == 0)).sum(), (f & (gone > 0)).sum(), ((f == 0) & (gone == 0)).sum())
        assert (x["good_lost"], x["toxic_lost"]) == tuple((f & (gone == 0) & (own >> k & 1)).sum() for k in (fa.GOOD, fa.TOXIC))

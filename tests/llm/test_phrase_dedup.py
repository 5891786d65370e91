import random

import pytest

from graphloom.llm import common
from graphloom.llm import phrase_dedup as pd


def plain(rows, window):
    """(id, n_words, spans, n_removed, kept) per row: a window goes if it stands in a smaller id; null is the smallest."""
    order = lambda i: -(1 << 63) if i is None else i
    texts = [(order(i), [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t or "").split(" ") if w]) for i, t in rows]
    least = {}
    for i, words in texts:
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            least[w] = min(i, least.get(w, i))
    out = []
    for (i, words), (own, _) in zip(texts, rows, strict=True):
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if least[tuple(words[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        edges = [k for k in range(len(words) + 1) if (k and gone[k - 1]) != (k < len(words) and gone[k])]
        out.append((own, len(words), list(zip(edges[::2], edges[1::2], strict=True)), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return out


def check(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, doc string, bucket int, least int").repartition(3)
    got = [(r.doc_id, r.n_words, [(s.start, s.end) for s in r.spans], r.n_removed, r.kept) for r in pd.repeats(docs, **options).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows, options.get("window", 50))))
    return got


def corpus(seed, n, vocabulary, size):
    r = random.Random(seed)
    new = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passages = [new(r.randint(size // 2, size * 3)) for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randint(0, 4)):
            p = list(r.choice(passages)) if r.random() < 0.6 else new(r.randint(1, size * 2))
            if r.random() < 0.3:
                p = p[r.randrange(len(p)) :]
            if p and r.random() < 0.2:
                p[r.randrange(len(p))] = r.choice(vocabulary)
            words += p
        rows.append((i * 3 - 20, r.choice((" ", "\n", "\t ")).join(words) if r.random() < 0.95 else None))
        if r.random() < 0.15:
            rows.append((r.choice((1000 + i, rows[-1][0])), r.choice(rows)[1]))
    return rows


WORDS = [f"w{i}" for i in range(400)] + ["é", "中文", "W1", "a,b", "\xa0"]
SMALL = {"window": 6, "span": 4, "gram": 2}


@pytest.mark.parametrize("seed,vocabulary,options", [(1, WORDS, {}), (2, WORDS, SMALL), (3, ["a", "b"], SMALL), (4, ["a"], SMALL), (5, WORDS[:30], {"window": 12, "span": 8, "gram": 3})])
def test_equals_brute_force(spark, seed, vocabulary, options):
    check(spark, corpus(seed, 60, vocabulary, options.get("window", 50)), **options)


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(120))
    rows = [(None, None), (None, long), (None, long), (1, ""), (2, long), (2, long), (2, "x " + long), (3, " \n "), (4, "v1 v2"), (5, long + " " + long), (-7, long[:300])]
    check(spark, rows)
    check(spark, [])


def test_a_passage_within_one_document_stays(spark):
    once = " ".join(f"v{i}" for i in range(80))
    got = check(spark, [(1, f"{once} and {once}")])
    assert got[0][3] == 0


def test_long_texts_are_parsed_in_segments(spark, monkeypatch):
    rows = corpus(8, 30, WORDS, 50)
    own = pd.phrases(rows[0][1].split() and [w.encode() for _, t in rows for w in (t or "").split()])
    monkeypatch.setattr(pd, "SEGMENT", 70)
    words = [w.encode() for _, t in rows for w in (t or "").split()]
    cut = pd.phrases(words)
    places = lambda x: [p for a, n in zip(x[0].tolist(), x[1].tolist(), strict=True) for p in range(a, a + n)]
    assert places(cut) == places(own) == list(range(len(words) - 49))


def test_a_passage_of_many_documents_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 10)
    monkeypatch.setattr(pd, "BUCKET_BYTES", 2000)
    r = random.Random(5)
    shared = " ".join(r.choice(WORDS) for _ in range(60))
    rows = [(i, " ".join([*(r.choice(WORDS) for _ in range(20)), shared, *(r.choice(WORDS) for _ in range(10))])) for i in range(150)]
    got = check(spark, rows)
    assert sum(x[3] >= 60 for x in got) == 149


def test_automata_find_every_occurrence():
    r = random.Random(2)
    words = [r.choice("abc").encode() for _ in range(300)]
    passages = [(words[a : a + n], least) for a, n, least in ((3, 5, 7), (100, 5, 9), (100, 6, 2), (5, 3, 1), (3, 5, 4))] + [([b"zz", b"a"], 0)]
    for most in (1, 8, 10_000):
        got = {x for x in pd.Automata(passages, most).find(words)}
        want = {(i, i + len(p), least) for p, least in passages for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p}
        assert {x[:2] for x in got} == {x[:2] for x in want}
        assert {min(x[2] for x in got if x[:2] == k) for k in {x[:2] for x in got}} == {min(x[2] for x in want if x[:2] == k) for k in {x[:2] for x in want}}


def test_many_words_are_told_apart():
    words = [b"%d" % i for i in range(70_000)]
    found = list(pd.Automata([(words[i : i + 2], i) for i in range(0, 69_999, 2)]).find(words[:600]))
    assert sorted(found) == [(i, i + 2, i) for i in range(0, 600, 2)]

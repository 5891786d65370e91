import random

import numpy as np
import pytest
import zstandard as zstd

from graphloom.llm import quality


def corpus(n=600, seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))
    rows = []
    for i in range(n):
        y = int(r.random() < 0.8)
        words = [word() for _ in range(r.randint(5, 300))]
        rows.append((i, " ".join(w if y else w.upper() + "!!" for w in words), y))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 2]
    assert sum(g.predicted == y for g, y in held) >= 0.97 * len(held)
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.7) for g, _ in held)
    again = {r.doc_id: r.score for r in quality.score(docs.repartition(5), quality.fit(docs.repartition(3), labels.filter("doc_id % 2 = 0"))).collect()}
    assert all(again[i] == g.score for i, g in got.items())


ODD = [(None, None), (1, None), (2, ""), (3, "x"), (3, "x"), (4, "word " * 200_000), (5, "é" * 5000)]


@pytest.mark.parametrize("known", [False, True])
def test_odd_rows_and_clashing_columns(spark, known):
    docs = spark.createDataFrame([(i, t, 9.0, "lang") for i, t in ODD], "doc_id long, text string, score double, predicted string")
    rows = corpus(200)
    model = quality.fit(spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (900, None)], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows] + [(900, 1), (None, 0), (5, None)], "doc_id long, quality int")) if known else None
    got = quality.score(docs, model).collect()
    assert len(got) == len(ODD)
    assert all(0 <= r.score <= 1 for r in got)
    assert got[3].score == got[4].score and got[1].score == got[2].score
    if not known:
        assert {r.score for r in got} == {0.5}


def test_no_labels_no_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.fit(docs, labels) is None
    assert quality.fit(docs.limit(0), labels.limit(0)) is None
    assert quality.score(docs.limit(0), None).count() == 0


def test_whole_texts_count():
    model = quality.Model(b"good words " * 300, b"BAD!! " * 500)
    assert model.features(b"good words " * 4000) != model.features(b"good words " * 4000 + b"BAD!! " * 400)


def plain_model(rows, keys, fit_rows):
    """Dictionaries and curve from rows (id, text, label), one by one."""
    by = {y: sorted((keys[i], t.encode()) for i, t, v in rows if v == y)[:fit_rows] for y in (0, 1)}
    cut = lambda t: [t[i : i + 2048] for i in range(0, len(t), 2048)]
    trained = {y: zstd.train_dictionary(quality.DICT_BYTES, [b for _, t in sorted(x for i, x in enumerate(by[y]) if i % 3 != 2) for b in cut(t)]) for y in (0, 1)}

    def features(t):
        g, b = (4 + sum(len(zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(trained[y].as_bytes()), write_checksum=False, write_content_size=False, write_dict_id=False).compress(x)) for x in cut(t)) for y in (1, 0))
        d, length, rate = 2 * (b - g) / (g + b), np.log(len(t) + 8), np.log((g + b) / 2 / (len(t) + 8))
        return [d, rate, rate * rate, length, d * length, d * rate]

    held = {y: [t for i, (_, t) in enumerate(by[y]) if i % 3 == 2] for y in (0, 1)}
    share = {y: sum(v == y for *_, v in rows) for y in (0, 1)}
    each = min(len(held[y]) / share[y] for y in (0, 1))
    x = [(features(t), y) for y in (0, 1) for t in held[y][: max(1, min(len(held[y]), round(each * share[y])))]]
    curve = quality.Curve(np.array([f for f, _ in x]), np.array([float(y) for _, y in x]))
    return lambda t: curve(features(t.encode()))


def test_model_and_scores_equal_brute_force(spark):
    rows = [(i, t * (1 + 9 * (i % 7 == 0)), y) for i, t, y in corpus(240)]  # some texts have many blocks
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    keys = {r.doc_id: r.k for r in docs.selectExpr("doc_id", "xxhash64(doc_id, 11) AS k").collect()}
    own = plain_model(rows, keys, 60)
    # The operator fits on a sample by hash of twice the rows; with as many as there are, on all.
    got = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels, fit_rows=240)).collect()}
    want = plain_model(rows, keys, 240)
    assert all(abs(got[i] - want(t)) < 1e-6 for i, t, _ in rows)
    assert any(abs(own(t) - want(t)) > 1e-6 for _, t, _ in rows)


def test_the_bytes_of_fitted_texts_are_bounded(spark):
    sample = spark.createDataFrame([("x" * 10, 0, 5), ("x" * 10, 0, 3), ("y" * 50, 1, 1), ("y", 1, 2), ("x" * 30, 0, 9)], "t string, y int, key long")
    assert quality.chosen(sample, 10, 25) == {0: [3, 5], 1: [1]}
    assert quality.chosen(sample, 1, 1000) == {0: [3], 1: [1]}

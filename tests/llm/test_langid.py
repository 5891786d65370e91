import random

import numpy as np
import pytest

from graphloom.llm import langid

SETS = {"aa": "ka le mi no pu", "bb": "sch und ein keit", "cc": "ção não que ñe"}


def corpus(n=400, seed=4):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(SETS))
        words = ["".join(r.choice(SETS[lang].split()) for _ in range(r.randint(1, 4))) for _ in range(r.randint(4, 80))]
        rows.append((i, " ".join(words).capitalize() + ".", lang))
    return rows


def test_held_out_accuracy_and_rejection(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.filter("doc_id % 4 <> 2"))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    held = [(got[i], lang) for i, _, lang in rows if i % 4 == 2]
    assert sum(g.lang_pred == lang for g, lang in held) >= 0.98 * len(held)
    assert sum(g.rejected for g, _ in held) <= 0.03 * len(held)
    odd = spark.createDataFrame([(1, "жужжание пчёл над цветами лугов"), (2, "xzqj vwxq zzxw qqjx wvxz")], "doc_id long, text string")
    assert all(r.rejected and r.lang_pred in SETS for r in langid.predict(odd, model).collect())


ODD = [(None, None, None), (1, "", "aa"), (2, " 12 !? \n", "aa"), (3, "k", None), (3, "k", None), (4, "kale mino " * 100_000, "aa"), (5, "İ ß ﬁ ǅ 😀 a", "cc")]


@pytest.mark.parametrize("known", [False, True])
def test_odd_rows_and_clashing_columns(spark, known):
    model = langid.fit(spark.createDataFrame(corpus(100) + ODD, "doc_id long, text string, lang string")) if known else None
    docs = spark.createDataFrame([(*r, True, 7) for r in ODD], "doc_id long, text string, lang string, rejected boolean, score int")
    got = langid.predict(docs, model).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3
    assert [r.score for r in got[:3]] == [0.0] * 3
    assert all(0 <= r.score <= 1 for r in got)
    assert got[3].lang_pred == got[4].lang_pred
    if known:
        assert all(r.lang_pred in SETS for r in got[3:])


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.fit(docs) is None
    assert langid.predict(docs, None).count() == 0


def plain_counts(text):
    """N-grams of the folded text as one, bucket by bucket in whole numbers."""
    folded = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in folded:
        folded = folded.replace("  ", " ")
    out = np.zeros(langid.DIMS, np.int64)
    c = list(map(ord, folded))
    for i in range(len(c) - 1):
        two = c[i] * 0x10001 + c[i + 1] * 0x3D4D51CB & 0xFFFFFFFF
        out[(two * 2654435761 & 0xFFFFFFFF) >> 20] += 1
        if i + 2 < len(c):
            out[((two * 0x85EBCA6B + c[i + 2] * 0xC2B2AE35) * 2654435761 & 0xFFFFFFFF) >> 20] += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_long_texts_are_counted_whole(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["abc de", "a  12", "é中 ñ!", " x"][seed]) for _ in range(3000)) + "z"
    whole = plain_counts(text)
    for stretch in (1, 2, 3, 7, 64, 1000, len(text), len(text) + 1, langid.CALL_BYTES):
        assert abs(langid.counts(text, stretch) - whole).sum() == 0
    text = "".join(r.choice("abc de") for _ in range(langid.CALL_BYTES * 2 + 77))
    assert abs(langid.counts(text) - langid.counts(text, len(text) * 2)).sum() == 0
    assert langid.counts(" 1 ", 1) is None and langid.counts("") is None


def test_predictions_equal_brute_force(spark):
    """Document frequencies, vectors, cosines, scores and rejection, one document at a time, from the model's centroids and floors."""
    rows = corpus(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    n = np.stack([plain_counts(t) for _, t, _ in rows])
    idf = np.log((1 + len(rows)) / (1 + (n > 0).sum(0))) + 1
    assert np.allclose(model.idf, idf, rtol=1e-5)
    assert all((model.of == k).sum() >= 1 for k in range(3)) and model.languages == sorted(SETS)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for (i, _, _), c in zip(rows, n, strict=True):
        v = np.log1p(c) * idf
        cos = model.centres @ (v / np.linalg.norm(v))
        best = [max(x for x, of in zip(cos, model.of, strict=True) if of == k) for k in range(3)]
        k = int(np.argmax(best))
        assert got[i].lang_pred == model.languages[k] and abs(got[i].cosine - best[k]) < 1e-4
        assert abs(got[i].score - 1 / sum(np.exp((x - best[k]) / 0.05) for x in best)) < 1e-2
        floor = np.interp(np.log(c.sum()), *model.floors[k])
        assert got[i].rejected == (best[k] < floor) or abs(best[k] - floor) < 1e-4


def test_centroids_equal_brute_force():
    """Spherical k-means from the farthest rows, in plain loops."""
    r = np.random.default_rng(3)
    x = langid._unit(np.abs(r.normal(size=(60, 12))) * (r.random((60, 12)) < 0.4) + 1e-3)
    centres = [x[int(np.argmax([v @ x.mean(0) for v in x]))]]
    while len(centres) < 3:
        centres.append(x[int(np.argmin([max(v @ c for c in centres) for v in x]))])
    for _ in range(langid.STEPS):
        own = [int(np.argmax([v @ c for c in centres])) for v in x]
        centres = [langid._unit(np.mean([v for v, o in zip(x, own, strict=True) if o == i], axis=0)) if i in own else c for i, c in enumerate(centres)]
    own = [int(np.argmax([v @ c for c in centres])) for v in x]
    want = [c for i, c in enumerate(centres) if own.count(i) >= min(len(x) * 0.02, max(own.count(j) for j in range(3)))]
    assert np.allclose(langid._cluster(x, 3), want, atol=1e-6)


def test_languages_in_blocks_give_the_same(spark):
    rows = corpus(150)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows + ODD if i is not None], "doc_id long, text string")
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    want = sorted((r.doc_id, r.lang_pred, r.rejected, round(r.score, 9), round(r.cosine, 9)) for r in langid.predict(docs, model).collect())
    for block in (1, 2):
        got = sorted((r.doc_id, r.lang_pred, r.rejected, round(r.score, 9), round(r.cosine, 9)) for r in langid.predict(docs, model, block=block).collect())
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert all(abs(g[3] - w[3]) < 1e-6 and abs(g[4] - w[4]) < 1e-6 for g, w in zip(got, want, strict=True))


def test_a_language_left_out_of_training_is_rejected(spark):
    rows = corpus()
    for lang in SETS:
        model = langid.fit(spark.createDataFrame([r for r in rows if r[2] != lang and r[0] % 4 != 2], "doc_id long, text string, lang string"))
        got = langid.predict(spark.createDataFrame([r for r in rows if r[0] % 4 == 2], "doc_id long, text string, truth string"), model).collect()
        assert sum(r.rejected for r in got if r.truth == lang) >= 0.9 * sum(r.truth == lang for r in got)
        assert sum(r.rejected for r in got if r.truth != lang) <= 0.03 * sum(r.truth != lang for r in got)


def test_documents_of_a_language_left_out_are_rejected(spark):
    docs = langid.common.documents(spark, "/root/testdata/sf0.01", "doc_id", "text", "lang")
    model = langid.fit(docs.filter("lang <> 'de'"))
    got = langid.predict(docs, model).filter("lang_pred <> 'und'").collect()
    known, unknown = [r for r in got if r.lang != "de"], [r for r in got if r.lang == "de"]
    assert len(unknown) > 50 and sum(r.rejected for r in unknown) >= 0.9 * len(unknown)
    assert sum(r.rejected for r in known) <= 0.01 * len(known)

import zlib

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline as cp
from graphloom.llm import langid, mixing, near_copies, token_store

from .test_decontam import plain


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """What each stage gets and gives, written and read again."""
    where = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in cp.STAGES:
        stage(spark, docs, sf).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
        out.append(docs.toPandas())
    return out


def test_columns(steps):
    for after in steps[1:5]:
        assert sorted(after.columns) == ["doc_id", "lang", "n_chars", "source", "text"]
        assert len(after)
    assert sorted(steps[5].columns) == ["doc_id", "ids_crc32", "n_tokens", "start"]


def test_language_id_keeps_clean_documents(spark, steps):
    before, after = steps[0], steps[1]
    gone = before[~before.doc_id.isin(after.doc_id)]
    assert len(gone) <= 0.02 * len(before)
    model = langid.fit(langid.learnt(spark.createDataFrame(before)))
    for text in gone.text:
        n = langid.counts(text or "")
        assert n is None or model.predict(n[None])[3][0]


def test_near_dedup_keeps_one_of_each(steps):
    before, after = steps[1], steps[2]
    fps = {r.doc_id: near_copies.fingerprint((r.text or "").encode()) for r in before.itertuples()}
    apart = lambda a, b: sum(int(x).bit_count() for x in fps[a] ^ fps[b])
    kept = set(after.doc_id)
    assert before.text.nunique() >= after.text.nunique() == len(after)
    for i in before.doc_id:
        near = [j for j in before.doc_id if j != i and apart(i, j) <= near_copies.RADIUS]
        if i not in kept:
            assert near
        if not near:
            assert i in kept
        if near and i in kept:
            assert sum(apart(i, j) <= near_copies.RADIUS // 2 for j in near if j in kept) == 0


def test_decontamination_equals_brute_force(spark, sf, steps):
    before, after = steps[2], steps[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = plain([(r.doc_id, r.text) for r in before.itertuples()], items)
    assert sorted(after.doc_id) == sorted(i for i, (_, hit, _) in zip(before.doc_id, found, strict=True) if not hit)


def test_mixing_equals_the_operator(spark, steps):
    before, after = steps[3], steps[4]
    want = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(before)).collect()}
    got = after.doc_id.value_counts().to_dict()
    assert got == {i: n for i, n in want.items() if n}


def test_token_ids_equal_the_library(steps):
    before, after = steps[4], steps[5].sort_values("start")
    tok = token_store.Encoder(P.path(token_store.TOKENIZER)).library
    at = 0
    for r, t in zip(after.itertuples(), before.sort_values(["doc_id", "text"]).text, strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, token_store.END_ID]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


ODD = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 50, None, None, 250), (2, "word " * 50, None, None, 250), (None, "a b c d e", "en", "s", 9)]


@pytest.mark.parametrize("name,stage", cp.STAGES)
@pytest.mark.parametrize("rows", [0, 5])
def test_odd_rows_and_clashing_columns(spark, sf, name, stage, rows):
    docs = spark.createDataFrame([(*r, True, 1.0, 2, "k") for r in ODD[:rows]], "doc_id long, text string, lang string, source string, n_chars long, rejected boolean, score double, n_hit int, key string")
    out = stage(spark, docs, sf)
    got = out.collect()
    assert len(got) <= 3 * rows
    if name != "token_ids":
        assert out.columns == docs.columns


RESERVED = ["__n", "__rate", "__source", "__salt", "__salt2", "__key", "__doc_id", "__carried", "c0", "key", "copy", "rate", "carried"]


@pytest.mark.parametrize("name,stage", cp.STAGES[:4])
def test_columns_of_any_name_stay_as_they_are(spark, sf, name, stage):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()}
    rows = [(i, t, "en", "s", *[i * 100 + k for k in range(len(RESERVED))]) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} long" for c in RESERVED))
    out = stage(spark, docs, sf)
    assert out.columns == docs.columns
    got = out.collect()
    assert got
    for r in got:
        assert tuple(r) == (r.doc_id, texts[r.doc_id], "en", "s", *[r.doc_id * 100 + k for k in range(len(RESERVED))])


def test_run(spark, sf, steps):
    got = cp.run(spark, sf).toPandas()
    assert sorted(map(tuple, got[["doc_id", "start", "ids_crc32"]].values.tolist())) == sorted(map(tuple, steps[5][["doc_id", "start", "ids_crc32"]].values.tolist()))

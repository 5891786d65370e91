import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from graphloom.llm import token_counts as tc
from graphloom.llm import token_store as ts

ODD = [None, "", " ", "a", "  two  words ", "<s> </s> <unk> <|endoftext|> x", "▁▁ ▁a", "née Ünïcode é 한국어 中文 😀😀", "\ttab\nline\r\nend\x0b\x0c\x1c\x85", "don't we'll I'M ΣΑΣ"]
DOCS = "doc_id long, text string, lang string, n_tokens long, start long"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, None, 5, 6) for i, t in enumerate(texts)], DOCS)


def test_counts_equal_the_library(spark):
    texts = [*ODD, " ".join(ODD[3:]) * 3000, "ab" * 40_000, "ab " * 40_000]
    sp = tc.counter(P.path(tc.MODEL)).sp
    got = {r.doc_id: r for r in tc.count_tokens(rows(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(sp.encode(t or ""))
        assert got[i].n_bytes == len((t or "").encode())
        assert got[i].over_limit == (got[i].n_tokens > 4096)
    assert tc.count_tokens(rows(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_splices_equal_the_whole(seed):
    r = random.Random(seed)
    letters = ["ab", "abc \n", "the ing▁ ", "é中文 aé\n.,", "aaaa ", "0123456789 xyz"][seed % 6]
    text = "".join(r.choice(letters) for _ in range(r.randint(300, 3000)))
    own = tc.counter(P.path(tc.MODEL))
    assert own.splits
    for chunk, overlap in ((64, 8), (100, 2), (512, 32)):
        assert own.count(text, chunk, overlap) == len(own.sp.encode(text))


def library_ids(texts):
    tok = ts.Encoder(P.path(ts.TOKENIZER)).library
    return [[*tok.encode(t or "", add_special_tokens=False).ids, ts.END_ID] for t in texts]


def test_store_round_trip(spark, sf):
    texts = [*ODD, "word " * 30_000]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in ts.round_trip(rows(spark, texts).repartition(3), block_ids=3000).collect()}
    at = 0
    for i, ids in enumerate(library_ids(texts)):
        assert (got[i].start, got[i].n_tokens) == (at, len(ids))
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert ts.round_trip(rows(spark, [])).count() == 0


def test_store_orders_nulls_first_and_keeps_repeated_ids(spark):
    docs = spark.createDataFrame([(2, "b"), (None, "n"), (2, "a"), (2, "a")], "doc_id long, text string")
    got = ts.round_trip(docs).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 2, 2, 2]
    assert got[1].ids_crc32 == got[2].ids_crc32 != got[3].ids_crc32


def test_short_memory_gives_the_same_ids():
    texts = ["a b c d e f", "g h i j", "a b x y z <|endoftext|>"]
    own = ts.Encoder(P.path(ts.TOKENIZER), remembered=3)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == library_ids(texts)


@pytest.mark.parametrize("seed", range(8))
def test_elias_fano(seed):
    r = np.random.default_rng(seed)
    numbers = np.cumsum(r.integers(0, [1, 2, 5, 100, 10_000, 1 << 40][seed % 6], r.integers(1, 5000)))
    ef = ts.EliasFano.of(numbers)
    assert ef.select(0, len(numbers)).tolist() == numbers.tolist()
    for i in r.integers(0, len(numbers), 50).tolist():
        n = int(r.integers(0, len(numbers) - i + 1))
        assert ef.select(i, n).tolist() == numbers[i : i + n].tolist()
    assert len(ef.low) + len(ef.high) <= len(numbers) * (2 + np.log2(max(2, numbers[-1] / len(numbers) + 2))) / 8 + 16
    with pytest.raises(IndexError):
        ef.select(len(numbers))


def test_block_reads_documents():
    ids = np.arange(70_000, 70_010, dtype=np.uint32)
    b = ts.Block(ts.pack([None, -(1 << 63), 9, 9, (1 << 63) - 1], np.array([3, 0, 6, 0, 1]), ids))
    assert [b[i].tolist() for i in range(5)] == [ids[:3].tolist(), [], ids[3:9].tolist(), [], ids[9:].tolist()]
    assert b.doc_ids(0, 5).to_pylist() == [None, -(1 << 63), 9, 9, (1 << 63) - 1]
    assert b.doc_ids(2, 2).to_pylist() == [9, 9]
    empty = ts.Block(ts.pack([None], np.array([0]), ids[:0]))
    assert empty.doc_ids(0, 1).to_pylist() == [None] and empty[0].tolist() == []


def test_an_opened_block_holds_no_table():
    r = np.random.default_rng(1)
    n = 20_000
    doc_ids = np.cumsum(r.integers(1, 30, n)).tolist()
    lengths = r.integers(0, 60, n)
    b = ts.Block(ts.pack(doc_ids, lengths, np.zeros(int(lengths.sum()), np.uint32)))
    held = [v for ef in (b.names, b.ends) for v in vars(ef).values() if isinstance(v, np.ndarray)]
    assert not any(v.dtype != np.uint8 and len(v) > n // ts.EliasFano.STEP + 1 for v in held)
    # The lists themselves, of ids and of ends, and the samples beside them.
    assert sum(v.nbytes for v in held) < 2 * 1.5 * n
    assert sum(ef.samples.nbytes for ef in (b.names, b.ends)) < 0.04 * n
    assert [b.bounds(i, 1).tolist() for i in (0, 777, n - 1)] == [[int(lengths[:i].sum()), int(lengths[: i + 1].sum())] for i in (0, 777, n - 1)]


def test_a_hot_id_is_dealt_to_several_tasks(spark):
    docs = spark.createDataFrame([(None if i % 3 else i, f"text {i % 500}") for i in range(3000)], "doc_id long, text string")
    scratch = ts.common.Scratch(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ts.write(docs, scratch.path("b"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(scratch.path("b")).select("partition").distinct().count() >= 3
    got = ts.read(spark, scratch.path("b")).orderBy("start").collect()
    order = sorted([(r.doc_id is not None, r.doc_id or 0, r.text) for r in docs.collect()])
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [x[:2] for x in order]
    want = library_ids([t for *_, t in order])
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]


def test_counts_of_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None), (4, "a b"), (4, "a b")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in tc.count_tokens(docs).collect())
    n = len(tc.counter(P.path(tc.MODEL)).sp.encode("a b"))
    assert got == [(0, 0), (0, n), (4, n), (4, n)]

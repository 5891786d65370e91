import random
import re
import time

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import chunking


def one(spark, expr, *values):
    return spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'string' if v is None or isinstance(v, str) else 'long'}" for i, v in enumerate(values))).select(expr.alias("x")).first().x


CASES = [("aaaa\n\nbbbb\n\ncccc", 10, 3, ["aaaa\n\nbbbb", "bbb\ncccc"]), ("abc.defgh.ijklmnop", 5, 0, ["abc", "defgh", "ijklmnop"]), ("abcdefgh", 5, 0, ["abcde", "fgh"]), ("abcd efgh", 5, 0, ["abcd ", "efgh"]), ("ab\n\ncdefghij", 5, 2, ["ab", "cdefghij"]), ("3.14 is pi", 9, 0, ["3。14 is pi"]), ("", 5, 1, []), (" \n\n　", 5, 1, [])]


@pytest.mark.parametrize("text,size,overlap,want", CASES)
def test_chunks(spark, text, size, overlap, want):
    assert one(spark, chunking.paragraph_chunks(F.col("c0"), size, overlap), text) == want


def letters(text):
    """What no rule of chunking may lose: all but white space and the ends of sentences."""
    return re.sub(r"[\s.!?。！？]", "", text)


@pytest.mark.parametrize("size,overlap", [(10, 3), (25, 8), (7, 0)])
def test_chunks_keep_the_rules_on_random_text(spark, size, overlap):
    r = random.Random(size)
    texts = ["".join(r.choice("ab .!\n\n　。é") for _ in range(r.randint(0, 200))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for row in df.select("i", chunking.paragraph_chunks(F.col("t"), size, overlap).alias("c")).collect():
        text, chunks = texts[row.i], row.c
        paragraphs = [p for p in map(str.strip, text.split("\n\n")) if p]
        # No chunk is blank or has space at its edges, but for a sentence cut at the size, which may end in space.
        assert all(c.strip() and (c == c.strip() or len(c) == size and c == c.lstrip() and c in text) for c in chunks)
        # A text that fits is one chunk, its paragraphs parted by an empty line.
        if sum(map(len, paragraphs)) + 2 * len(paragraphs) <= size:
            assert chunks == ["\n\n".join(paragraphs)] * bool(paragraphs)
        # Nothing but space and sentence ends is lost: each paragraph's letters come in order, in neighbouring chunks.
        if not overlap:
            assert letters("".join(chunks)) == letters(text)
        else:
            assert set(letters(text)) == set(letters("".join(chunks)))
            assert len(letters("".join(chunks))) <= len(letters(text)) + overlap * len(chunks)
        # A chunk is at most a size long, beside its glue and the overlap before; only a paragraph that comes whole is longer.
        longest, glue = max(map(len, paragraphs), default=0), 2 * len(paragraphs) + len(re.findall("[.!?。！？]", text))
        assert all(len(c) <= max(size, longest) + overlap + 1 + glue for c in chunks)


def test_an_overlap_is_the_tail_of_the_chunk_before(spark):
    text = "\n\n".join(f"paragraph {i} has its own words" for i in range(12))
    chunks = one(spark, chunking.paragraph_chunks(F.col("c0"), 70, 15), text)
    assert len(chunks) > 3
    for before, after in zip(chunks, chunks[1:], strict=False):
        assert after.startswith(before[-15:].strip() + "\n")


def test_time_is_linear_in_a_text(spark):
    """One paragraph of very many sentences, and one text of very many paragraphs."""
    took = {}
    for sep in (". ", "\n\n"):
        for n in (20_000, 80_000):
            df = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("a sentence of several words "), i.cast("string"))), sep).alias("t"))
            df = spark.createDataFrame(df.collect(), "t string")
            start = time.time()
            assert df.select(F.size(chunking.paragraph_chunks(F.col("t")))).first()[0] > n / 40
            took[sep, n] = time.time() - start
    assert all(took[sep, 80_000] < 10 * took[sep, 20_000] + 1 for sep in (". ", "\n\n")), took


def test_windows(spark):
    assert one(spark, chunking.fixed_windows(F.col("c0"), 5, 2), "abcdefgh  ") == ["abcde", "defgh", "gh"]
    assert one(spark, chunking.fixed_windows(F.col("c0"), 5, 2), "") == []


@pytest.mark.parametrize("text,want", [("中文abc1", "zh"), ("中abcd", "en"), ("123", "en"), ("", "en")])
def test_language(spark, text, want):
    assert one(spark, X.language(F.col("c0")), text) == want


@pytest.mark.parametrize("text,number,date", [("1,234", True, False), ("nan", True, False), ("1_000", True, False), (" 5 ", True, False), ("", False, False), ("1d", False, False), ("¥85", False, False), (None, False, False), ("2024年1月2日", False, True), ("01/02/2024", False, True), ("1/2/2024", False, False)])
def test_cells(spark, text, number, date):
    assert (one(spark, X.is_number(F.col("c0")), text), one(spark, X.is_date(F.col("c0")), text)) == (number, date)


@pytest.mark.parametrize("text", ["1,234", "12.5%", "1_000", "-.5", "5.", "1e3", "inf", "-Infinity"])
def test_numbers_have_their_values(spark, text):
    assert one(spark, X.to_number(F.col("c0")), text) == float(text.replace(",", "").replace("%", ""))


@pytest.mark.parametrize("text,want", [("人名", "ENTITY___"), ("9x", "ENTITY_9X"), ("", "ENTITY_UNKNOWN"), ("Person Name", "PERSON_NAME")])
def test_labels(spark, text, want):
    assert one(spark, X.sanitise(F.col("c0"), "ENTITY_"), text) == want


@pytest.mark.parametrize("n,want", [(0, "0 B"), (1536, "1.5 KB"), (1 << 20, "1 MB"), (1023, "1023 B")])
def test_sizes(spark, n, want):
    assert one(spark, X.human_size(F.col("c0")), n) == want


@pytest.mark.parametrize("name,size,want", [("a.PDF", 1, (True, True)), ("pdf", 1, (False, True)), ("a.pdf.exe", 1, (False, True)), ("a.pdf", 104857600, (True, True)), ("a.pdf", 104857601, (True, False))])
def test_uploads(spark, name, size, want):
    assert tuple(one(spark, c, name, size) for c in X.upload_checks(F.col("c0"), F.col("c1"))) == want


def test_two_decimals(spark):
    r = random.Random(5)
    values = [23.125, 2.675, 1.005, 0.125, 0.375, -0.125, 1e12 + 0.005, 0.0, 1e15 / 3, 8.345] + [r.randrange(10**6) / 1000 for _ in range(3000)] + [r.uniform(-1e6, 1e6) for _ in range(500)]
    got = [x.t for x in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(X.two_decimals(F.col("v")).alias("t")).collect()]
    assert [g.replace("-0.00", "0.00") for g in got] == [f"{v:.2f}".replace("-0.00", "0.00") for v in values]


def test_terms_and_progress(spark):
    assert one(spark, X.query_terms(F.col("c0")), "what is the GDP of France") == ["what", "the", "GDP"]
    assert one(spark, X.page_progress(F.col("c0"), F.lit(3), 0.2), 0) == 6
    assert one(spark, X.page_progress(F.col("c0"), F.lit(3), 1.0), 2) == 30


def test_chunk_ids(spark):
    got = {k: one(spark, c, "f_1_page_0_table_2", "f_1") for k, c in chunking.parse_chunk_id(F.col("c0"), F.col("c1")).items()}
    assert got == {"page_number": 0, "content_type": "table", "chunk_index": 2}

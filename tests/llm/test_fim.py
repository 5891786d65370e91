import hashlib
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, fim


def plain(doc_id, text, seed=1, rate=90, spm=20):
    """(n, form, prefix, middle, output) over code points, from the statement."""
    t = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", 1, b"n") for i, t in rows], "id long, body string, text string, block int, name binary").repartition(3)
    out = fim.fill_in_middle(docs, "id", "body", **options)
    got = out.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in got), key=key) == sorted(((i, *plain(i, t, **options), t or "") for i, t in rows), key=key)
    return got


LETTERS = "abc é中\U0001f600\ń"


def texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.choice((1, 2, 7, 300)))) for _ in range(n)]


def test_equals_the_statement(spark):
    some = texts(1, 80)
    got = run(spark, [(i * 7 - 30, some[i % 80]) for i in range(240)])
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    draws = [fim.cut(b"some text", fim.opened(fim.boundaries(b"some text")), i, 5, 50, 70)[:4] for i in range(60)]
    assert draws == [plain(i, "some text", 5, 50, 70)[:4] for i in range(60)]


def test_odd_rows(spark):
    rows = [(None, None), (None, "abc"), (None, "abc"), (1, ""), (1, "x"), (1, "x"), (2, "x"), (3, "a<P>b"), (4, "<S>"), (5, "x<M>"), (6, "<p>"), (7, " \n\t "), (8, "\U0001f600" * 5), (-9, "中")]
    run(spark, rows)
    run(spark, [])


def test_long_text_in_pieces(spark, monkeypatch):
    t = "".join(texts(3, 400)) * 20
    monkeypatch.setattr(fim, "PIECE", 997)
    data = t.encode()
    starts = fim.opened(fim.boundaries(data))
    want = [len(t[:i].encode()) for i in range(0, len(t) + 1, 501)]
    assert starts.n == len(t) + 1
    assert [int(starts.select(i)[0]) for i in range(0, len(t) + 1, 501)] == want
    run(spark, [(11, t), (12, t), (13, t[1:])])


@pytest.mark.parametrize("text", ["", "a", "é", "中" * 9, "\U0001f600" * 3 + "a", "ab" * 40])
def test_boundaries_are_an_elias_fano_list(text):
    starts = fim.opened(fim.boundaries(text.encode()))
    assert starts.select(0, starts.n).tolist() == [len(text[:i].encode()) for i in range(len(text) + 1)]


def test_a_hot_text_is_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 20)
    rows = [(i, "the same text of many") for i in range(300)] + [(1000 + i, f"own {i}") for i in range(50)]
    run(spark, rows)
    docs = fim.dealt(spark.createDataFrame(rows, "doc_id long, text string"))
    index = fim.text_index(docs)
    assert docs.filter("text = 'the same text of many'").select("block").distinct().count() > 10
    assert index.count() == index.select("name", "block").distinct().count() > 60


def test_texts_are_shuffled_once(spark, sf):
    out = fim.fill_in_middle(spark.read.parquet(f"{sf}/documents.parquet"))
    out.write.format("noop").mode("overwrite").save()
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("Initial Plan")[0]

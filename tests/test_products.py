import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.operators import products, retrieval
from graphloom.plans.catalogue import QUERIES
from graphloom.sources.providers import HashingEmbedder


def sorted_all(q, x, k):
    full = products.exact(q, x, np.repeat(np.arange(len(q)), len(x)), np.tile(np.arange(len(x)), len(q))).reshape(len(q), len(x))
    return np.argsort(-full, axis=1, kind="stable")[:, :k].ravel()


@pytest.mark.parametrize("n,m,k,d,held", [(3, 2, 5, 4, 1 << 22), (1000, 50, 5, 64, 7000), (20_000, 60, 5, 64, 1 << 22), (5000, 40, 100, 7, 1 << 16)])
def test_the_best_products_are_those_of_a_full_sort(monkeypatch, n, m, k, d, held):
    monkeypatch.setattr(products, "HELD", held)
    r = np.random.default_rng(n)
    x, q = r.normal(size=(n, d)), r.normal(size=(m, d))
    x[n // 2 : n // 2 * 2] = x[: n // 2]  # each twice: the first stays
    at, which, score = products.best(q, x, k)
    assert at.tolist() == np.repeat(np.arange(m), min(k, n)).tolist()
    assert which.tolist() == sorted_all(q, x, k).tolist()
    assert np.allclose(score, (q[at] * x[which]).sum(axis=1))


@pytest.mark.parametrize("odd", [np.nan, np.inf, 1e200])
def test_values_that_rough_products_cannot_tell(odd):
    r = np.random.default_rng(3)
    x, q = r.normal(size=(300, 6)), r.normal(size=(4, 6))
    x[7, 2], x[9] = odd, 0
    assert products.best(q, x, 5)[1].tolist() == sorted_all(q, x, 5).tolist()
    assert products.best(np.zeros((1, 6)), np.zeros((300, 6)), 5)[1].tolist() == [0, 1, 2, 3, 4]


def test_products_of_a_group_are_held_some_at_a_time():
    r = np.random.default_rng(4)
    x, q = r.normal(size=(1 << 14, 8)), r.normal(size=(1 << 12, 8))
    tracemalloc.start()
    products.best(q, x, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(x) * len(q) * 4 / 2  # of all products in single precision, less than half


def test_copies_of_a_vector_are_not_all_made_exactly_for_each_of_its_queries(monkeypatch):
    r = np.random.default_rng(6)
    x = r.normal(size=(4000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1::2] = x[1]  # half of them are one vector, which is the nearest of half of the queries
    q, made, plain = x[100:300], [], products.exact
    monkeypatch.setattr(products, "exact", lambda q, x, at, which: made.append(len(at)) or plain(q, x, at, which))
    at, which, score = products.best(q, x, 5)
    assert sum(made) < 20 * len(q)  # of 2,000 copies to each of 100 queries, 200,000 products
    monkeypatch.undo()
    assert which.tolist() == sorted_all(q, x, 5).tolist()
    assert which.reshape(-1, 5)[1].tolist() == [1, 3, 5, 7, 9]  # of copies, the first
    assert np.allclose(score, (q[at] * x[which]).sum(axis=1))


def test_the_first_copies_of_rows():
    x = np.array([[1.0, 2], [3, 4], [1, 2], [1, 2], [3, 4], [np.nan, 0], [1, 2], [np.nan, 0], [np.nan, 0]])
    assert products.first_copies(x, 2).tolist() == [0, 1, 2, 4, 5, 7]
    assert products.first_copies(x, 9).tolist() == list(range(9))
    assert products.best(x[:1], x, 9)[1].tolist() == sorted_all(x[:1], x, 9).tolist()
    assert products.best(x, x, 2)[1].tolist() == sorted_all(x, x, 2).tolist()


def test_vectors_of_a_table_as_rows():
    for of in (pa.float32(), pa.float64()):
        column = pa.chunked_array([pa.array([[1.0, 2.0]], pa.list_(of)), pa.array([[3.0, None], [5.0, 6.0]], pa.list_(of))])
        assert np.array_equal(products.matrix(column), [[1, 2], [3, np.nan], [5, 6]], equal_nan=True)


def test_lists_meet_their_queries_as_matrices_in_blocks(spark, sf, monkeypatch):
    plan = QUERIES["r02_ivf_topk"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CoGroupsInArrow") >= 2
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    indexed, centres = retrieval.inverted_file(v, 8)
    rows = lambda: sorted(tuple(r) for r in retrieval.probed_top_k_of_each(indexed, centres, q, 5, 8).select("query_id", "rank", "vec_id").collect())
    want = sorted(tuple(r) for r in retrieval.top_k_of_each(v, q).select("query_id", "rank", "vec_id").collect())
    assert rows() == want
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 3)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    assert rows() == want


def test_vectors_of_many_questions_are_made_once(spark, sf):
    plan = QUERIES["r01_many_questions"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # they are read from a stored table, each time


def test_places_of_words_are_kept_up_to_a_number():
    one, some = HashingEmbedder(), HashingEmbedder()
    some.most_known = 3
    texts = [f"a b{i % 7} C{i} a" for i in range(40)]
    assert [some.embed([t])[0] for t in texts] == one.embed(texts) and len(some._known) <= 6

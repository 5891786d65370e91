import numpy as np
import pytest

from graphloom.operators import vector_index as vi
from graphloom.sources.store import Store


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def brute(x, q, k):
    score = q @ x.T
    return [[int(i) for i in np.lexsort((np.arange(len(x)), -np.round(s, 12)))[:k]] for s in score]


def rows(df, k):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, [None] * k)[r.rank - 1] = r.vec_id
    return [out[q] for q in sorted(out)]


def test_codes_bound_the_true_score():
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 10)) * r.uniform(0.1, 3, size=(400, 1))
    books = vi.Books.fitted(x[:200], 8)
    own, code, error, radius = books.encode(x)
    q = r.normal(size=(5, 10))
    score = np.stack([q[i] @ books.centres[own].T + books.tables(q[i : i + 1])[0][np.arange(code.shape[1]), code].sum(axis=1) for i in range(5)])
    assert (np.abs(q @ x.T - score) <= np.linalg.norm(q, axis=1)[:, None] * error + 1e-9).all()
    assert (q @ x.T <= q @ books.centres[own].T + np.linalg.norm(q, axis=1)[:, None] * radius + 1e-9).all()


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    r = np.random.default_rng(1)
    x = np.concatenate([c + 0.25 * r.normal(size=(60, 18)) for c in r.normal(size=(8, 18))])
    x[100] = x[40]  # a tie
    index = vi.VectorIndex(Store(spark, f"file://{tmp_path_factory.mktemp('index')}"), vector_buckets=4)
    index.create(frame(spark, x[:300]).union(spark.createDataFrame([(999, None)], "vec_id long, embedding array<double>")), lists=8)
    before = set(index.store.folders("index_codes"))
    index.insert(frame(spark, x[300:], 300))
    assert before < set(index.store.folders("index_codes"))
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 480, 24)], "query_id long, embedding array<double>")
    return x, index, queries


def test_search_finds_nearly_all(spark, made):
    x, index, queries = made
    want = brute(x, x[::24], 5)
    got = rows(index.search(queries, 5, probes=6, size=40), 5)
    assert sum(len(set(a) & set(b)) for a, b in zip(got, want, strict=True)) >= 0.9 * 5 * len(want)
    assert index.shortlist(queries, 6, 40).count() == 40 * 20


@pytest.mark.parametrize("probes,size", [(8, 40), (1, 5)])
def test_exact_search_equals_brute_force_and_leaves_vectors_out(spark, made, probes, size):
    x, index, queries = made
    assert rows(index.exact(queries, 5, probes, size), 5) == brute(x, x[::24], 5)
    assert index.candidates(queries, 5, probes, size).count() < 0.6 * 20 * 480


def test_exact_search_of_any_lengths_in_small_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vi, "BLOCK", 16)
    monkeypatch.setattr(vi, "QUERIES", 3)
    r = np.random.default_rng(5)
    x = r.normal(size=(90, 7)) * r.uniform(0.01, 4, size=(90, 1))
    index = vi.VectorIndex(Store(spark, f"file://{tmp_path}/i"), vector_buckets=2)
    index.create(frame(spark, x), lists=4)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(10)], "query_id long, embedding array<double>")
    assert rows(index.exact(queries, 4, 2, 8), 4) == brute(x, x[:10], 4)
    few = rows(index.exact(queries.limit(1), 100, 4, 200), 100)[0]
    assert sorted(i for i in few if i is not None) == list(range(90))


def test_deleted_vectors_are_found_no_more(spark, tmp_path):
    r = np.random.default_rng(8)
    x = r.normal(size=(120, 8))
    index = vi.VectorIndex(Store(spark, f"file://{tmp_path}/i"), vector_buckets=2)
    index.create(frame(spark, x[:80]), lists=4)
    index.insert(frame(spark, x[80:], 80))
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(6)], "query_id long, embedding array<double>")
    old = index.store.state()
    index.delete(spark.range(0, 120, 3).withColumnRenamed("id", "vec_id"))
    left = np.flatnonzero(np.arange(120) % 3)
    assert rows(index.exact(queries, 4, 2, 8), 4) == [[int(left[i]) for i in w] for w in brute(x[left], x[:6], 4)]
    assert rows(index.search(queries, 4, 4, 120, old), 4) == brute(x, x[:6], 4)
    index.insert(frame(spark, x[:1]))
    assert rows(index.exact(queries.limit(1), 1, 2, 8), 1) == [[0]]
    index.delete(index.store.read("index_codes").select("vec_id"))
    assert index.search(queries).isEmpty() and index.exact(queries).isEmpty()


def test_an_insert_goes_by_the_books_that_stand(spark, tmp_path, monkeypatch):
    """The index is made anew while vectors are encoded: they are encoded again."""
    r = np.random.default_rng(9)
    x = r.normal(size=(60, 8))
    index = vi.VectorIndex(Store(spark, f"file://{tmp_path}/i"), vector_buckets=2)
    index.create(frame(spark, x[:30]), lists=2)
    real = vi.VectorIndex._add

    def meanwhile(self, t, vectors, books):
        real(self, t, vectors, books)
        monkeypatch.setattr(vi.VectorIndex, "_add", real)
        index.create(frame(spark, 10 * x[30:50], 30), lists=3)

    monkeypatch.setattr(vi.VectorIndex, "_add", meanwhile)
    index.insert(frame(spark, x[50:], 50))
    books = index.books()
    assert len(books.centres) == 3 and index.store.read("index_vectors").count() == 30
    stored = {c.vec_id: (c.list, bytes(c.code)) for c in index.store.read("index_codes").collect()}
    own, code, _, _ = books.encode(x[50:])
    assert [stored[50 + i] for i in range(10)] == [(int(a), c.tobytes()) for a, c in zip(own, code, strict=True)]


def test_no_candidate_of_the_exact_search_is_shuffled(spark, made):
    _, index, queries = made
    plan = index.exact(queries, 5)._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("CoGroupsInArrow")]
    assert "Join" not in top  # what leaves a block is ranked and nothing else


def test_codes_stand_for_vectors_whose_products_are_their_scores():
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 10))
    books = vi.Books.fitted(x, 8)
    own, code, _, _ = books.encode(x)
    q = r.normal(size=(5, 10))
    score = np.stack([q[i] @ books.centres[own].T + books.tables(q[i : i + 1])[0][np.arange(code.shape[1]), code].sum(axis=1) for i in range(5)])
    assert np.allclose(q @ books.decode(own, code).T, score)

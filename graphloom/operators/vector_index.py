"""An inner-product index: vectors in lists by their nearest centre, as short codes of what they differ from it.

A code names, for each of some subspaces, the nearest of 256 codewords to that part of the difference. A query makes one
table of its products with all codewords, so a code's score is as many look-ups as it has bytes. The best by code are scored
again by the vectors themselves. As the length of what a code leaves out is kept with it, a code's score also bounds the
true one from above: the exact search scores only vectors whose bound reaches the k-th best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shipping import map_arrow, prepare
from ..sources.folders import stored
from ..sources.store import State, Store, Transaction
from . import products

LISTS, PROBES, SHORTLIST, TOP_K = 128, 96, 100, 5
#: Dimensions of a subspace, and codewords for one.
PART, WORDS = 4, 256
#: Vectors that centres and codewords are fitted on, at most, by a hash of their ids; every vector is indexed.
SAMPLE_ROWS = 20_000
#: Codes, and queries, that are scored against each other at once.
BLOCK, QUERIES = 1 << 15, 1 << 13


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7, spherical: bool = False) -> np.ndarray:
    """Centres of rows; spherical ones have length 1 and take the rows of highest inner product. Fewer rows than centres are centres themselves."""
    random = np.random.default_rng(seed)
    if len(x) <= k:
        return x.copy()
    centres = x[random.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        if spherical:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        own = nearest(x, centres, spherical)
        size = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        lost = np.flatnonzero(size == 0)
        centres = sums / np.maximum(size, 1)[:, None]
        centres[lost] = x[random.integers(0, len(x), len(lost))]
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12) if spherical else centres


def nearest(x: np.ndarray, centres: np.ndarray, spherical: bool = False) -> np.ndarray:
    score = x @ centres.T
    return np.argmax(score if spherical else score - 0.5 * (centres**2).sum(axis=1), axis=1)


class Books:
    """Centres of the lists and codewords of the subspaces: as large as lists, words and dimensions say, whatever the vectors."""

    def __init__(self, centres: np.ndarray, words: np.ndarray):
        self.centres, self.words = centres, words

    @classmethod
    def fitted(cls, x: np.ndarray, lists: int) -> Books:
        centres = k_means(x, lists, spherical=True)
        rest = cls.parts(x - centres[nearest(x, centres, True)])
        books = [k_means(rest[:, m], WORDS, seed=m) for m in range(rest.shape[1])]
        words = np.zeros((len(books), WORDS, PART))
        for m, b in enumerate(books):
            words[m, : len(b)] = b
            words[m, len(b) :] = b[0]
        return cls(centres, words)

    @staticmethod
    def parts(x: np.ndarray) -> np.ndarray:
        """(rows, subspaces, PART), filled up with zeros."""
        m = -(-x.shape[1] // PART)
        out = np.zeros((len(x), m * PART))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), m, PART)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each row its list, code, the length of what the code leaves out, and its distance from the centre."""
        own = nearest(x, self.centres, True)
        rest = self.parts(x - self.centres[own])
        code = np.stack([nearest(rest[:, m], self.words[m]) for m in range(rest.shape[1])], axis=1).astype(np.uint8)
        left = rest - self.words[np.arange(rest.shape[1]), code]
        return own, code, np.sqrt((left**2).sum(axis=(1, 2))), np.sqrt((rest**2).sum(axis=(1, 2)))

    def decode(self, list_: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The vectors that lists and codes stand for: a code's score is its product with a query."""
        rest = self.words[np.arange(code.shape[1]), code].reshape(len(code), -1)
        return self.centres[list_] + rest[:, : self.centres.shape[1]]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, subspaces, WORDS): products of the queries' parts with all codewords."""
        return np.einsum("qmp,mwp->qmw", self.parts(q), self.words)


def _floats(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return products.matrix(column if isinstance(column, pa.ChunkedArray) else pa.chunked_array([column]))


def _reaching(q: np.ndarray, x: np.ndarray, error: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Some queries at a time (the first's number; query, row, score by code): all rows of decoded x whose bound reaches the query's least."""
    step = max(1, products.HELD // len(x))
    for i in range(0, len(q), step):
        some = slice(i, i + step)
        score = q[some] @ x.T
        at, which = np.nonzero(score + np.linalg.norm(q[some], axis=1)[:, None] * error >= least[some, None] - 1e-9)
        yield i, at, which, score[at, which]


_CODES = "vec_id long, list int, code binary, error double, radius double"


class VectorIndex:
    """The index as tables of a store: codes by list, vectors by id, and the books.

    An insert adds folders and changes none; a deletion writes the folders again that have such ids. A search reads one
    version throughout, whatever others do meanwhile. An id that is inserted twice stands for two vectors.
    """

    def __init__(self, store: Store, name: str = "index", vector_buckets: int = 16):
        self.store, self.name, self.buckets = store, name, vector_buckets
        self.spark = store.spark

    def table(self, what: str) -> str:
        return f"{self.name}_{what}"

    def create(self, vectors: DataFrame, lists: int = LISTS, sample_rows: int = SAMPLE_ROWS) -> None:
        """Fits the books on a sample by hash and indexes all vectors (vec_id, embedding) in one commit."""
        rows = vectors.filter("embedding IS NOT NULL")
        share = min(1.0, sample_rows / max(1, rows.count()))
        sample = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("vec_id").select("embedding").limit(sample_rows)
        books = Books.fitted(_floats(sample.toArrow().column(0)), lists)
        kept = [("centre", i, 0, c.tolist()) for i, c in enumerate(books.centres)] + [("word", m, w, v.tolist()) for m, own in enumerate(books.words) for w, v in enumerate(own)]
        table = self.spark.createDataFrame(kept, "kind string, m int, w int, v array<double>")

        def change(t: Transaction) -> None:
            t.overwrite(self.table("books"), table.coalesce(1))
            for what in ("codes", "vectors"):
                t.replace(self.table(what), {})
            self._add(t, rows, books)

        self.store.run(change)

    def insert(self, vectors: DataFrame) -> None:
        """Indexes more vectors by the books as they are; by the new ones, if they are made anew meanwhile."""
        self.store.run(lambda t: self._add(t, vectors.filter("embedding IS NOT NULL"), self.books(t.read(self.table("books")))))

    def delete(self, ids: DataFrame) -> None:
        """Removes vectors (vec_id), any number of them, from codes and vectors in one commit."""
        self.store.run(lambda t: [t.delete_keys(self.table(what), (ids, ["vec_id"])) for what in ("codes", "vectors")])

    def books(self, table: DataFrame | None = None) -> Books:
        rows = (table if table is not None else self.store.read(self.table("books"))).collect()
        centres = np.array([r.v for r in sorted((r for r in rows if r.kind == "centre"), key=lambda r: r.m)])
        words = [r for r in rows if r.kind == "word"]
        out = np.zeros((max(r.m for r in words) + 1, WORDS, PART))
        for r in words:
            out[r.m, r.w] = r.v
        return Books(centres, out)

    def _add(self, t: Transaction, vectors: DataFrame, books: Books) -> None:
        own = self.spark.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    list_, code, error, radius = own.value.encode(_floats(batch.column(1)))
                    yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "list": pa.array(list_, pa.int32()), "code": pa.array([c.tobytes() for c in code], pa.binary()), "error": pa.array(error), "radius": pa.array(radius)})

        rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
        codes = map_arrow(rows, run, _CODES).withColumn("of_list", F.col("list"))
        t.put(self.table("codes"), self.store.write_folder(self.table("codes"), codes.repartition("of_list"), "of_list"))
        by_id = rows.withColumn("of_id", F.pmod(F.xxhash64("vec_id"), F.lit(self.buckets)).cast("int"))
        t.put(self.table("vectors"), self.store.write_folder(self.table("vectors"), by_id.repartition("of_id"), "of_id"))

    # searching

    def _read(self, what: str, state: State) -> DataFrame:
        """A table of the index; where all was deleted, no rows."""
        rows = self.store.read(self.table(what), state=state)
        return rows if rows is not None else self.spark.createDataFrame([], {"codes": _CODES, "vectors": "vec_id long, embedding array<double>"}[what])

    def _probed(self, queries: DataFrame, books, probes: int) -> DataFrame:
        """queries (query_id, embedding) with the lists to search: one row each."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    score = _floats(batch.column(1)) @ books.value.centres.T
                    lists = np.argsort(-score, axis=1, kind="stable")[:, :probes]
                    at = np.repeat(np.arange(batch.num_rows), lists.shape[1])
                    yield pa.RecordBatch.from_pydict({"query_id": batch.column(0).take(pa.array(at)), "embedding": batch.column(1).take(pa.array(at)), "list": pa.array(lists.ravel().astype(np.int32))})

        return map_arrow(queries, run, "query_id long, embedding array<double>, list int")

    def _meet(self, probed: DataFrame, floor: DataFrame | None, books, best: int, state: State) -> DataFrame:
        """(query_id, vec_id, score by code): of each query the best of a block of codes, or, where `floor` (query_id, least) is
        given, all whose bound reaches it. Codes and queries of a list meet in blocks of bounded size.
        """
        bounded = floor is not None
        probed = probed.withColumn("least", F.lit(None).cast("double")) if not bounded else probed.join(floor, "query_id")
        asked = {r[0] for r in probed.select("list").distinct().collect()}
        entries = {f: e for f, e in state.tables[self.table("codes")].items() if e["bucket"] in asked}
        if not entries:
            return self.spark.createDataFrame([], "query_id long, vec_id long, score double")
        rows = {i: sum(e["rows"] for e in entries.values() if e["bucket"] == i) for i in asked}
        of_list = self.spark.createDataFrame([(i, -(-n // BLOCK) or 1) for i, n in rows.items()], "list int, blocks int")
        turns = max(1, -(-probed.select("query_id").distinct().count() // QUERIES))
        codes = self.store.open(entries).join(F.broadcast(of_list), "list")
        codes = codes.select("vec_id", "list", "code", "error", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
        sides = probed.join(F.broadcast(of_list), "list").select("query_id", "embedding", "least", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int").alias("turn"))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            a, b, c = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            if left.num_rows and right.num_rows:
                own = books.value
                q, ids, vec = products.matrix(right.column("embedding")), right.column("query_id").to_numpy(), left.column("vec_id").to_numpy()
                code = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(vec), -1)
                x = own.decode(left.column("list").to_numpy(), code)
                if not bounded:
                    at, which, c = products.best(q, x, best)
                else:
                    least = right.column("least").to_numpy(zero_copy_only=False)
                    found = [(at + i, which, c) for i, at, which, c in _reaching(q, x, left.column("error").to_numpy(), least)]
                    at, which, c = (np.concatenate(f) for f in zip(*found, strict=True))
                a, b = ids[at], vec[which]
            return pa.Table.from_pydict({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

        keys = ("list", "block", "turn")
        return codes.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")

    def _scored(self, pairs: DataFrame, queries: DataFrame, state: State) -> DataFrame:
        """pairs (query_id, vec_id) with their inner product."""
        vectors = self._read("vectors", state).select("vec_id", F.col("embedding").alias("v"))
        both = pairs.select("query_id", "vec_id").join(vectors, "vec_id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
        dot = F.aggregate(F.zip_with("v", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
        return both.select("query_id", "vec_id", dot.alias("score"))

    @staticmethod
    def _ranked(scored: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return scored.withColumn("rank", rank).filter(F.col("rank") <= k)

    def shortlist(self, queries: DataFrame, probes: int = PROBES, size: int = SHORTLIST, state: State | None = None) -> DataFrame:
        """(query_id, vec_id): of each query (query_id, embedding) the best by code in the lists nearest to it."""
        prepare(self.spark)
        state = state or self.store.state()
        books = self.spark.sparkContext.broadcast(self.books(self._read("books", state)))
        own = queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"))
        return self._ranked(self._meet(self._probed(own, books, probes), None, books, size, state), size).select("query_id", "vec_id")

    def search(self, queries: DataFrame, k: int = TOP_K, probes: int = PROBES, size: int = SHORTLIST, state: State | None = None, short: DataFrame | None = None) -> DataFrame:
        """The k vectors of highest inner product with each query, nearly always: query_id, vec_id, score, rank. Only a short list is scored exactly, which may be given."""
        state = state or self.store.state()
        return self._ranked(self._scored(short if short is not None else self.shortlist(queries, probes, size, state), queries, state), k)

    def candidates(self, queries: DataFrame, k: int = TOP_K, probes: int = PROBES, size: int = SHORTLIST, state: State | None = None) -> DataFrame:
        """(query_id, vec_id): all vectors that can be among a query's k best, by the bounds of their codes.

        The k-th best of the short list is a floor of the true k-th best. Lists whose centre and radius cannot reach it are
        left out whole, and of the others the codes that cannot.
        """
        state = state or self.store.state()
        near, kept, books = self._near(queries, k, probes, size, state)
        return self._meet(near, kept.select("query_id", "least"), books, 0, state).select("query_id", "vec_id")

    def _near(self, queries: DataFrame, k: int, probes: int, size: int, state: State, short: DataFrame | None = None):
        """(queries with each list that can reach their floor, queries with their floor, books)."""
        books = self.spark.sparkContext.broadcast(self.books(self._read("books", state)))
        own = queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"))
        floor = self.search(queries, k, probes, size, state, short).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("least"))
        reach = {r["list"]: r["radius"] for r in self._read("codes", state).groupBy("list").agg(F.max("radius").alias("radius")).collect()}
        radius = self.spark.sparkContext.broadcast(reach)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    q, least = _floats(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
                    lists = np.array(sorted(radius.value), np.int64)
                    most = q @ books.value.centres[lists].T + np.linalg.norm(q, axis=1)[:, None] * np.array([radius.value[i] for i in lists])
                    at, which = np.nonzero(most >= least[:, None] - 1e-9)
                    yield pa.RecordBatch.from_pydict({"query_id": batch.column(0).take(pa.array(at)), "embedding": batch.column(1).take(pa.array(at)), "list": pa.array(lists[which].astype(np.int32))})

        kept = own.join(floor, "query_id", "left").select("query_id", "embedding", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        kept = stored(kept, "floors")
        return map_arrow(kept, run, "query_id long, embedding array<double>, list int"), kept, books

    def exact(self, queries: DataFrame, k: int = TOP_K, probes: int = PROBES, size: int = SHORTLIST, short: DataFrame | None = None) -> DataFrame:
        """The k vectors of highest inner product with each query, ties by id: query_id, vec_id, score, rank.

        As candidates, but what reaches the floor is scored where vectors of a list meet its queries, so that k rows of each
        query leave a block and no candidate is shuffled.
        """
        state = self.store.state()
        near, kept, books = self._near(queries, k, probes, size, state, short)
        turns = max(1, -(-kept.count() // QUERIES))
        codes = self._read("codes", state)
        vectors = self._read("vectors", state).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).join(codes.select("vec_id", "list", "code", "error"), "vec_id")
        of_list = F.broadcast(codes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
        x = vectors.join(of_list, "list").select("vec_id", "embedding", "list", "code", "error", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
        q = near.join(kept.select("query_id", "least"), "query_id").join(of_list, "list").select("query_id", "embedding", "least", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int").alias("turn"))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            a, b, c = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            if left.num_rows and right.num_rows:
                ids, vec = right.column("query_id").to_numpy(), left.column("vec_id").to_numpy()
                order = np.argsort(vec, kind="stable")
                x, q = products.matrix(left.column("embedding"))[order], products.matrix(right.column("embedding"))
                error, least = left.column("error").to_numpy(), right.column("least").to_numpy(zero_copy_only=False)
                code = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(vec), -1)[order]
                reached = np.zeros(len(x), bool)
                for _, _, which, _ in _reaching(q, books.value.decode(left.column("list").to_numpy(), code), error[order], least):
                    reached[which] = True
                some = np.flatnonzero(reached)
                if len(some):
                    at, which, c = products.best(q, x[some], k)
                    a, b = ids[at], vec[order[some[which]]]
            return pa.Table.from_pydict({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

        keys = ("list", "block", "turn")
        return self._ranked(x.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double"), k)

import pytest

from graphloom.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """By rounds: share what is left among sources that are not full, stop the ones that are over, again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, out = set(), dict.fromkeys(names, 0.0)
    while len(full) < len(names):
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        level = left / sum(w[s] for s in names if s not in full)
        over = {s for s in names if s not in full and level * w[s] > most * sizes[s]}
        out = {s: most * sizes[s] if s in full | over else level * w[s] for s in names}
        if not over:
            break
        full |= over
    return out


CASES = [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, None: 5}, {"z": 5}, {"é": 7, "z": 7, "Z": 70, "src10": 3, "src2": 900}, {"a": 0, "b": 0}, {"a": 0, "b": 9}, {}]


@pytest.mark.parametrize("sizes", CASES)
def test_targets_equal_brute_force(spark, sizes):
    rows = [(s, n - n // 2) for s, n in sizes.items()] + [(s, n // 2) for s, n in sizes.items()]
    got = {r.source: r for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = plain_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    assert got.keys() == sizes.keys()
    for s, r in got.items():
        assert r.source_size == sizes[s]
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.rate <= 3


ODD = [(None, None, None), (None, "a b", "s"), (1, "", "s"), (2, " \t", None), (3, "one", "s"), (3, "one", "s"), (4, "w " * 50_000, "t"), (5, "\x0b\x0cé\x85ü x", "")]


def test_rows_and_copies(spark):
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in ODD], "doc_id long, text string, source string, taken int, rate double")
    got = mixing.mix(docs).collect()
    assert len(got) == len(ODD)
    assert sorted(r.size for r in got) == [0, 0, 0, 1, 1, 2, 2, 50_000]
    for r in got:
        assert r.taken == r.size * r.copies <= 3 * r.size
        assert r.copies in (int(r.rate), int(r.rate) + 1)
    emitted = mixing.emit(docs).collect()
    assert emitted and len(emitted) == sum(r.copies for r in got)
    assert mixing.emit(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0 == mixing.emit(docs.limit(0)).count()


def test_totals_come_near_targets_and_reruns_agree(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet")
    a = mixing.mix(docs).toPandas()
    b = mixing.mix(docs.repartition(7)).toPandas()
    assert a.sort_values("doc_id").taken.tolist() == b.sort_values("doc_id").taken.tolist()
    per = a.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(per.taken - per.target) <= 0.15 * per["size"]).all()
    assert abs(per.target.sum() - per["size"].sum()) < 1

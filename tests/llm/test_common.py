import pytest

from graphloom.llm import common


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("few", [True, False])
def test_attach_is_a_join_with_equal_nulls(spark, monkeypatch, few, how):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1000 if few else 2)
    big = spark.createDataFrame([(i % 7 if i % 11 else None, "b" if i % 2 else None, i) for i in range(300)] + [(99, "b", 300)], "k long, s string, n long")
    small = spark.createDataFrame([(k, s, f"{k}{s}") for k in (*range(7), None) for s in ("b", None)], "k long, s string, v string")
    got = common.attach(big, small, ["k", "s"], how).collect()
    want = [(r.k, r.s, r.n, f"{r.k}{r.s}" if r.n < 300 else None) for r in big.collect() if how == "left" or r.n < 300]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_attach_broadcasts_no_copies_of_many_rows(spark, monkeypatch, tmp_path, how):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 100)
    spark.range(200).selectExpr("id AS k", "id % 2 AS v").write.parquet(f"{tmp_path}/small")
    got = common.attach(spark.range(300).toDF("k"), spark.read.parquet(f"{tmp_path}/small"), ["k"], how)
    assert sorted((r.k, r.v) for r in got.collect() if r.v is not None) == [(k, k % 2) for k in range(200)]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_attach_counted_is_an_inner_join(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 20)
    big = spark.createDataFrame([(i % 50 if i % 2 else 7, i) for i in range(400)], "k long, n long")
    small = big.groupBy("k").count().withColumnRenamed("count", "c")
    got = common.attach_counted(big, small.withColumn("v", small.k * 2), "k", "c").collect()
    assert sorted((r.k, r.n, r.v) for r in got) == sorted((r.k, r.n, 2 * r.k) for r in big.collect())

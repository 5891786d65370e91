import random

from pyspark.sql import functions as F

from graphloom.sources import numbering
from graphloom.sources.numbering import placed


def test_places_equal_sorting_also_of_a_hot_key(spark):
    r = random.Random(1)
    rows = [(r.choice(("a", "a", "a", "b", None, "c")), r.randrange(1000), i, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, i long, place_text string").repartition(6)
    got = placed(df, "k", ["o", "i"])
    assert got.columns == ["k", "o", "i", "place_text", "place", "place_of"]
    groups = {}
    for k, o, i, _ in rows:
        groups.setdefault(k, []).append((o, i))
    want = sorted((str(k), o, i, n, len(g)) for k, g in groups.items() for n, (o, i) in enumerate(sorted(g)))
    assert sorted((str(x.k), x.o, x.i, x.place, x.place_of) for x in got.collect()) == want
    assert placed(df.limit(0), "k", ["o"]).count() == 0


def test_a_key_is_numbered_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(numbering, "shared_folder", lambda spark, kind: f"file://{tmp_path}/n")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = placed(spark.range(40_000).withColumn("k", F.lit("hot")), "k", ["id"])
        assert out.filter("place <> id").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(f"file://{tmp_path}/n/rows").groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 3 and max(f["count"] for f in files) < 20_000

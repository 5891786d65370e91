import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, upkeep
from graphloom.operators.graph_store import Adjacency, GraphStore
from graphloom.sources.store import Store


def test_counters_equal_a_recount_after_any_changes(spark, tmp_path):
    r = random.Random(3)
    store = Store(spark, f"file://{tmp_path}/s", upkeep.FILE_KEYS)
    counters = upkeep.Counters(store, "chunks", "file_id", {"images": F.col("kind") == "image", "named": F.col("name").isNotNull()}, 4)
    assert counters.refresh() == [] and counters.read() is None
    for step in range(9):
        if step % 3 < 2:
            rows = [(f"f{r.randrange(5)}" if r.random() < 0.9 else None, r.choice(("image", "text", None)), r.choice(("n", None))) for _ in range(12)]
            store.run(lambda t: t.append("chunks", spark.createDataFrame(rows, "file_id string, kind string, name string")))
        else:
            store.run(lambda t, f=f"f{r.randrange(5)}": t.delete_where("chunks", "file_id", f))
        before = len(store.folders("chunks"))
        read = counters.refresh()
        assert len(read) <= 2 * before and (step != 1 or len(read) == 1)
        want = store.read("chunks").groupBy("file_id").agg(F.count("*").alias("total"), F.count_if(F.col("kind") == "image").alias("images"), F.count("name").alias("named"))
        assert sorted(map(str, counters.read().collect())) == sorted(map(str, want.select(*counters.read().columns).collect()))
    assert counters.refresh() == []


def filed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", upkeep.FILE_KEYS)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    for f in ("f", "g"):
        store.run(lambda t: [
            t.append("files", frame([(f,)], "file_id string")),
            t.append("chunks", frame([(f, f"{f}1"), (f, f"{f}2")], "file_id string, chunk_id string")),
            t.append("media", frame([(f"{f}1", b"x")], "chunk_id string, bytes binary")),
            t.append("nodes", frame([("L", f"node {f}", f)], "label string, name string, file_id string")),
            t.append("edges", frame([("L", "node f", "L", "node g", f)], "src_label string, subject string, dst_label string, object string, file_id string")),
        ])
    return store


def test_a_file_is_deleted_everywhere_or_nowhere(spark, tmp_path, monkeypatch):
    store = filed(spark, tmp_path)
    before = {t: sorted(store.folders(t)) for t in upkeep.FILE_KEYS}
    for stop in range(3):
        real, calls = Store.write_folder, []

        def failing(self, *args, real=real, calls=calls, stop=stop, **kwargs):
            calls.append(1)
            if len(calls) > stop:
                raise RuntimeError("lost")
            return real(self, *args, **kwargs)

        monkeypatch.setattr(Store, "write_folder", failing)
        try:
            t = store.begin()
            upkeep.delete_file(t, "f")
        except RuntimeError:
            pass
        monkeypatch.undo()
        assert {t: sorted(store.folders(t)) for t in upkeep.FILE_KEYS} == before
    opened = {}
    store.run(lambda t: opened.update(upkeep.delete_file(t, "f")))
    assert opened["chunks"] == opened["files"] == 1
    left = {t: store.read(t).count() if store.read(t) is not None else 0 for t in upkeep.FILE_KEYS}
    assert left == {"files": 1, "chunks": 2, "vectors": 0, "media": 1, "nodes": 1, "edges": 0}


def test_later_relations_find_stored_nodes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    own = GraphStore(store, 8)
    mention = lambda rows: spark.createDataFrame(rows, "type string, name string, file_id string, confidence double, source_type string, seq long")
    store.run(lambda t: own.upsert(t, mention([("P", "Ann", "f1", 0.8, "text", 1), ("Q", "Ann", "f1", 0.7, "text", 2)])))
    store.run(lambda t: own.upsert(t, mention([("P", "Bob", "f2", 0.8, "text", 3), ("P", " Ann ", "f2", None, None, 4)])))
    rel = spark.createDataFrame([("Ann", "knows", "Bob", "f2", None, 5), ("Ann", "knows", "Nobody", "f2", None, 6)], "subject string, predicate string, object string, file_id string, confidence double, seq long")
    written = []
    store.run(lambda t: written.append(own.upsert(t, None, rel)))
    assert [len(b) for b in written[0].values()] == [1]
    assert sorted((x.label, x.name, x.file_id) for x in own.nodes.read().collect()) == [("P", "Ann", "f2"), ("P", "Bob", "f2"), ("Q", "Ann", "f1")]
    assert sorted((x.src_label, x.rel_type, x.dst_label, x.object) for x in own.edges.read().collect()) == [("P", "KNOWS", "P", "Bob"), ("Q", "KNOWS", "P", "Bob")]
    lists = own.adjacency(4)
    assert lists.trails(spark.createDataFrame([("Bob",)], "term string")).filter("hops = 1").count() == 2
    lists.drop()


@pytest.mark.parametrize("seed", range(3))
def test_stored_trails_equal_trails(spark, tmp_path, seed):
    r = random.Random(seed)
    names = "abcdefgh"
    edges = spark.createDataFrame([(f"e{r.randrange(100)}-{i}", r.choice(names), r.choice(names)) for i in range(14)], "edge_id string, src string, dst string")
    starts = spark.createDataFrame([(x,) for x in "abz"], "term string")
    lists = Adjacency(edges, f"file://{tmp_path}/adj", 4, 16)
    for most in (2, 10):
        want = graph.trails(edges, starts, 3, most)
        assert sorted(map(str, lists.trails(starts, 3, most).select(*want.columns).collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        lists.trails(starts, 3, 15)
    lists.drop()


def test_a_hub_is_read_in_slices_and_edges_are_not_shuffled(spark, tmp_path):
    n = 100_000
    hub = spark.range(n).select(F.format_string("e%06d", "id").alias("edge_id"), F.lit("hub").alias("src"), F.concat(F.lit("n"), "id").alias("dst"))
    lists = Adjacency(hub, f"file://{tmp_path}/adj", 8, 1000)
    rows = lists.read().filter("node = 'hub'")
    assert rows.count() == 100 and rows.agg(F.max("degree"), F.max(F.size("edges"))).first()[:2] == (n, 1000)
    got = lists.trails(spark.createDataFrame([("hub",), ("n7",)], "term string"), 2, 10)
    assert [r.nodes for r in got.filter("term = 'hub'").orderBy("key").collect()] == [f"hub>n{i}" for i in range(10)]
    assert sorted(r.nodes for r in got.filter("term = 'n7' and hops = 2").collect())[0] == "n7>hub>n0"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lists.trails(spark.createDataFrame([("hub",)], "term string"), 1, 10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"Bucketed: true", plan)
    assert len(re.findall(r"Exchange hashpartitioning\(end", plan)) == 1 and not re.search(r"Exchange hashpartitioning\(node", plan)
    lists.drop()


def test_counters_follow_after_old_folders_are_deleted(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", upkeep.FILE_KEYS)
    counters = upkeep.Counters(store, "chunks", "file_id", {}, 4)
    chunks = lambda *files: spark.createDataFrame([(f,) for f in files], "file_id string")
    store.run(lambda t: t.append("chunks", chunks("f", "f", "g")))
    counters.refresh()
    store.run(lambda t: t.delete_where("chunks", "file_id", "f"))
    store.run(lambda t: t.append("chunks", chunks("h")))
    store.vacuum()
    assert len(counters.refresh()) == 3
    assert sorted((r.file_id, r.total) for r in counters.read().collect()) == [("g", 1), ("h", 1)]
    assert store.vacuum() > 0 and counters.refresh() == []


def test_a_graph_takes_more_after_a_file_was_deleted(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", upkeep.FILE_KEYS)
    own = GraphStore(store, 4)
    mention = lambda rows, first=0: spark.createDataFrame([("P", n, f, 0.8, "text", first + i) for i, (n, f) in enumerate(rows)], "type string, name string, file_id string, confidence double, source_type string, seq long")
    rel = lambda rows: spark.createDataFrame([(a, "knows", b, f, None, i) for i, (a, b, f) in enumerate(rows)], "subject string, predicate string, object string, file_id string, confidence double, seq long")
    store.run(lambda t: own.upsert(t, mention([(n, "f") for n in "abcd"] + [(n, "g") for n in "efgh"])))
    store.run(lambda t: own.upsert(t, None, rel([("a", "e", "g"), ("e", "f", "g"), ("g", "h", "f"), ("h", "e", "g")])))
    store.run(lambda t: upkeep.delete_file(t, "f"))
    assert sorted(r.name for r in own.nodes.read().collect()) == list("efgh")
    assert sorted((r.subject, r.object) for r in own.edges.read().collect()) == [("e", "f"), ("h", "e")]
    store.run(lambda t: own.upsert(t, mention([("a", "i"), ("e", "i")], 100)))
    store.run(lambda t: own.upsert(t, None, rel([("a", "e", "i"), ("b", "e", "i")])))
    assert sorted((r.name, r.file_id) for r in own.nodes.read().collect()) == [("a", "i"), ("e", "i"), ("f", "g"), ("g", "g"), ("h", "g")]
    assert sorted((r.subject, r.object) for r in own.edges.read().collect()) == [("a", "e"), ("e", "f"), ("h", "e")]

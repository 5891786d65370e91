import json
import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.operators import answers, catalog, files, graph, ingest, retrieval, sessions, tables
from graphloom.sources import config, providers
from graphloom.sources import tables as src
from graphloom.streaming import jobs


def test_entities_merge(spark):
    e = spark.createDataFrame([("Acme", "T", "text", 0.8, 1, ["c1"]), ("ACME ", "T", "text", 0.9, 2, ["c2"]), ("X", "T", "text", 0.5, 3, ["c1"])], "name string, type string, source_type string, confidence double, seq long, source_chunks array<string>")
    classes, members = graph.entity_classes(e)
    got = {r.name: r for r in classes.collect()}
    assert got["ACME "].merged_count == 2 and got["X"].merged_count is None
    assert sorted((r.key, r.chunk) for r in members.collect()) == [("acme", "c1"), ("acme", "c2"), ("x", "c1")]
    rel = spark.createDataFrame([("Acme", "OWNS", "X", 1), ("ACME ", "OWNS", "X", 2), ("ACME ", "OWNS", "X", 3)], "subject string, predicate string, object string, seq long")
    assert [tuple(r) for r in graph.filter_relations(rel, classes).collect()] == [("ACME ", "OWNS", "X", 2)]


def test_upsert_and_delete(spark):
    n = spark.createDataFrame([("PERSON", "Ann", "f1", 0.8, "text", 1), ("PERSON", " Ann ", "f2", 0.8, "text", 2)], "type string, name string, file_id string, confidence double, source_type string, seq long")
    nodes = graph.upsert_nodes(n)
    assert [(r.name, r.file_id) for r in nodes.collect()] == [("Ann", "f2")]
    rel = spark.createDataFrame([("Ann", None, "Ann", "f1", None, 1)], "subject string, predicate string, object string, file_id string, confidence double, seq long")
    left = graph.detach_delete(nodes, graph.upsert_edges(rel, nodes), "f2")
    assert [x.count() for x in left] == [0, 0]


def brute_trails(edges, start, hops):
    out, now = [], [((), start)]
    for _ in range(hops):
        now = [(p + (i,), b if a == at else a) for p, at in now for i, a, b in edges if i not in p and at in (a, b)]
        out += now
    return out


@pytest.mark.parametrize("seed", range(3))
def test_trails_equal_brute_force(spark, seed):
    r = random.Random(seed)
    edges = [(f"e{i}", r.choice("abcdef"), r.choice("abcdef")) for i in range(7)] if seed else [("1", "x", "y"), ("2", "y", "z"), ("3", "x", "y")]
    start = "a" if seed else "x"
    got = graph.trails(spark.createDataFrame(edges, "edge_id string, src string, dst string"), spark.createDataFrame([(start,)], "term string"), 3, 10_000).collect()
    assert sorted(x.key for x in got) == sorted(">".join(p) for p, _ in brute_trails(edges, start, 3))
    few = graph.trails(spark.createDataFrame(edges, "edge_id string, src string, dst string"), spark.createDataFrame([(start,)], "term string"), 3, 2).collect()
    assert sorted((x.hops, x.key) for x in few) == sorted((x.hops, x.key) for x in got)[:2]


def test_model_answers(spark):
    rows = [('```json\n{"entities": [{"name": " A ", "type": "T"}]}\n```',), ('{"entities": [{"name": "B", "type": null}, {"name": "C", "type": "T"}]}',), ("no json",), (None,)]
    got = [r.e for r in spark.createDataFrame(rows, "r string").select(graph.parse_entities(F.col("r")).alias("e")).collect()]
    assert [[tuple(x) for x in e] for e in got] == [[("A", "T", 0.8)], [("C", "T", 0.8)], [], []]


TABLE = [["a", "b"], ["1", None]]


def test_tables(spark):
    t = spark.createDataFrame([("c", TABLE), ("d", [[None, "b"], ["1", "2"]]), ("e", [["w", "x", "y", "z"], ["", None, "1", "2024-01-01"], ["", "1", "2%", ""], ["9"]])], "chunk_id string, table_data array<array<string>>")
    c = F.col("table_data")
    got = {r.chunk_id: r for r in t.select("chunk_id", tables.formatted(c, F.lit(0), F.lit(0)).alias("f"), tables.summary(c).alias("s"), tables.column_types(c).alias("k"), tables.insights(c).alias("i")).collect()}
    assert got["c"].f == "表格(第1页，表1)：\n表头：a | b\n第1行：1 | None"
    assert got["c"].s == "包含1行2列数据，主要字段：a, b" and got["c"].i == ["数据维度：1行×2列", "a平均值：1.00"]
    assert got["d"].s == "摘要生成失败"
    assert got["e"].k == ["number", "text", "number", "date"]


def fused(spark):
    v = spark.createDataFrame([("t", "f", "text " * 20, "text", 0.95, 1), ("i", "f", "an image " * 12, "image", 0.72, 2)], "chunk_id string, file_id string, content string, content_type string, score double, seq long")
    g = spark.createDataFrame([("a>b", 1)], "path string, seq long")
    return retrieval.fuse(v, g)


def test_fusion_and_answers(spark):
    own = fused(spark)
    assert [r.content_type for r in own.orderBy("rank").collect()] == ["graph", "image", "text"]
    assert [r.chunk_id for r in retrieval.media_map(own).collect()] == ["i"]
    kinds = [json.loads(x.removeprefix("data: "))["type"] for x in answers.frames("图?", own)]
    assert kinds[0] == "thinking_text" and kinds[-2:] == ["answer_multimedia", "answer_complete"]
    assert answers.direct_answer("q", own)["sources"][0]["type"] == "graph"
    out = answers.structured_answer("图", own)
    assert [s["section"] for s in out["sections"]] == ["images", "text_summary"] and len(out["recommendations"]) == 3
    assert answers.media_instructions([]) == ""
    assert sessions.prompt("q", "d").startswith("基于") and "对话历史" in sessions.prompt("q", "d", "h")


def test_search_of_many_queries_equals_one_by_one(spark, sf):
    v = src.load(spark, sf, "embeddings").select("vec_id", "embedding")
    many = retrieval.top_k_of_each(v, v.filter("vec_id < 4").select(F.col("vec_id").alias("query_id"), "embedding")).collect()
    for q in range(4):
        one = [r.vec_id for r in retrieval.top_k(v, v.filter(F.col("vec_id") == q)).collect()]
        assert one == [r.vec_id for r in sorted((r for r in many if r.query_id == q), key=lambda r: r.rank)]
    indexed, centres = retrieval.inverted_file(v, 8)
    hits = sum(len({r.vec_id for r in retrieval.probed_top_k(indexed, centres, v.filter(F.col("vec_id") == q), probes=6).collect()} & {r.vec_id for r in many if r.query_id == q}) for q in range(4))
    assert hits >= 0.9 * 20


def pages(spark):
    rows = [("f1", 0, "Alice Smith met Bob.\n\nThey talked about Paris.", [[["Name", "Age"], ["Alice", "30"], ["Bob", "x1"]], [["only"]]], [(60, 60, 3, 0, "png", bytearray(b"p")), (10, 60, 3, 0, "png", bytearray(b"q")), (60, 60, 4, 0, "png", bytearray(b"r"))], [("bar", {"x": "Year"}, ["Sales", " "])]), ("f1", 1, " ", None, None, None)]
    return spark.createDataFrame(rows, ingest.PAGES)


def test_ingestion(spark):
    chunks = ingest.multimodal_chunks(pages(spark))
    got = [r.chunk_id for r in chunks.orderBy("page_number", "kind_order", "chunk_index").collect()]
    assert got == ["f1_page_0_text_0", "f1_page_0_image_0", "f1_page_0_table_0", "f1_page_0_chart_0"]
    assert {r.chunk_id for r in ingest.vectors(chunks).collect()} == {got[0], got[2], got[3]}
    entities, relations = ingest.knowledge(chunks)
    names = {r.name: r for r in entities.collect()}
    assert {"Alice Smith", "Name", "Age", "Alice", "Bob", "x1", "Year", "Sales"} <= names.keys()
    assert names["Bob"].merged_count == 2
    assert sorted((r.subject, r.predicate, r.object) for r in relations.collect()) == [("Alice Smith", "RELATED_TO", "Bob"), ("Name", "RELATED_FIELD", "Age"), ("They", "RELATED_TO", "Paris")]
    media = chunks.filter("media_bytes is not null").select("chunk_id", F.col("media_format").alias("extension"), F.col("media_bytes").alias("bytes"))
    shown = {r.chunk_id: r.media_status for r in src.with_media(chunks.select("chunk_id"), media).collect()}
    assert shown[got[1]] == "loaded" and shown[got[0]] == "failed"


class Camera:
    """Sees a lamp in each picture and reads its bytes."""

    def read(self, picture):
        return [(picture.decode(), 0.9), ("", 0.1)]

    def analyse(self, picture):
        return {"scene": "room", "objects": ["Lamp", " "]}

    def charts(self, picture):
        return [{"chart_type": "pie", "axis_labels": {"x": "Year"}, "legend_info": ["North"]}] if picture else []


def test_pictures_and_charts_are_analysed(spark):
    images = ingest.image_chunks(pages(spark).withColumn("images", F.transform("images", lambda i: i.withField("bytes", F.lit("Acme Corp met Zed").cast("binary")))))
    seen = providers.analyse_images(images, Camera(), Camera())
    r = seen.first()
    assert (r.description, r.scene, r.objects_detected, r.text_content) == ("图像(第1页)：尺寸60x60，包含文字：Acme Corp met Zed", "room", ["Lamp", " "], "Acme Corp met Zed")
    plain = providers.analyse_images(images).first()
    assert (plain.description, plain.objects_detected, plain.text_content) == ("图像(第1页)：尺寸60x60", [], "")
    chunks = seen.unionByName(ingest.table_chunks(pages(spark)), allowMissingColumns=True).unionByName(ingest.chart_chunks(pages(spark)), allowMissingColumns=True)
    entities, relations = ingest.knowledge(chunks)
    kinds = {r.name: r.type for r in entities.collect()}
    assert kinds["Lamp"] == "IMAGE_OBJECT" and kinds["Acme Corp"] == kinds["Zed"] == "NAME"
    assert ("Acme Corp", "Zed") in {(r.subject, r.object) for r in relations.collect()}
    found = providers.detect_charts(spark.createDataFrame([("f", 0, bytearray(b"x")), ("f", 1, None)], "file_id string, page_number int, picture binary"), Camera())
    assert [(r.content, r.axis_labels) for r in ingest.chart_chunks(found).collect()] == [("pie", {"x": "Year"})]


class Oracle:
    """Answers with JSON, some of it malformed."""

    def answer(self, prompt):
        if "relations" in prompt:
            yield 'Sure: {"relations": [{"subject": "A", "object": " B "}, {"subject": "", "object": "B"}, {"subject": "A", "predicate": "p", "object": "B", "confidence": 0.5}, 3]}'
        else:
            yield '```json\n{"entities": [{"name": " A ", "type": "T"}, {"name": "B"}, {"name": ""}, "x", {"name": "C", "type": null}]}\n```'


def test_a_model_extracts(spark):
    chunks = spark.createDataFrame([("f", 1, "c1", "one"), ("f", 2, "c2", "two"), ("f", 3, "c3", "")], "file_id string, seq int, chunk_id string, content string")
    found = providers.extracted(chunks, providers.ModelExtractor(Oracle()))
    assert [(r.batch, r.source_chunks, r.name, r.type) for r in providers.text_entities(found).orderBy("batch", "name").collect()][:2] == [(0, ["c1", "c2"], "A", "T"), (0, ["c1", "c2"], "B", "UNKNOWN")]
    assert {(r.subject, r.predicate, r.object, r.confidence) for r in providers.text_relations(found).collect()} == {("A", "RELATED_TO", "B", 0.8), ("A", "p", "B", 0.5)}
    silent = providers.ModelExtractor(providers.EchoModel())
    assert silent.entities("no json { here") == [] and silent.relations("x", []) == []


def test_relations_of_model_answers(spark):
    rows = [('{"relations": [{"subject": " A", "predicate": null, "object": "B "}, {"subject": " ", "object": "C"}, {"subject": "D"}]}',), ("none",), (None,)]
    got = [[tuple(x) for x in r.e] for r in spark.createDataFrame(rows, "r string").select(graph.parse_relations(F.col("r")).alias("e")).collect()]
    assert got == [[("A", "RELATED_TO", "B", 0.8)], [], []]


def test_properties_merge(spark):
    w = spark.createDataFrame([("L", "n", {"a": "1", "b": "2"}, 1), ("L", "n", {"a": "3", "b": None, "c": "4"}, 2), ("L", "m", None, 1), ("L", "m", {}, 2)], "label string, name string, props map<string,string>, seq long")
    assert {r.name: r.props for r in graph.merge_properties(w).collect()} == {"n": {"a": "3", "c": "4"}, "m": {}}


def test_a_question_finds_chunks_and_trails(spark):
    rows = [("c1", "f", "the red house of Ann", '{"type": "image"}'), ("c2", "f", "blue boats at sea", '{"type": "text"}'), ("c3", "g", "", None)]
    vectors = providers.embed(spark.createDataFrame(rows, "chunk_id string, file_id string, content string, metadata string"), "content")
    edges = spark.createDataFrame([("e1", "house", "Ann"), ("e2", "Ann", "town")], "edge_id string, src string, dst string")
    got = retrieval.search(vectors, edges, "the red house of Ann").orderBy("rank").collect()
    assert [(r.type, r.chunk_id, r.path) for r in got] == [("vector", "c1", None), ("graph", None, "house>Ann"), ("graph", None, "house>Ann>town")]
    assert retrieval.search(vectors, edges, "  ").count() == 0
    assert retrieval.search(vectors.limit(0), edges, "red house").count() == 2
    flags = retrieval.media_flags(retrieval.search(vectors, edges, "the red house of Ann")).first()
    assert (flags.has_images, flags.has_tables, flags.media_count, flags.results, flags.kinds) == (True, False, 1, 3, ["graph", "image"])


def test_files_are_registered_and_deleted(spark):
    up = spark.createDataFrame([("a", "x.pdf", 10, 1000), ("b", "x.doc", 10, 1000), ("c", "x.pdf", 1 << 40, 1000), ("d", None, None, 1000)], "file_id string, original_filename string, size long, t long").withColumn("uploaded_at", F.timestamp_seconds("t"))
    rows = files.register(up, "/in/")
    assert {r.file_id: r.success for r in rows.collect()} == {"a": True, "b": False, "c": False, "d": False}
    (kept,) = files.accepted(rows).collect()
    assert (kept.file_path, kept.status, kept.processing_progress, len(kept)) == ("/in/a_1000.pdf", "uploaded", 0, 8)


def test_unified_answer_and_listing(spark):
    out = answers.unified_answer("图?", fused(spark))
    assert list(out["multimedia"]) == ["i"] and (out["has_images"], out["has_tables"], out["has_charts"], out["media_count"]) == (True, False, False, 1)
    chunks = ingest.multimodal_chunks(pages(spark))
    assert [r.content_type for r in retrieval.media_listing(chunks, "f1", "chart").collect()] == ["chart"]
    assert retrieval.media_listing(chunks).count() == 3 and retrieval.media_listing(chunks, "f2").count() == 0


def test_scripts_and_environment(spark, tmp_path):
    script = "CREATE OR REPLACE TEMP VIEW s1 AS SELECT 'a;b' AS x; -- no; end\n;CREATE OR REPLACE TEMP VIEW `s2` AS SELECT * FROM s1 WHERE x <> \"it's;\""
    assert src.run_script(spark, script) == 2 and spark.table("s2").first().x == "a;b"
    got = {r.name: (r.ok, r.advice) for r in src.environment(spark, ["s1", "s9"], [f"file://{tmp_path}", f"file://{tmp_path}/no"], ["json", "no_such_module"]).collect()}
    assert got["s1"] == got["json"] == got[f"file://{tmp_path}"] == (True, None)
    assert [got[k][0] for k in ("s9", f"file://{tmp_path}/no", "no_such_module")] == [False] * 3 and got["s9"][1] == "create the table s9"


def test_settings_by_path(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("search:\n  top_k: 5\n  media: {kinds: [image]}\n")
    (tmp_path / "b.yaml").write_text("x: [1\n")
    c = config.Config(spark, {"app": f"file://{tmp_path}/a.yaml", "bad": f"file://{tmp_path}/b.yaml", "none": f"file://{tmp_path}/c.yaml"})
    assert c.get("app.search.top_k") == 5 and c.get("app.search.media.kinds") == ["image"]
    assert c.get("app.search.top_k.x", 7) == 7 and c.get("bad.x") is None and c.get("none.y", 1) == 1 and c.get("other") is None


def test_page_splitter(spark):
    some = spark.createDataFrame([("f", bytearray("a\fb".encode()))], "file_id string, content binary")
    assert [(r.page_number, r.text) for r in providers.split_pages(some).orderBy("page_number").collect()] == [(0, "a"), (1, "b")]


def test_files_are_read_as_pages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "my.book.txt").write_bytes("one\ftwo".encode())
    (tmp_path / "in" / "empty.txt").write_bytes(b"")  # an empty file has no pages
    got = sorted((r.file_id, r.page_number, r.text) for r in providers.read_pages(spark, f"file://{tmp_path}/in").collect())
    assert got == [("my.book", 0, "one"), ("my.book", 1, "two")]


def test_snapshots(spark, tmp_path):
    s = src.Snapshots(spark, f"file://{tmp_path}/t")
    assert s.read() is None
    s.append(spark.range(3))
    s.append(spark.range(3, 5))
    assert s.delete(F.col("id") == 1).count() == 4
    assert sorted(r.id for r in s.read().collect()) == [0, 2, 3, 4] and len(s.versions()) == 3


def test_snapshots_append_without_rewriting(spark, tmp_path):
    s = src.Snapshots(spark, f"file://{tmp_path}/t")
    s.append(spark.range(3))
    first = s.folders()
    s.append(spark.range(3, 5))
    assert s.folders()[:1] == first and len(s.folders()) == 2
    s.delete(F.col("id") == 4)
    assert s.folders()[:1] == first  # a folder without such rows stays as it is
    s.write(spark.range(1))
    assert [r.id for r in s.read().collect()] == [0] and len(s.folders()) == 1


def test_two_writers_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = f"file://{tmp_path}/t"
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: src.Snapshots(spark, root).append(spark.range(k * 10, k * 10 + 10)), range(6)))
    s = src.Snapshots(spark, root)
    assert sorted(r.id for r in s.read().collect()) == list(range(60)) and len(s.versions()) == 6
    (tmp_path / "t" / "_manifests" / "000000000006").write_text('["half')  # a manifest that is just being written
    assert s.read().count() == 60


def test_vector_table(spark, tmp_path):
    t = src.VectorTable(spark, f"file://{tmp_path}/v", 2)
    assert not t.has_data() and t.of_file("f") is None
    rows = spark.createDataFrame([("f", "c1", "x", None, [1.0, 0.0]), ("g", "c2", "y", None, [0.0, 1.0])], "file_id string, chunk_id string, content string, metadata string, embedding array<float>")
    t.insert(rows)
    t.insert(rows.withColumn("chunk_id", F.concat("chunk_id", F.lit("b"))))
    assert t.has_data() and sorted(r.chunk_id for r in t.of_file("f").collect()) == ["c1", "c1b"]
    assert "PushedFilters: [IsNotNull(file_id), EqualTo(file_id,f)]" in t.of_file("f")._jdf.queryExecution().toString()
    assert t.delete_file("f").count() == 2 and t.of_file("f") is None
    with pytest.raises(Exception, match="dimension"):
        t.insert(rows.withColumn("embedding", F.array(F.lit(1.0).cast("float"))))


def test_media_table(spark, tmp_path):
    chunks = ingest.multimodal_chunks(pages(spark))
    src.write_media(chunks, f"file://{tmp_path}/m")
    assert [(r.chunk_id, r.extension, bytes(r.bytes)) for r in spark.read.parquet(f"file://{tmp_path}/m").collect()] == [("f1_page_0_image_0", "png", b"p")]
    meta = spark.createDataFrame([('{"width": 3, "objects_detected": ["a"], "chart_type": "bar"}',), (None,)], "m string")
    got = meta.select(src.media_metadata(F.col("m"), src.IMAGE_METADATA).alias("i"), src.media_metadata(F.col("m"), src.CHART_METADATA).alias("c")).collect()
    assert (got[0].i.width, got[0].i.objects_detected, got[0].c.chart_type, got[1].i) == (3, ["a"], "bar", None)


def test_csv_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("c", [["a", 'q"uo,te'], [None, "new\nline"]])], "chunk_id string, table_data array<array<string>>")
    src.write_table_csv(t, f"file://{tmp_path}/csv")
    assert src.read_table_csv(spark, f"file://{tmp_path}/csv").first().table_data == [["a", 'q"uo,te'], ["", "new\nline"]]


def test_assertions_and_gateway(spark):
    good = spark.createDataFrame([([1.0, 2.0],)], "embedding array<float>")
    assert src.assert_embeddings(good, 2).count() == 1
    with pytest.raises(Exception, match="dimension"):
        src.assert_embeddings(good, 3).collect()
    assert src.sql(spark, "SELECT id FROM t WHERE id = :k", {"k": 2}, t=spark.range(5)).collect()[0].id == 2
    assert src.missing_tables(spark, ["t", "no_such"]) == ["no_such"]


def test_history_is_bounded(spark):
    m = spark.createDataFrame([(1, i, "user", f"m{i}") for i in range(12)], "s long, turn long, role string, text string")
    assert [r.turn for r in sessions.last_messages(m, "s", "turn").orderBy("turn").collect()] == list(range(2, 12))


def test_stream_equals_batch(spark, sf, tmp_path):
    where = f"{tmp_path}/in"
    m = src.load(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", "text")
    m.repartition(4).write.parquet(where)
    got = {r.session_id: r.history for r in jobs.bounded_history(jobs.source(spark, where, 1), f"{tmp_path}/out", 3).collect()}
    want = {r.session_id: r.history for r in sessions.formatted(sessions.last_messages(m, "session_id", "turn", 3), "session_id", "turn").collect()}
    assert got == want


def test_an_empty_stream_gives_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = spark.createDataFrame([], "file_id string, page_number int, text string").schema
    assert jobs.ingest(jobs.source(spark, f"{tmp_path}/in", schema=schema), f"{tmp_path}/out").count() == 0


def test_sessions_close_and_leave_the_state(spark, tmp_path):
    hours = [0, 1, 40, 41, 90, 91, 200]
    e = spark.createDataFrame([(u, h * 3600) for u in (1, 2) for h in hours] + [(3, 10)], "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
    for k, (a, b) in enumerate(((0, 50), (50, 100), (100, 300))):
        e.filter(F.unix_seconds("ts").between(a * 3600, b * 3600 - 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.source(spark, f"{tmp_path}/in", 1)
    closed = jobs.session_windows(stream, f"{tmp_path}/out")
    both = closed.unionByName(jobs.open_sessions(e, closed))
    key = lambda df: sorted((r.user_id, r.start, r.end, r.n) for r in df.collect())
    assert key(both) == key(jobs._sessions(e, "24 hours"))
    assert closed.count() == 7 and jobs.open_sessions(e, closed).count() == 2  # the last session of each user is open


def test_status_overlay(spark):
    f = spark.createDataFrame([("a", "processing", 3), ("b", "processing", 3), ("c", "odd", 4)], "file_id string, status string, processing_progress long")
    live = spark.createDataFrame([("a", 9, "busy"), ("c", 9, "busy")], "file_id string, progress long, message string")
    got = {r.file_id: (r.progress, r.message) for r in catalog.with_status(f, live).collect()}
    assert got["a"] == (9, "busy") and got["b"][0] == 3 and got["c"] == (4, "状态未知")


def test_search_in_blocks_of_queries(spark, sf):
    v = src.load(spark, sf, "embeddings").select("vec_id", "embedding")
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    rows = lambda n: sorted((r.query_id, r.rank, r.vec_id) for r in retrieval.top_k_of_each(v, q, most_queries=n).collect())
    assert rows(100) == rows(10_000) and len({r[0] for r in rows(100)}) == v.count()


def test_index_on_disk_reads_the_probed_lists(spark, sf, tmp_path):
    v = src.load(spark, sf, "embeddings").select("vec_id", "embedding")
    q = v.filter("vec_id = 3")
    indexed, centres = retrieval.inverted_file(v, 8)
    want = [(r.vec_id, r.score) for r in retrieval.probed_top_k(indexed, centres, q, probes=3).collect()]
    stored, known = retrieval.write_index(indexed, centres, f"file://{tmp_path}/i")
    found = retrieval.probed_top_k(stored, known, q, probes=3)
    assert [(r.vec_id, r.score) for r in found.collect()] == want
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan and "dynamicpruning" in plan


def test_registered_index_search_finds_most_of_the_nearest(spark):
    from graphloom.plans import retrieval_plans

    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        v = src.load(spark, sf, "embeddings").select("vec_id", "embedding")
        q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
        want = {(r.query_id, r.vec_id) for r in retrieval.top_k_of_each(v, q).collect()}
        got = {(r.query_id, r.vec_id) for r in retrieval_plans.r02_ivf_topk(spark, sf).collect()}
        assert {i for i, _ in got} == {i for i, _ in want}
        assert len(got & want) >= 0.9 * len(want)


class Slow:
    """Says a word after each of some pauses, or fails after so many words."""

    def __init__(self, pauses, fails_at=None):
        self.pauses, self.fails_at, self.seen = pauses, fails_at, []

    def answer(self, prompt, temperature=None):
        self.seen.append((prompt, temperature))
        for i, p in enumerate(self.pauses):
            if i == self.fails_at:
                raise RuntimeError("gone")
            time.sleep(p)
            yield f"w{i} "


def test_a_model_is_held_to_its_limits():
    said = lambda m, **o: "".join(providers.LimitedModel(m, **o).answer("q"))
    assert said(Slow([0] * 5)) == "w0 w1 w2 w3 w4 " and said(Slow([0] * 5), max_tokens=2) == "w0 w1 "
    start = time.time()
    assert said(Slow([0, 0, 30]), seconds=0.5) == "w0 w1 " and time.time() - start < 5
    assert said(Slow([0] * 5, fails_at=0)) == "" and said(Slow([0] * 5, fails_at=3)) == "w0 w1 w2 "
    m = Slow([0])
    said(m, temperature=0.2)
    assert m.seen == [("q", 0.2)]
    assert said(providers.EchoModel()) == "q "
    x = providers.ModelExtractor(Slow([0], fails_at=0))
    assert x.entities("t") == [] and x.relations("t", [("a", "T")]) == []


def test_structured_answers(spark):
    class Asked:
        def __init__(self, fails=False):
            self.prompts, self.fails = [], fails

        def answer(self, prompt):
            self.prompts.append(prompt)
            if self.fails and prompt.startswith("请分析"):
                raise RuntimeError("gone")
            yield "said"

    own, m = fused(spark), Asked()
    out = answers.structured_answer("图", own, m, "用户: before")
    image, summary = out["sections"]
    assert (image["section"], image["analysis"], summary["section"], summary["content"]) == ("images", "said", "text_summary", "said")
    assert m.prompts[0].startswith("请分析这些图片的内容") and "an image" in m.prompts[0]
    # the summary is over the whole context and the history
    assert "用户: before" in m.prompts[1] and "文档片段 3" in m.prompts[1] and "相关实体关系信息" in m.prompts[1]
    failed = answers.structured_answer("图", own, Asked(True))
    assert failed["sections"][0]["analysis"] == "分析暂时不可用。" and failed["sections"][1]["content"] == "said"
    assert answers.analysis("table", [], m) == ""


def test_an_answer_searches_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    own = fused(spark)
    once = own.mapInArrow(counted, own.schema)
    for answer in (answers.direct_answer, answers.unified_answer, answers.structured_answer, lambda q, f: list(answers.frames(q, f))):
        before = runs.value
        answer("图", once)
        assert runs.value - before == 3


def test_many_questions_equal_one_by_one(spark):
    words = ["red apple pie", "green pear", "blue sky", "apple tart", "an old map"]
    v = spark.createDataFrame([(f"c{i}", "f", w, '{"type": "%s"}' % ("image" if i == 3 else "text")) for i, w in enumerate(words * 3)], "chunk_id string, file_id string, content string, metadata string")
    v = providers.embed(v, "content")
    edges = spark.createDataFrame([("e1", "apple", "fruit"), ("e2", "pear", "fruit"), ("e3", "map", "paper")], "edge_id string, src string, dst string")
    asked = ["apple pie", " ", "green pear", "map of the sky", "nothing known"]
    many = retrieval.search_each(v, edges, spark.createDataFrame([(i, q) for i, q in enumerate(asked)] + [(9, None)], "question_id long, question string"), threshold=0.3).collect()
    cols = ("rank", "type", "content_type", "chunk_id", "content", "metadata", "path")
    for i, q in enumerate(asked):
        one = retrieval.search(v, edges, q, threshold=0.3).collect()
        assert sorted(str([r[c] for c in cols]) for r in many if r.question_id == i) == sorted(str([r[c] for c in cols]) for r in one)
    assert {r.question_id for r in many} == {0, 2, 3}


def test_details_of_fused_results(spark):
    hits = spark.createDataFrame([("i", "f", "", "image", 0.9, 1, '{"width": 7}'), ("t", "f", "sum", "table", 0.8, 2, '{"data_types": ["number"]}'), ("u", "f", "sum", "table", 0.7, 3, None), ("x", "f", "text", "text", 0.6, 4, None)], "chunk_id string, file_id string, content string, content_type string, score double, seq long, metadata string")
    tables_ = spark.createDataFrame([("t", [["a"], ["1"]])], "chunk_id string, table_data array<array<string>>")
    got = {r.chunk_id: r for r in retrieval.with_details(retrieval.fuse(hits, spark.createDataFrame([("a>b", 1)], "path string, seq long")), tables_).collect()}
    assert got["i"].image.width == 7 and got["i"].table is None and got["x"].image is None
    assert (got["t"].table.rows, got["t"].table.data_types, got["t"].table.status, got["u"].table.status) == (1, ["number"], "loaded", "failed")
    assert got[None].path == "a>b" and got[None].table is None


def test_vectors_of_another_dimension_take_the_place_of_the_old(spark, tmp_path):
    rows = lambda n, c: spark.createDataFrame([("f", c, "x", None, [1.0] * n)], "file_id string, chunk_id string, content string, metadata string, embedding array<float>")
    t = src.VectorTable(spark, f"file://{tmp_path}/v", 2)
    t.insert(rows(2, "a"))
    t.insert(rows(2, "b"))
    assert t.read().count() == 2
    with pytest.raises(Exception, match="dimension"):
        t.insert(rows(3, "c"))
    u = src.VectorTable(spark, f"file://{tmp_path}/v", 3)
    u.insert(rows(3, "c"))
    u.insert(rows(3, "d"))
    assert sorted(r.chunk_id for r in u.read().collect()) == ["c", "d"]

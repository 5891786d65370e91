import random

from pyspark.sql import functions as F

from graphloom.operators import graph, ingest
from graphloom.plans.catalogue import QUERIES


def in_order(mentions, relations):
    """Entities and relations of one file from lists in order of arrival."""
    groups = {}
    for name, kind, source, confidence, chunks in mentions:
        groups.setdefault(name.lower().strip(), []).append((name, kind, source, confidence or 0.0, chunks))
    best = {k: max(g, key=lambda m: m[3]) for k, g in groups.items()}  # max gives the first of equals
    names = {b[0] for b in best.values()}
    first = {}
    for s, p, o, mark in relations:
        if s in names and o in names:
            first.setdefault((s, p, o), mark)
    return {k: (*best[k][:4], len(g) if len(g) > 1 else None, sorted({c for m in g for c in m[4]})) for k, g in groups.items()}, first


def test_classes_and_relations_equal_a_loop_in_order_of_arrival(spark):
    r = random.Random(4)
    mentions, relations = [], []
    for i in range(200):
        name = r.choice(("a", "A", " a", "b", "B ", "c", "C", "cc"))
        mentions.append((name, r.choice("ST"), "text", r.choice((0.5, 0.9, None)), [f"c{r.randrange(5)}", f"c{r.randrange(5)}"]))
        relations.append((r.choice(("a", "A", "b", "B ", "cc")), r.choice("PQ"), r.choice(("a", "A", "b", "C")), i))
    want, first = in_order(mentions, relations)
    e = spark.createDataFrame([(*m, i) for i, m in enumerate(mentions)], "name string, type string, source_type string, confidence double, source_chunks array<string>, seq long").repartition(5)
    classes, members = graph.entity_classes(e)
    chunks = {}
    for x in members.collect():
        chunks.setdefault(x.key, []).append(x.chunk)
    got = {x.key: (x.name, x.type, x.source_type, x.confidence, x.merged_count, sorted(chunks[x.key])) for x in classes.collect()}
    assert got == want
    rel = spark.createDataFrame([(s, p, o, i, i) for s, p, o, i in relations], "subject string, predicate string, object string, mark long, seq long").repartition(5)
    assert {(x.subject, x.predicate, x.object): x.mark for x in graph.filter_relations(rel, classes).collect()} == first


def test_a_name_of_every_document_is_spread_over_tasks(spark):
    n = 20_000
    e = spark.range(n).selectExpr("'the' AS name", "'T' AS type", "'text' AS source_type", "0.5D AS confidence", "id AS seq", "array(cast(id AS string)) AS source_chunks")
    classes, members = graph.entity_classes(e)
    assert classes.first().merged_count == n
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [x["count"] for x in members.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == n and max(sizes) < 0.4 * n


def test_names_of_chunks_are_members_once_whatever_rows_a_chunk_has(spark):
    rows = [("1", ["A", "a", "\u00a0a", "b", "", "\t"]), ("2", ["b"]), ("2", ["B", "c"]), (None, ["c", "d"]), (None, ["D"]), ("3", None)]
    want = [("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("c", None), ("d", None)]
    for some in (rows, rows[:2]):
        c = spark.createDataFrame(some, "chunk string, names array<string>").repartition(4)
        got = [(x.key, x.chunk) for x in graph.named_chunks(c).collect()]
        assert sorted(got, key=str) == sorted((w for w in want if some is rows or w in (("a", "1"), ("b", "1"), ("b", "2"))), key=str)


def test_chunks_of_documents_with_ids_of_their_own_are_not_shuffled_word_by_word(spark, sf):
    plan = QUERIES["u03_entity_chunks"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_entities_of_documents_come_with_all_their_chunks(spark, sf):
    members = {}
    for x in QUERIES["u03_entity_chunks"](spark, sf).collect():
        members.setdefault(x.key, []).append(x.chunk)
    got = [(x.name.strip().lower(), x.source_chunks) for x in QUERIES["k08_entity_dedup"](spark, sf).collect()]
    assert sorted(got) == sorted((k, ",".join(sorted(c))) for k, c in members.items())


class Letters:
    """Finds each word as an entity, and relates each to the next."""

    def entities(self, text):
        return [(w, "W") for w in text.split()]

    def relations(self, text, entities):
        return [(a, "R", b, 0.5) for (a, _), (b, _) in zip(entities, entities[1:], strict=False)]


def test_knowledge_merges_each_file_in_order_of_arrival(spark):
    table = [["Name", "x"], ["alpha", "7"]]
    chart = ("pie", {"q": "Beta"}, ["ALPHA"])
    rows = [
        ("f", 0, "beta alpha\n\nAlpha", [table], None, [chart]),
        ("f", 1, "gamma Beta", None, None, None),
        ("g", 0, "ALPHA beta", None, None, None),
    ]
    chunks = ingest.multimodal_chunks(spark.createDataFrame(rows, ingest.PAGES)).repartition(4)
    entities, relations = ingest.knowledge(chunks, Letters())
    got = {(r.file_id, r.key): (r.name, r.source_type, r.confidence, r.merged_count) for r in entities.collect()}
    # text arrives before tables and charts, pages in order; a header's and an axis' 0.9 win over 0.8
    assert got[("f", "alpha")] == ("alpha", "text", 0.8, 4) and got[("f", "beta")] == ("Beta", "chart", 0.9, 3)
    assert got[("g", "alpha")] == ("ALPHA", "text", 0.8, None) and got[("f", "name")] == ("Name", "table", 0.9, None)
    assert ("f", "Name", "RELATED_FIELD", "x") in {(r.file_id, r.subject, r.predicate, r.object) for r in relations.collect()}
    assert {(r.file_id, r.key, r.chunk) for r in ingest.members(chunks, Letters()).filter("key = 'gamma'").collect()} == {("f", "gamma", "f_page_0_text_0"), ("f", "gamma", "f_page_1_text_0")}

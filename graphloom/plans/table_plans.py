"""Queries over extracted tables: parts, by brand, and nations, by region, in their part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import tables
from ..sources import tables as src
from ..sources.tables import load
from .registry import query


def _grouped(rows: DataFrame, key: str, order: str, header: list[str]) -> DataFrame:
    body = F.transform(F.array_sort(F.collect_list(F.struct(order, "cells"))), lambda r: r["cells"])
    head = F.array(F.array(*[F.lit(h) for h in header]))
    return rows.groupBy(key).agg(F.concat(head, body).alias("table_data"))


def part_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    cells = F.array(
        k.cast("string"), F.when(size % 10 != 0, F.col("p_name")), F.concat(size.cast("string"), F.lit("%")), F.concat(size.cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0")),
        F.when(size % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("2024-01-"), F.lpad((size % 28 + 1).cast("string"), 2, "0"))),
    )
    return _grouped(p.select(F.col("p_brand").alias("chunk_id"), k, cells.alias("cells")), "chunk_id", "p_partkey", ["key", "name", "share", "amount", "day"])


PARTS_SQL = """tb AS (
  SELECT p_brand AS chunk_id, list_prepend(['key', 'name', 'share', 'amount', 'day'], list([CAST(p_partkey AS VARCHAR), CASE WHEN p_size % 10 <> 0 THEN p_name END, p_size || '%', p_size || ',' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0'),
         CASE WHEN p_size % 3 = 0 THEN ' ' ELSE '2024-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') END] ORDER BY p_partkey)) AS t
  FROM part GROUP BY p_brand)"""


def nation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return _grouped(n.select(F.col("r_name").alias("chunk_id"), "n_nationkey", F.array(F.col("n_nationkey").cast("string"), "n_name").alias("cells")), "chunk_id", "n_nationkey", ["id", "nation"])


NATIONS_SQL = "tb AS (SELECT r_name AS chunk_id, list_prepend(['id', 'nation'], list([CAST(n_nationkey AS VARCHAR), n_name] ORDER BY n_nationkey)) AS t FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)"

_LINE = "array_to_string(list_transform({}, lambda c: coalesce(c, 'None')), ' | ')"


@query(
    "b01_table_format",
    f"""WITH {PARTS_SQL} SELECT chunk_id, array_to_string(list_concat(['表格(第3页，表1)：', '表头：' || {_LINE.format('t[1]')}], list_transform(t[2:51], lambda r, i: '第' || i || '行：' || {_LINE.format('r')}), CASE WHEN len(t) > 51 THEN ['... (共' || (len(t) - 1) || '行数据)'] ELSE [] END), chr(10)) AS formatted FROM tb""",
)
def b01_table_format(spark, sf_dir):
    return part_tables(spark, sf_dir).select("chunk_id", tables.formatted(F.col("table_data"), F.lit(2), F.lit(0)).alias("formatted"))


@query("b02_table_summary", f"WITH {PARTS_SQL} SELECT chunk_id, '包含' || (len(t) - 1) || '行' || len(t[1]) || '列数据，主要字段：' || array_to_string(t[1][1:3], ', ') || CASE WHEN len(t[1]) > 3 THEN '等' ELSE '' END AS summary, CAST(len(t) - 1 AS INTEGER) AS n_rows, CAST(len(t[1]) AS INTEGER) AS n_columns FROM tb")
def b02_table_summary(spark, sf_dir):
    t = F.col("table_data")
    return part_tables(spark, sf_dir).select("chunk_id", tables.summary(t).alias("summary"), (F.size(t) - 1).alias("n_rows"), F.size(F.element_at(t, 1)).alias("n_columns"))


_CELLS = "cells AS (SELECT chunk_id, c, t[1][c] AS name, r, trim(coalesce(t[r][c], 'None')) AS v FROM tb, (SELECT unnest(range(1, 6)) AS c), LATERAL (SELECT unnest(range(2, len(t) + 1)) AS r))"


@query(
    "b03_column_types",
    f"""WITH {PARTS_SQL}, {_CELLS}, k AS (
          SELECT chunk_id, c, CASE WHEN bool_and(v = '' OR try_cast(replace(replace(v, ',', ''), '%', '') AS DOUBLE) IS NOT NULL) THEN 'number' WHEN bool_and(v = '' OR regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) THEN 'date' ELSE 'text' END AS kind
          FROM cells WHERE r <= 6 GROUP BY 1, 2)
        SELECT chunk_id, string_agg(kind, ',' ORDER BY c) AS types FROM k GROUP BY chunk_id""",
)
def b03_column_types(spark, sf_dir):
    return part_tables(spark, sf_dir).select("chunk_id", F.array_join(tables.column_types(F.col("table_data")), ",").alias("types"))


@query("b06_column_means", f"WITH {PARTS_SQL}, {_CELLS}, n AS (SELECT chunk_id, c, name, try_cast(replace(replace(v, ',', ''), '%', '') AS DOUBLE) AS x FROM cells) SELECT chunk_id, name, round(avg(x), 6) AS mean FROM n WHERE x IS NOT NULL GROUP BY chunk_id, c, name")
def b06_column_means(spark, sf_dir):
    rows = part_tables(spark, sf_dir).select("chunk_id", F.explode(tables.column_means(F.col("table_data"))).alias("m"))
    return rows.select("chunk_id", "m.name", F.round("m.mean", 6).alias("mean"))


@query(
    "b06_insights",
    f"""WITH {PARTS_SQL}, {_CELLS}, n AS (SELECT chunk_id, c, name, avg(try_cast(replace(replace(v, ',', ''), '%', '') AS DOUBLE)) AS x FROM cells GROUP BY 1, 2, 3),
        m AS (SELECT chunk_id, list(name || '平均值：' || printf('%.2f', x) ORDER BY c) FILTER (WHERE x IS NOT NULL) AS l FROM n GROUP BY chunk_id)
        SELECT chunk_id, array_to_string(list_prepend('数据维度：' || (len(t) - 1) || '行×' || len(t[1]) || '列', coalesce(l, []))[1:5], '|') AS insights FROM tb JOIN m USING (chunk_id)""",
)
def b06_insights(spark, sf_dir):
    return part_tables(spark, sf_dir).select("chunk_id", F.array_join(tables.insights(F.col("table_data")), "|").alias("insights"))


@query(
    "r05_table_enrichment",
    f"""WITH {PARTS_SQL}, c AS (SELECT chunk_id, t, md5(chunk_id) < '8' AS there FROM tb UNION ALL SELECT 'none', NULL, false)
        SELECT chunk_id, 'about ' || chunk_id AS table_summary, CASE WHEN there THEN CAST(len(t) - 1 AS INTEGER) ELSE 0 END AS rows, CASE WHEN there THEN CAST(len(t[1]) AS INTEGER) ELSE 0 END AS columns, 'number,text' AS data_types, '' AS key_insights,
               CASE WHEN there THEN 'loaded' ELSE 'failed' END AS status, CASE WHEN there THEN coalesce(t[2][2], '-') END AS first_name FROM c""",
)
def r05_table_enrichment(spark, sf_dir):
    """Chunks of tables, half of them with their table, with what an answer shows of it."""
    own = part_tables(spark, sf_dir)
    chunks = own.select("chunk_id").union(spark.createDataFrame([("none",)], "chunk_id string")).select("chunk_id", F.concat(F.lit("about "), "chunk_id").alias("content"), F.lit('{"data_types": ["number", "text"]}').alias("metadata"))
    out = src.with_tables(chunks, own.filter(F.md5(F.col("chunk_id").cast("binary")) < "8"))
    first = F.when(F.col("status") == "loaded", F.coalesce(F.get(F.element_at("table_data", 2), F.lit(1)), F.lit("-")))
    return out.select("chunk_id", "table_summary", "rows", "columns", F.array_join("data_types", ",").alias("data_types"), F.array_join("key_insights", ",").alias("key_insights"), "status", first.alias("first_name"))


_ENTITIES = """SELECT chunk_id, name, 'TABLE_FIELD' AS type, CAST(0.9 AS DOUBLE) AS confidence, 'table' AS source_type, CAST(NULL AS INTEGER) AS row, CAST(NULL AS INTEGER) AS col FROM (SELECT chunk_id, unnest(t[1]) AS name FROM tb)
  UNION ALL SELECT chunk_id, trim(t[r][c]), 'TABLE_VALUE', CAST(0.7 AS DOUBLE), 'table', CAST(r - 1 AS INTEGER), CAST(c - 1 AS INTEGER) FROM tb, (SELECT unnest(range(1, 6)) AS c), LATERAL (SELECT unnest(range(2, least(len(t), 6) + 1)) AS r)
  WHERE c <= len(t[1]) AND trim(coalesce(t[r][c], '')) <> '' AND try_cast(replace(replace(t[r][c], ',', ''), '%', '') AS DOUBLE) IS NULL"""


@query("k05_table_entities", f"WITH {PARTS_SQL} {_ENTITIES}")
def k05_table_entities(spark, sf_dir):
    return tables.table_entities(part_tables(spark, sf_dir)).drop("place")


@query("k05_field_pairs", f"WITH {PARTS_SQL} SELECT chunk_id, t[1][i] AS subject, 'RELATED_FIELD' AS predicate, t[1][i + 1] AS object, CAST(0.6 AS DOUBLE) AS confidence FROM tb, (SELECT unnest(range(1, 5)) AS i)")
def k05_field_pairs(spark, sf_dir):
    return tables.field_pairs(part_tables(spark, sf_dir)).drop("place")


@query("k05_nation_entities", f"WITH {NATIONS_SQL} {_ENTITIES}")
def k05_nation_entities(spark, sf_dir):
    return tables.table_entities(nation_tables(spark, sf_dir)).drop("place")


_CELL_CASES = ["1,234", "12.5%", "nan", "1_000", " 5 ", "", "1d", "¥85", "None", "1e5", "-.5", "5.", "__1", "1__0", "inf", "2024-01-02 10:00", "01/02/2024", "2024年1月2日", "1/2/2024"]
_ARE = dict(zip(_CELL_CASES, [True] * 5 + [False] * 4 + [True] * 3 + [False] * 2 + [True] + [False] * 4, strict=True))


_CELLS = """SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) || ',000' AS cell, true AS number, false AS date FROM orders UNION ALL SELECT o_orderkey, o_orderpriority, false, false FROM orders
  UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d'), false, true FROM orders UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') || ' noon', false, true FROM orders
  UNION ALL SELECT p_partkey, p_size || '%', true, false FROM part UNION ALL SELECT p_partkey, p_name, false, false FROM part UNION ALL SELECT p_partkey, strftime(DATE '2020-01-01' + CAST(p_size AS INTEGER), '%Y年%m月%d日'), false, true FROM part"""


@query(
    "b04_cell_kinds",
    f"{_CELLS} UNION ALL SELECT r_regionkey, v.cell, v.number, v.date FROM region, (VALUES " + ", ".join(f"('{c}', {n}, {c.startswith('2024') or c == '01/02/2024'})" for c, n in _ARE.items()) + ") v(cell, number, date)",
)
def b04_cell_kinds(spark, sf_dir):
    """Cells of orders and parts, and some odd ones."""
    o, p = load(spark, sf_dir, "orders"), load(spark, sf_dir, "part")
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size").cast("int"))
    cells = o.select(F.col("o_orderkey").alias("k"), F.explode(F.array(F.concat(F.col("o_orderkey").cast("string"), F.lit(",000")), F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" noon")))).alias("cell"))
    cells = cells.union(p.select("p_partkey", F.explode(F.array(F.concat(F.col("p_size").cast("string"), F.lit("%")), F.col("p_name"), F.date_format(day, "yyyy年MM月dd日")))))
    cells = cells.union(load(spark, sf_dir, "region").select("r_regionkey", F.explode(F.array(*[F.lit(c) for c in _CELL_CASES]))))
    return cells.select("k", "cell", X.is_number(F.col("cell")).alias("number"), X.is_date(F.col("cell")).alias("date"))

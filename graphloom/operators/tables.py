"""Analysis of extracted tables: arrays of rows of cells, the first row the header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, is_date, is_number, strip, to_number, two_decimals

ROWS_SHOWN, ROWS_SAMPLED, INSIGHTS, NAMES_SHOWN, ENTITY_ROWS = 50, 5, 5, 3, 5


def cell_text(x: Column) -> Column:
    """A missing cell reads None."""
    return F.coalesce(x, F.lit("None"))


def _line(row: Column) -> Column:
    return F.array_join(F.transform(row, cell_text), " | ")


def _width(t: Column) -> Column:
    return F.size(F.element_at(t, 1))


def formatted(t: Column, page: Column, index: Column) -> Column:
    body = F.transform(F.slice(t, 2, ROWS_SHOWN), lambda r, i: F.concat(F.lit("第"), (i + 1).cast("string"), F.lit("行："), _line(r)))
    more = F.when(F.size(t) > ROWS_SHOWN + 1, F.array(F.concat(F.lit("... (共"), (F.size(t) - 1).cast("string"), F.lit("行数据)")))).otherwise(F.array().cast("array<string>"))
    title = F.concat(F.lit("表格(第"), (page + 1).cast("string"), F.lit("页，表"), (index + 1).cast("string"), F.lit(")："))
    head = F.concat(F.lit("表头："), _line(F.element_at(t, 1)))
    return F.when(F.size(t) < 1, F.concat(F.lit("表格(第"), (page + 1).cast("string"), F.lit("页)：空表格"))).otherwise(F.array_join(F.concat(F.array(title, head), body, more), "\n"))


def summary(t: Column) -> Column:
    head = F.element_at(t, 1)
    names = F.slice(head, 1, NAMES_SHOWN)
    text = F.concat(F.lit("包含"), (F.size(t) - 1).cast("string"), F.lit("行"), F.size(head).cast("string"), F.lit("列数据，主要字段："), F.array_join(names, ", "), F.when(F.size(head) > NAMES_SHOWN, F.lit("等")).otherwise(F.lit("")))
    return F.when(F.size(t) < 2, F.lit("表格数据不足")).when(F.exists(names, lambda n: n.isNull()), F.lit("摘要生成失败")).otherwise(text)


def column_types(t: Column) -> Column:
    """Per header column: empty, number, date or text, from the first rows; blanks say nothing, and short rows are skipped."""
    sample = F.slice(t, 2, ROWS_SAMPLED)

    def kind(c: Column) -> Column:
        reached = F.filter(sample, lambda r: F.size(r) > c)
        values = F.filter(F.transform(reached, lambda r: strip(cell_text(F.get(r, c)))), lambda v: v != "")
        return F.when(F.size(reached) == 0, F.lit("empty")).when(F.forall(values, is_number), F.lit("number")).when(F.forall(values, is_date), F.lit("date")).otherwise(F.lit("text"))

    return F.when(F.size(t) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), _width(t) - 1), kind))


def column_means(t: Column) -> Column:
    """Per header column (name, mean) of its numeric cells; columns without any are left out."""

    def mean(c: Column) -> Column:
        numbers = F.filter(F.transform(F.slice(t, 2, F.size(t)), lambda r: to_number(cell_text(F.get(r, c)))), lambda v: v.isNotNull())
        total = F.aggregate(numbers, F.lit(0.0), lambda s, v: s + v)
        return F.struct(cell_text(F.get(F.element_at(t, 1), c)).alias("name"), F.when(F.size(numbers) > 0, total / F.size(numbers)).alias("mean"))

    means = F.filter(F.transform(F.sequence(F.lit(0), _width(t) - 1), mean), lambda m: m["mean"].isNotNull())
    return F.when(F.size(t) < 2, F.array().cast("array<struct<name:string,mean:double>>")).otherwise(means)


def insights(t: Column) -> Column:
    """The table's size, then means, together at most five."""
    size = F.concat(F.lit("数据维度："), (F.size(t) - 1).cast("string"), F.lit("行×"), _width(t).cast("string"), F.lit("列"))
    lines = F.transform(column_means(t), lambda m: F.concat(m["name"], F.lit("平均值："), two_decimals(m["mean"])))
    return F.when(F.size(t) < 2, F.array().cast("array<string>")).otherwise(F.slice(F.concat(F.array(size), lines), 1, INSIGHTS))


def table_entities(tables: DataFrame) -> DataFrame:
    """Entities of tables (chunk_id, table_data): headers, and cells of the first rows that are not numbers; place is their row and column."""
    rows = tables.filter(F.size("table_data") > 1).select("chunk_id", F.posexplode(F.slice("table_data", 1, ENTITY_ROWS + 1)).alias("row", "cells"))
    cells = rows.select("chunk_id", "row", F.posexplode("cells").alias("col", "cell")).filter(F.col("cell").isNotNull() & ~blank(F.col("cell")))
    cells = cells.filter((F.col("row") == 0) | ~is_number(F.col("cell")))
    head = F.col("row") == 0
    return cells.select("chunk_id", strip(F.col("cell")).alias("name"), F.when(head, F.lit("TABLE_FIELD")).otherwise(F.lit("TABLE_VALUE")).alias("type"), F.when(head, F.lit(0.9)).otherwise(F.lit(0.7)).alias("confidence"), F.lit("table").alias("source_type"), F.when(~head, F.col("row")).alias("row"), F.when(~head, F.col("col")).alias("col"), F.struct("row", "col").alias("place"))


def field_pairs(tables: DataFrame) -> DataFrame:
    """Relations between neighbouring headers, with their place."""
    head = F.element_at("table_data", 1)
    pairs = F.zip_with(F.slice(head, F.lit(1), F.size(head) - 1), F.slice(head, F.lit(2), F.size(head)), lambda a, b: F.struct(a.alias("subject"), b.alias("object")))
    return tables.filter(F.size("table_data") > 1).select("chunk_id", F.posexplode(pairs).alias("place", "p")).select("chunk_id", "place", "p.subject", F.lit("RELATED_FIELD").alias("predicate"), "p.object", F.lit(0.6).alias("confidence"))

"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 17


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    parts = F.split(text, common.SPACE_CLASS)
    n = F.size(parts) - (F.get(parts, F.lit(0)) == "").cast("int")
    n = n - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return F.when(text.isNull(), F.lit(0)).otherwise(n).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most=MOST_REPEATS) -> DataFrame:
    """From rows (source, size): source, source_size, target, rate.

    Sources in code point order, null last, take the weights in turn and share the total size by weight. A target stops
    at `most` times its source's size and the excess is shared again by weight. In order of size over weight, the level
    is the first share a source that does not reach its stop; so no loop is needed. A source of size 0 gets target 0.
    The windows run over one row per source, after partial sums.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("stop", F.col("source_size") * most)
    everything = W.partitionBy()
    before = W.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    per = per.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0))).alias("left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("left_w"),
    )
    share = F.col("left") / F.col("left_w")
    level = F.min(F.when(share * F.col("w") <= F.col("stop"), F.struct((F.col("stop") / F.col("w")).alias("at"), share.alias("level")))).over(everything)["level"]
    per = per.withColumn("target", F.coalesce(F.least(F.col("stop").cast("double"), level * F.col("w")), F.lit(0.0)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", "target", rate.alias("rate"))


def uniform(doc_id: Column, text_key: Column, seed: int = SEED) -> Column:
    """In [0, 1), from the first 52 bits of an MD5 of seed and id (of the text's MD5 where the id is null)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("-"), text_key)))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(rate: Column, u: Column) -> Column:
    """floor(rate) copies, and one more with probability equal to the fraction."""
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).cast("int")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, most=MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, rate, copies, taken.

    Null texts and empty texts have size 0; a null source is a source of its own, last in order. Rows that repeat an id
    get the same number of copies. An empty table gives no rows.
    """
    scratch = common.Scratch(docs.sparkSession)
    rows = common.hidden(docs, doc_id=doc_id, text=text, source=source)
    rows = rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.when(F.col("doc_id").isNull(), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("text_key"))
    rows = scratch.write(rows, "sizes")
    targets = scratch.write(source_targets(rows.select("source", "size"), weights, most), "targets")
    rows = common.attach(rows, targets, ["source"])
    rows = rows.withColumn("copies", copies(F.col("rate"), uniform(F.col("doc_id"), F.col("text_key"), seed)))
    return rows.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def emit(docs: DataFrame, weights=WEIGHTS, most=MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """The rows of docs themselves (doc_id, text, source and any others), each as often as the mix takes it.

    Odd input as in `mix`; other columns stay as they are, whatever their names.
    """
    scratch = common.Scratch(docs.sparkSession)
    sizes = common.hidden(docs, source="source", text="text").select("source", word_count(F.col("text")).alias("size"))
    own, name = common.numbered(docs)
    targets = scratch.write(source_targets(sizes, weights, most), "targets").select(F.col("source").alias(name["source"]), "rate")
    rows = common.attach(own, targets, [name["source"]])
    u = uniform(F.col(name["doc_id"]), F.md5(F.coalesce(F.col(name["text"]), F.lit("")).cast("binary")), seed)
    n = copies(F.col("rate"), u)
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), n))).select(*own.columns).toDF(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(common.documents(spark, sf_dir, "doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "copies")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, text, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 3 * source_size AS stop,
         sum(source_size) OVER () AS total, sum(w) OVER () AS total_w,
         coalesce(sum(3 * source_size) OVER b, 0) AS stop_before, coalesce(sum(w) OVER b, 0) AS w_before
  FROM s
  WINDOW b AS (ORDER BY 3 * source_size / w, source COLLATE "binary" NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (
  SELECT arg_min((total - stop_before) / (total_w - w_before), stop / w) AS level
  FROM r WHERE (total - stop_before) / (total_w - w_before) * w <= stop),
t AS (
  SELECT source, source_size, coalesce(least(CAST(stop AS DOUBLE), level * w), 0.0) AS target
  FROM r LEFT JOIN v ON true),
m AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), '-' || md5(coalesce(d.text, '')))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM m
"""

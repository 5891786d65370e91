"""Numbers of rows within a key, also where one key holds most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folders import shared_folder


def placed(df: DataFrame, key: str, order: list[str], name: str = "place") -> DataFrame:
    """df with the place (from 0) of each row among those of its key, in the given order, and their number as `{name}_of`.

    Rows are sorted by ranges of key and order, so a key of very many rows lies in several tasks; each row keeps its number
    in its range, and what ranges before hold of the key is added. Rows are written once, so that the ranges stay as they are.
    """
    own = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("__id", F.monotonically_increasing_id())
    path = f"{shared_folder(df.sparkSession, 'numbered')}/rows"
    own.write.parquet(path)
    rows = df.sparkSession.read.schema(own.schema).parquet(path).withColumn("__part", F.shiftright("__id", 33))
    per = rows.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__own")).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # As many rows as there are keys and ranges together.
    before = W.partitionBy("__key").orderBy("__own").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("__key", "__own", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(W.partitionBy("__key")).alias(f"{name}_of"))
    out = rows.join(per, rows[key].eqNullSafe(per["__key"]) & (rows["__part"] == per["__own"]))
    return out.select(*df.columns, (F.col("__before") + F.col("__id") - F.col("__first")).alias(name), f"{name}_of")

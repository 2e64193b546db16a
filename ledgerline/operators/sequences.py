"""Ordered look-backs that do not gather a whole key in one task.

A key may hold a third of all rows. Its rows are cut into chunks of the order (days, say); windows run
within a chunk, and one row per key and chunk carries the last value over to the following chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carry_last(rows: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the last non-null ``value`` of the same keys strictly before the row, else null.

    Rows of one key are ordered by ``order`` (made unique by the caller); ``chunk`` must not decrease
    along it. Keys compare null-safe (as one struct); an empty table stays empty.
    """
    d = rows.withColumn("_key", F.struct(*keys))
    inside = Window.partitionBy("_key", chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = d.withColumn("_local", F.last(value, ignorenulls=True).over(inside))
    # one row per key and chunk; chunks without a value of their own look at the last one before them that has one
    ends = d.groupBy("_key", chunk).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    before = Window.partitionBy("_key").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_key", chunk, F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    return local.join(carried, ["_key", chunk], "left").withColumn(name, F.coalesce("_local", "_carried")).drop("_key", "_local", "_carried")


def prefix_sum(rows: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same keys strictly before the row; 0 for the first. Nulls count 0; keys compare null-safe."""
    d = rows.withColumn("_key", F.struct(*keys))
    inside = Window.partitionBy("_key", chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = d.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0).cast("long")))
    before = Window.partitionBy("_key").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    ends = d.groupBy("_key", chunk).agg(F.sum(value).alias("_sum"))
    offsets = ends.select("_key", chunk, F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("long")).alias("_offset"))
    return local.join(offsets, ["_key", chunk], "left").withColumn(name, F.col("_local") + F.col("_offset")).drop("_key", "_local", "_offset")

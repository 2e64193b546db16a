"""Totals over trailing periods, days without activity included.

Each daily total is exploded onto every output date it influences, summed by entity and date, and
joined to the entity's calendar. The input is summed to one row per entity and day first, on the map
side too, so neither an entity with a third of all rows nor the fan-out (the longest period, at
most) ever moves raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def trailing_totals(rows: DataFrame, entity: str, day: str, value: str, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """One row per entity and day from its first to its last day.

    Columns: entity, day, nth (the first day is the 1st), value (of the day itself), and for each
    period p ``sum{p}`` and ``avg{p}`` (sum over p days, divided by p, days before the first counting 0).
    Rows with a null day or entity belong to no calendar and are left out; a null value counts 0;
    repeated rows all count; an empty table gives no rows. Extra columns are not carried.
    """
    src = rows.select(F.col(entity).alias("_e"), F.col(day).cast("date").alias("_d"), F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("_v"))
    # one row per entity and day, written once: the span and the sums read these rows, and the input is read once
    daily = cut(src.filter("_e is not null and _d is not null").groupBy("_e", "_d").agg(F.sum("_v").alias("_v")))
    span = daily.groupBy("_e").agg(F.min("_d").alias("_first"), F.max("_d").alias("_last"))
    longest = max(periods)
    reach = F.sequence("_d", F.least(F.date_add("_d", longest - 1), F.col("_last")))
    age = F.datediff("_out", "_d")
    moved = daily.join(span, "_e").select("_e", "_d", "_v", F.explode(reach).alias("_out"))
    sums = moved.groupBy("_e", "_out").agg(
        F.sum(F.when(age == 0, F.col("_v"))).alias("_own"),
        *[F.sum(F.when(age < p, F.col("_v"))).alias(f"_s{p}") for p in periods],
    )
    calendar = span.select("_e", "_first", F.explode(F.sequence("_first", "_last")).alias("_out"))
    full = calendar.join(sums, ["_e", "_out"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return full.select(
        F.col("_e").alias(entity),
        F.col("_out").alias(day),
        (F.datediff("_out", "_first") + 1).alias("nth"),
        zero("_own").alias(value),
        *[zero(f"_s{p}").alias(f"sum{p}") for p in periods],
        *[(zero(f"_s{p}") / F.lit(p)).alias(f"avg{p}") for p in periods],
    )

"""Pricing mechanics over any table of rates: exact, dated, inferred from the family, default.

No price is built in. ``rates`` is (model, input, output, cached) in integers of 1e-8 per million
tokens, ``dated`` the same with first_day and last_day (inclusive, null for open). Both are
dimension tables and broadcast only by the session's size limit. Sums are decimals, so no order
of rows changes a cost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Endings that name a variant of a model, not another model (fixed values).
VARIANTS = ("high", "medium", "low", "minimal", "thinking", "latest", "preview", "customtools")


def rate_key(model: Column) -> Column:
    """The model without the remark that its counts are estimated."""
    return F.trim(F.replace(F.coalesce(model, F.lit("")), F.lit(" (estimated)"), F.lit("")))


def candidates(key: Column, variants: Sequence[str] = VARIANTS) -> Column:
    """(name, stripped) of the key and of what is left as variant endings are taken off, one at a time."""
    parts = F.split(key, "-")
    known = F.array(*[F.lit(v) for v in variants])
    # endings that are variants, counted from the back; the first part always stays
    run = F.aggregate(
        F.reverse(F.slice(parts, 2, F.size(parts))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda a, x: F.struct((a["n"] + F.when(a["on"] & F.array_contains(known, F.lower(x)), 1).otherwise(0)).alias("n"), (a["on"] & F.array_contains(known, F.lower(x))).alias("on")),
    )["n"]
    return F.transform(F.sequence(F.lit(0), run), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "-").alias("name"), k.alias("stripped")))


def resolved(days: DataFrame, rates: DataFrame, dated: DataFrame, default: tuple[int, int, int], free: Column | None = None) -> DataFrame:
    """(model, day) to (model, day, input, output, cached, how): free, dated, exact, family or default, in this order.

    ``days`` has each model and day once; a null day takes no dated rate. Of overlapping dated rates the one that starts first holds.
    """
    d = days.select("model", "day").distinct().withColumn("key", rate_key(F.col("model")))
    t = dated.select(F.col("model").alias("key"), "first_day", "last_day", F.struct("input", "output", "cached").alias("r"))
    by_day = d.join(t, "key").filter((F.col("day") >= F.col("first_day")) & (F.col("last_day").isNull() | (F.col("day") <= F.col("last_day")))).groupBy("model", "day").agg(F.min_by("r", "first_day").alias("dated"))
    c = d.select("key").distinct().select("key", F.inline(candidates(F.col("key"))))
    by_name = c.join(rates.select(F.col("model").alias("name"), F.struct("input", "output", "cached").alias("r")), "name").groupBy("key").agg(F.min_by(F.struct("stripped", "r"), "stripped").alias("named"))
    j = d.join(by_day, ["model", "day"], "left").join(by_name, "key", "left")
    is_free = F.endswith("key", F.lit(":free")) if free is None else free
    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in ("input", "output", "cached")])
    fixed = F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(("input", "output", "cached"), default)])
    how = F.when(is_free, "free").when(F.col("dated").isNotNull(), "dated").when(F.col("named.stripped") == 0, "exact").when(F.col("named").isNotNull(), "family").otherwise("default")
    r = F.when(is_free, zero).otherwise(F.coalesce("dated", "named.r", fixed))
    return j.select("model", "day", r.alias("r"), how.alias("how")).select("model", "day", "r.*", "how")


def billed(sums: DataFrame, resolved_rates: DataFrame) -> DataFrame:
    """Adds cost (what was used) and cold (had nothing been cached) to sums by model and day.

    Input at its rate, cache creation at 1.25 of it, cache reads at the cached rate, output and reasoning at the output rate.
    """
    j = sums.join(resolved_rates, ["model", "day"], "left")
    n = lambda c: F.col(c).cast("decimal(38,0)")
    use = n("input_tokens") * 100 * n("input") + n("cache_creation") * 125 * n("input") + n("cache_read") * 100 * n("cached") + (n("output_tokens") + n("reasoning")) * 100 * n("output")
    cold = (n("input_tokens") + n("cache_creation") + n("cache_read")) * 100 * n("input") + (n("output_tokens") + n("reasoning")) * 100 * n("output")
    return j.withColumns({"cost": use.cast("decimal(38,0)"), "cold": cold.cast("decimal(38,0)")})


def money(units: Column) -> Column:
    """The decimal sum of ``billed`` in currency."""
    return units.cast("double") / F.lit(1e16)

"""Ordered state: forward fills, prefix sums and look-backs that estimate tokens where nothing was measured; winners of repeats.

Steps of one session are ordered by columns that make it total. A session may hold a third of all
steps: its prefix sums and look-backs run in chunks of the order (``sequences``), not in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import carry_last, prefix_sum

#: Tokens that every estimate of an input starts from (instructions that are not in the text).
BASE_TOKENS = 6000
CHARS_PER_TOKEN = 4


def tokens_of(chars: Column) -> Column:
    return F.floor(chars / CHARS_PER_TOKEN).cast("long")


def split_thinking(output: Column, thinking: Column) -> Column:
    """(output, reasoning): thinking is taken out of the output if it is in it."""
    fits = (thinking > 0) & (thinking <= output)
    return F.struct(F.when(fits, output - thinking).otherwise(output).alias("output"), F.when(fits, thinking).otherwise(F.lit(0).cast("long")).alias("reasoning"))


def forward_fill(steps: DataFrame, session: str, chunk: str, order: list[str], value: str, default: str, name: str) -> DataFrame:
    """The value of the row or else the last one before it in the session, or else the default. Runs before any window filter."""
    f = carry_last(steps, [session], chunk, order, value, "_before")
    return f.withColumn(name, F.coalesce(value, "_before", F.lit(default))).drop("_before")


def estimated_calls(steps: DataFrame, session: str, chunk: str, order: list[str], chars: str, is_call: Column, own: bool) -> DataFrame:
    """Calls of a session with estimated input_tokens, cache_read and output_tokens, from the characters before them.

    The context of a call is what stands before it (acc). What the call before it had already sent counts as
    read from the cache: its own context, with its own characters if ``own``. The first call pays the base.
    """
    s = prefix_sum(steps, [session], chunk, order, chars, "acc")
    sent = F.col("acc") + F.coalesce(F.col(chars), F.lit(0)) if own else F.col("acc")
    calls = carry_last(s.filter(is_call).withColumn("_sent", sent), [session], chunk, order, "_sent", "_before").withColumn("_before", F.coalesce("_before", F.lit(0).cast("long")))
    again = F.col("_before") > 0
    read = F.when(again, tokens_of(F.col("_before")) + BASE_TOKENS).otherwise(F.lit(0).cast("long"))
    fresh = F.when(again, F.greatest(F.lit(0).cast("long"), tokens_of(F.col("acc")) - tokens_of(F.col("_before")))).otherwise(tokens_of(F.col("acc")) + BASE_TOKENS)
    return calls.withColumns({"input_tokens": fresh, "cache_read": read, "output_tokens": F.greatest(F.lit(1).cast("long"), tokens_of(F.coalesce(F.col(chars), F.lit(0).cast("long"))))}).drop("_sent", "_before")


def first_wins(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """One row per key, the least in ``order`` (unique); rows without a key are all kept.

    The winners come from an aggregate over (key, order), and the rest is an anti join on the unique order,
    so neither a hot key nor the wide rows gather anywhere.
    """
    k = rows.select(key.alias("_k"), F.col(order).alias("_o")).filter("_k is not null")
    keep = k.groupBy("_k").agg(F.min("_o").alias("_o")).select("_o")
    drop = k.select("_o").join(keep, "_o", "left_anti")
    return rows.join(drop, rows[order] == drop["_o"], "left_anti")


def last_wins(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """Per key the values of the last row and the place of the first (``first_order``); rows without a key are left out."""
    r = rows.withColumn("_k", key).filter("_k is not null")
    ends = r.groupBy("_k").agg(F.min(order).alias("first_order"), F.max(order).alias("_last"))
    return r.join(ends, (r["_k"] == ends["_k"]) & (r[order] == ends["_last"])).drop("_k", "_last")

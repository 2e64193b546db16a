"""Daily rollups of many machines: rollup, winners, aggregation, cohorts, freshness, sketches, overlaps, anomalies.

Sketches are sorted arrays of the least 64 fingerprints, 16 hexadecimal digits each, so that the order
of the text is the order of the unsigned numbers. Empty inputs give no rows unless a total is asked for.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times
from ..schema import TOKEN_FIELDS
from . import rates

SKETCH = 64
SALTS = 32


def fingerprint(*columns: Column) -> Column:
    """16 hexadecimal digits of the columns' text; nulls count as empty."""
    return F.substring(F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])), 1, 16)


def published_fingerprint(*columns: Column) -> Column:
    """16 hexadecimal digits of the BLAKE2b (8 bytes) of the columns' text, joined by unit separators; nulls are ``None``.

    For sketches that have to be compared with records already published under that digest, which the JVM does not have: it runs
    in Python, on Arrow batches. New data take ``fingerprint``.
    """
    @F.pandas_udf("string")
    def digest(text: pd.Series) -> pd.Series:
        from hashlib import blake2b

        return text.map(lambda t: blake2b(t.encode(), digest_size=8).hexdigest())

    return digest(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("None")) for c in columns]))


def bottom_k(rows: DataFrame, by: list[str], hash_: str, k: int = SKETCH) -> DataFrame:
    """The least k distinct hashes of each group as a sorted array ``sketch``; null hashes are left out.

    Each salted part of a group keeps its own least k, before the shuffle where it can, so a group of any
    size is reduced to k times the salts before it comes together.
    """
    salted = rows.filter(F.col(hash_).isNotNull()).select(*by, F.col(hash_).alias("h")).withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)))
    d = salted.groupBy(*by, "salt", "h").agg(F.lit(1).alias("_one")).drop("_one")
    least = d.withColumn("r", F.row_number().over(Window.partitionBy(*by, "salt").orderBy("h"))).filter(F.col("r") <= k)
    return least.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list("h")), 1, k).alias("sketch"))


def jaccard(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Of the least k of both sketches' union, the share in both; 0 where either is empty."""
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), least))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(least)), F.lit(0.0))


def overlaps(sketches: DataFrame, threshold: float = 0.5, top: int | None = None) -> DataFrame:
    """(day, machine_a, machine_b, jaccard) of machines of one day at least so alike; with ``top`` only the most alike, in order.

    Only machines that share a hash are compared: pairs come from the shared hashes.
    """
    e = sketches.select("day", "machine", F.explode("sketch").alias("h"))
    x, y = e.withColumnRenamed("machine", "machine_a"), e.withColumnRenamed("machine", "machine_b")
    pairs = x.join(y, ["day", "h"]).filter("machine_a < machine_b").select("day", "machine_a", "machine_b").distinct()
    s = lambda n: sketches.select("day", F.col("machine").alias(f"machine_{n}"), F.col("sketch").alias(n))
    j = pairs.join(s("a"), ["day", "machine_a"]).join(s("b"), ["day", "machine_b"])
    found = j.select("day", "machine_a", "machine_b", jaccard(F.col("a"), F.col("b")).alias("jaccard")).filter(F.col("jaccard") >= threshold)
    return found.orderBy(F.desc("jaccard"), "day", "machine_a", "machine_b").limit(top) if top else found


def rollup_long(ledger: DataFrame) -> DataFrame:
    """(machine, day, kind, name, calls, five fields): by source, by model, and measured or estimated, in one pass.

    A missing ``exact`` is estimated here. ``ledger`` is raw enough to still have it null.
    """
    kinds = F.array(
        F.struct(F.lit("source").alias("kind"), F.coalesce("source", F.lit("unknown")).alias("name")),
        F.struct(F.lit("model").alias("kind"), F.coalesce("model", F.lit("unknown")).alias("name")),
        F.struct(F.lit("certainty").alias("kind"), F.when(F.coalesce("exact", F.lit(False)), "exact").otherwise("estimated").alias("name")),
    )
    z = [F.coalesce(F.col(f), F.lit(0).cast("long")).alias(f) for f in TOKEN_FIELDS]
    d = ledger.filter("timestamp is not null").select("machine", times.day_text(F.col("timestamp")).alias("day"), F.explode(kinds).alias("k"), *z)
    return d.groupBy("machine", "day", F.col("k.kind").alias("kind"), F.col("k.name").alias("name")).agg(F.count(F.lit(1)).alias("calls"), *[F.sum(f).alias(f) for f in TOKEN_FIELDS])


def daily_records(ledger: DataFrame, hash_: str = "fingerprint", today: Column | None = None) -> DataFrame:
    """One record per machine and day, nested as it is exported: maps of sources and models, exact, estimated, totals, sketch, partial."""
    long = rollup_long(ledger)
    tokens = F.struct(*[F.col(f) for f in TOKEN_FIELDS])
    by_kind = lambda k: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("name", tokens.alias("t"))))))
    part = lambda name: F.struct(*[F.coalesce(F.sum(F.when((F.col("kind") == "certainty") & (F.col("name") == name), F.col(f))), F.lit(0).cast("long")).alias(f) for f in TOKEN_FIELDS])
    certain = F.col("kind") == "certainty"
    total = F.struct(*[F.sum(F.when(certain, F.col(f))).alias(f) for f in TOKEN_FIELDS])
    r = long.groupBy("machine", "day").agg(F.sum(F.when(certain, F.col("calls"))).alias("invocations"), total.alias("totals"), part("exact").alias("exact"), part("estimated").alias("estimated"), by_kind("source").alias("sources"), by_kind("model").alias("models"))
    sk = bottom_k(ledger.filter("timestamp is not null").select("machine", times.day_text(F.col("timestamp")).alias("day"), hash_), ["machine", "day"], hash_)
    out = r.join(sk, ["machine", "day"], "left").withColumn("sketch", F.coalesce("sketch", F.array().cast("array<string>")))
    return out.withColumn("partial", F.col("day") >= today if today is not None else F.lit(False))


def readable(records: DataFrame, version: int) -> DataFrame:
    """Records of the schema version that have a machine and a date."""
    return records.filter((F.col("schema") == version) & F.col("machine").isNotNull() & F.col("date").isNotNull())


def winners(records: DataFrame, *tie: str) -> DataFrame:
    """Of each machine and date the record with the greatest generated_at, as text; ties go to the least of ``tie``.

    Only the keys are compared in an aggregate; the winners' payloads are joined back by the unique tie columns.
    """
    at = F.struct(F.coalesce("generated_at", F.lit("")).alias("g"), *[(-F.col(t)).alias(t) for t in tie])
    best = records.groupBy("machine", "date").agg(F.max(at).alias("b")).select(*[(-F.col(f"b.{t}")).alias(t) for t in tie])
    return records.join(best, list(tie), "left_semi")


def aggregate_long(records: DataFrame) -> DataFrame:
    """(kind, name, records, invocations, total, exact, estimated, confidence) by machine, date, counter and in total, in one pass; no rows for no records."""
    s = lambda c: sum((F.coalesce(F.col(f"{c}.{f}"), F.lit(0)) for f in TOKEN_FIELDS), F.lit(0).cast("long"))
    r = records.select("machine", "date", F.coalesce(times.filled(F.col("counter")), F.lit("unstamped")).alias("counter"), F.coalesce("invocations", F.lit(0)).alias("invocations"), s("totals").alias("total"), s("exact").alias("exact"), s("estimated").alias("estimated"))
    g = r.groupingSets([[F.col("machine")], [F.col("date")], [F.col("counter")], []], F.col("machine"), F.col("date"), F.col("counter")).agg(
        F.grouping("machine").alias("gm"), F.grouping("date").alias("gd"), F.grouping("counter").alias("gc"), F.count(F.lit(1)).alias("records"), *[F.sum(c).alias(c) for c in ("invocations", "total", "exact", "estimated")]
    )
    kind = F.when(F.col("gm") == 0, "machine").when(F.col("gd") == 0, "date").when(F.col("gc") == 0, "counter").otherwise("all")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return g.select(kind.alias("kind"), F.coalesce("machine", "date", "counter", F.lit("")).alias("name"), "records", *[zero(c) for c in ("invocations", "total", "exact", "estimated")], confidence(F.col("exact"), F.col("estimated")).alias("confidence"))


def confidence(exact: Column, estimated: Column) -> Column:
    """Measured against measured and estimated; 1 where there is nothing."""
    return F.round(F.coalesce(F.try_divide(exact.cast("double"), exact + estimated), F.lit(1.0)), 6)


def map_breakdown(records: DataFrame, column: str) -> DataFrame:
    """(name, records, five fields) over a map of token structs; null maps and values count nothing."""
    e = records.select(F.explode(column).alias("name", "t"))
    return e.groupBy("name").agg(F.count(F.lit(1)).alias("records"), *[F.coalesce(F.sum(f"t.{f}"), F.lit(0).cast("long")).alias(f) for f in TOKEN_FIELDS])


def model_days(records: DataFrame) -> DataFrame:
    """(machine, day, model, five fields, total) of the maps of models of daily records, null maps and values left out; null counts are 0."""
    e = records.select("machine", F.col("date").alias("day"), F.explode("models").alias("model", "t")).filter("t is not null")
    z = [F.coalesce(F.col(f"t.{f}"), F.lit(0).cast("long")).alias(f) for f in TOKEN_FIELDS]
    return e.select("machine", "day", "model", *z).withColumn("total", sum((F.col(f) for f in TOKEN_FIELDS), F.lit(0).cast("long")))


def priced(records: DataFrame, rates_: DataFrame, dated: DataFrame, default: tuple[int, int, int], free: Column | None = None, by_date: bool = True) -> DataFrame:
    """``model_days`` with cost and cold (see ``rates.billed``), each day at the rate in force then, or all at the undated rates.

    Records hold tokens only: a corrected rate corrects every day ever exported.
    """
    m = model_days(records)
    keys = m.select("model", F.col("day") if by_date else F.lit(None).cast("string").alias("day")).distinct()
    r = rates.resolved(keys, rates_, dated, default, free)
    if by_date:
        return rates.billed(m, r)
    return rates.billed(m.withColumnRenamed("day", "_on").withColumn("day", F.lit("")), r.withColumn("day", F.lit(""))).withColumn("day", F.col("_on")).drop("_on")


def spend(priced_days: DataFrame, *by: str) -> DataFrame:
    """(by..., total, cache_read, cost), or one row; cost stays a decimal, ``rates.money`` turns it into currency."""
    return priced_days.groupBy(*by).agg(F.coalesce(F.sum("total"), F.lit(0).cast("long")).alias("total"), F.coalesce(F.sum("cache_read"), F.lit(0).cast("long")).alias("cache_read"), F.coalesce(F.sum("cost"), F.lit(0).cast("decimal(38,0)")).alias("cost"))


def machine_costs(records: DataFrame, priced_days: DataFrame) -> DataFrame:
    """(machine, days, calls, total, cache_read, cost, top_model): what each machine's records say it cost; top_model is the dearest, ties to the greatest name."""
    calls = records.groupBy("machine").agg(F.count_distinct("date").alias("days"), F.coalesce(F.sum("invocations"), F.lit(0).cast("long")).alias("calls"))
    by_model = spend(priced_days, "machine", "model")
    cost = by_model.groupBy("machine").agg(*[F.sum(c).alias(c) for c in ("total", "cache_read")], F.sum("cost").cast("decimal(38,0)").alias("cost"), F.max_by("model", F.struct("cost", "model")).alias("top_model"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,0)" if c == "cost" else "long").alias(c)
    return calls.join(cost, "machine", "left").select("machine", "days", "calls", *[zero(c) for c in ("total", "cache_read", "cost")], "top_model")


def cost_bars(costs: DataFrame, least_width: float = 0.6) -> DataFrame:
    """(machine, cost, share_of_peak, width): bars against the dearest machine, none narrower than ``least_width`` percent."""
    peak = costs.agg(F.max("cost").alias("peak"))
    # one row beside one per machine
    share = F.coalesce(F.try_divide(F.col("cost").cast("double"), F.col("peak").cast("double")), F.lit(0.0))
    return costs.join(F.broadcast(peak), F.lit(True)).select("machine", "cost", share.alias("share_of_peak"), F.greatest(F.lit(least_width), share * 100).alias("width"))


def flags(machine_costs_: DataFrame, freshness_: DataFrame, identical: DataFrame, confidence_: DataFrame, threshold: int = 0) -> DataFrame:
    """(level, flag, subject, value): spend (the decimal of ``rates.billed``) at or over a threshold (0: none), a row per pair of machines with identical counts on a date, stale machines, a share not measured; else one ``ok``.

    ``identical`` is (date, machine_a, machine_b, ...), ``confidence_`` one row (exact, estimated): no tokens at all, no flag.
    """
    row = lambda level, flag, subject, value: [F.lit(level).alias("level"), F.lit(flag).alias("flag"), subject.alias("subject"), value.cast("double").alias("value")]
    none = F.lit("")
    cost = machine_costs_.agg(F.sum("cost").alias("c")).filter((F.lit(threshold) > 0) & (F.col("c") >= F.lit(threshold))).select(*row("alert", "spend", none, rates.money(F.col("c"))))
    twice = identical.groupBy("date", "machine_a", "machine_b").agg(F.count(F.lit(1)).alias("n")).select(*row("alert", "counted twice", F.concat_ws(" ", "date", "machine_a", "machine_b"), F.col("n")))
    stale = freshness_.filter("stale").agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(*row("warn", "stale machines", none, F.col("n")))
    unsure = confidence_.select((F.col("exact") / F.nullif(F.col("exact") + F.col("estimated"), F.lit(0))).alias("c")).filter("c < 0.999").select(*row("note", "estimated share", none, F.round(F.col("c"), 6)))
    found = cost.unionByName(twice).unionByName(stale).unionByName(unsure)
    ok = found.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(*row("ok", "nothing to report", none, F.lit(0)))
    return found.unionByName(ok)


def cohorts(records: DataFrame, reproducible: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """Counting versions: (counter, records, newest, current, stale). Current is the reproducible, then the most used, then the newest.

    A version that is not stamped or ``+dirty`` is never current; on a full tie the greatest name is.
    """
    c = records.groupBy(F.coalesce(times.filled(F.col("counter")), F.lit("unstamped")).alias("counter")).agg(F.count(F.lit(1)).alias("records"), F.max(F.coalesce("generated_at", F.lit(""))).alias("newest"))
    fit = (F.col("counter") != "unstamped") & ~F.endswith("counter", F.lit("+dirty"))
    known = F.col("counter").isin(list(reproducible)) if reproducible else F.lit(False)
    best = c.filter(fit).agg(F.max(F.struct(known.alias("k"), "records", "newest", "counter")).alias("b")).select(F.col("b.counter").alias("best"))
    # one row, against a few counters
    return c.join(F.broadcast(best), F.lit(True), "left").select("counter", "records", "newest", F.coalesce(F.col("counter") == F.col("best"), F.lit(False)).alias("current"), F.coalesce(F.col("counter") != F.col("best"), F.lit(True)).alias("stale"))


def stale_ranges(records: DataFrame, current: DataFrame) -> DataFrame:
    """(machine, records, first_date, last_date) of what other versions counted: what has to be exported again."""
    c = F.coalesce(times.filled(F.col("counter")), F.lit("unstamped"))
    keep = current.filter("current").select(F.col("counter").alias("_c"))
    stale = records.withColumn("_c", c).join(keep, "_c", "left_anti")
    return stale.groupBy("machine").agg(F.count(F.lit(1)).alias("records"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def freshness(records: DataFrame, now: Column, stale_hours: float = 48) -> DataFrame:
    """(machine, last_seen_s, age_hours, stale): the latest readable stamp of each machine; machines without one are stale."""
    f = records.groupBy("machine").agg(F.max(times.instant(F.col("generated_at"))).alias("seen"))
    age = (F.unix_micros(now) - F.unix_micros("seen")) / F.lit(3.6e9)
    return f.select("machine", F.unix_micros("seen").alias("last_seen"), F.round(age, 4).alias("age_hours"), F.coalesce(age > stale_hours, F.lit(True)).alias("stale"))


def identical_buckets(records: DataFrame) -> DataFrame:
    """(date, model, five fields, machines, machine_a, machine_b): the same non-zero counts of a model on a date from several machines; the first two are named."""
    e = records.select("machine", "date", F.explode("models").alias("model", "t")).select("machine", "date", "model", *[F.coalesce(F.col(f"t.{f}"), F.lit(0).cast("long")).alias(f) for f in TOKEN_FIELDS])
    some = " or ".join(f"{f} <> 0" for f in TOKEN_FIELDS)
    each = e.filter(some).groupBy("date", "model", *TOKEN_FIELDS, "machine").agg(F.lit(1).alias("_one"))
    g = each.groupBy("date", "model", *TOKEN_FIELDS).agg(F.count(F.lit(1)).alias("machines"), F.min("machine").alias("machine_a"))
    second = each.join(g.filter("machines > 1").select("date", "model", *TOKEN_FIELDS, "machines", "machine_a"), ["date", "model", *TOKEN_FIELDS]).filter("machine > machine_a")
    return second.groupBy("date", "model", *TOKEN_FIELDS, "machines", "machine_a").agg(F.min("machine").alias("machine_b"))


def anomalies(daily: DataFrame, least_days: int = 7, threshold: float = 3.5, day: str = "day", value: str = "total", top: int | None = None) -> DataFrame:
    """(day, value, z, ratio) of days whose log10(total + 1) has a modified z score of at least the threshold.

    z = 0.6745 (x - median) / MAD; where the MAD is 0, the mean absolute deviation over 0.7979 takes its
    place. ``daily`` has one row a day. Fewer days than ``least_days``, or all alike: no rows. With ``top`` only the farthest off, in order.
    """
    x = daily.select(day, value, F.log10(F.col(value) + F.lit(1.0)).alias("x"))
    m = x.agg(F.percentile("x", F.lit(0.5)).alias("m"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_days)
    d = x.join(F.broadcast(m), F.lit(True)).withColumn("dev", F.abs(F.col("x") - F.col("m")))
    s = d.agg(F.percentile("dev", F.lit(0.5)).alias("mad"), F.avg("dev").alias("aad"))
    scale = F.when(F.col("mad") > 0, F.col("mad") / F.lit(0.6745)).otherwise(F.col("aad") / F.lit(0.7979))
    z = d.join(F.broadcast(s), F.lit(True)).withColumn("s", scale).filter("s > 0").withColumn("z", (F.col("x") - F.col("m")) / F.col("s"))
    typical = F.pow(F.lit(10.0), F.col("m")) - 1
    z = z.filter(F.abs("z") >= threshold)
    if top:
        z = z.orderBy(F.desc(F.abs("z")), day).limit(top)
    return z.select(day, value, F.bround("z", 1).alias("z"), F.bround(F.try_divide(F.col(value).cast("double"), typical), 2).alias("ratio"))

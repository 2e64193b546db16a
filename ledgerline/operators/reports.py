"""Breakdowns, splits, health, periods, records and streaks over the invocation ledger.

Every operator takes a ledger as ``normalized`` gives it. Missing counts are 0, a missing model is
``unknown`` and a missing ``exact`` is measured. All sums combine on the map side, so a hot model,
session or machine never gathers in one task; top lists keep their limit per partition first.
Empty ledgers give no rows, or one row of zeros where a total is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times
from ..schema import TOKEN_FIELDS
from ..session import literal


def normalized(invocations: DataFrame) -> DataFrame:
    """The ledger: counts without nulls, model named, UTC day, total of the five fields; rows without a timestamp are in no window and left out."""
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    others = [F.col(c) for c in invocations.columns if c not in (*TOKEN_FIELDS, "model", "exact", "day", "total")]
    rows = invocations.filter("timestamp is not null").select(
        *others, F.coalesce("model", F.lit("unknown")).alias("model"), F.coalesce("exact", F.lit(True)).alias("exact"), *[zero(f) for f in TOKEN_FIELDS], times.day_text(F.col("timestamp")).alias("day")
    )
    return rows.withColumn("total", sum((F.col(f) for f in TOKEN_FIELDS[1:]), F.col(TOKEN_FIELDS[0])))


def in_window(ledger: DataFrame, lower: Column | None = None, upper: Column | None = None) -> DataFrame:
    """Closed at both ends; None leaves an end open."""
    for end, keep in ((lower, lambda e: F.col("timestamp") >= e), (upper, lambda e: F.col("timestamp") <= e)):
        if end is not None:
            ledger = ledger.filter(keep(end))
    return ledger


def _sums() -> list[Column]:
    return [F.sum(f).alias(f) for f in (*TOKEN_FIELDS, "total")]


def breakdown(ledger: DataFrame, *by: str) -> DataFrame:
    """Sums of the token fields and number of calls by any columns."""
    return ledger.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), *_sums())


def day_model_all(ledger: DataFrame) -> DataFrame:
    """By day, by model and in total, in one pass over the ledger."""
    g = ledger.groupingSets([[F.col("day")], [F.col("model")], []], F.col("day"), F.col("model"))
    return g.agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("calls"), *_sums())


def exact_split(ledger: DataFrame) -> DataFrame:
    """Measured and estimated tokens and calls; confidence in percent, 100 where there are no tokens."""
    on = lambda c, v: F.coalesce(F.sum(F.when(F.col("exact") == v, F.col(c))), F.lit(0).cast("long"))
    a = ledger.withColumn("one", F.lit(1).cast("long")).agg(
        on("one", True).alias("measured_calls"), on("one", False).alias("estimated_calls"), on("total", True).alias("measured"), on("total", False).alias("estimated")
    )
    return a.withColumn("confidence", F.round(F.coalesce(F.try_divide(F.col("measured") * 100.0, F.col("measured") + F.col("estimated")), F.lit(100.0)), 6))


#: Shares of cache reads and what they are called (fixed values).
LABELS = ((0.95, "Excellent"), (0.85, "Good"), (0.60, "Warning"))
COLD = "Cold context leak"


def cache_label(share: Column) -> Column:
    out = F.lit(COLD)
    for least, label in reversed(LABELS):
        out = F.when(share >= least, label).otherwise(out)
    return out


def _health(sums: DataFrame) -> DataFrame:
    share = F.col("cache_read") / F.col("total")
    h = sums.filter("total > 0").withColumn("share", share)
    return h.withColumn("label", cache_label(F.col("share"))).withColumn("warn", (F.col("input_tokens") > 250_000) | (F.col("share") < 0.85)).withColumn("share", F.round("share", 6))


def cache_health(ledger: DataFrame, by: str = "model") -> DataFrame:
    """Share of cache reads by any column; groups without tokens are left out."""
    return _health(breakdown(ledger, by)).select(by, "calls", "input_tokens", "cache_read", "total", "share", "label", "warn")


def session_health(ledger: DataFrame, top: int = 10) -> DataFrame:
    """The sessions with the most tokens (ties: by name) with their cache health and the source seen last."""
    last = F.max_by("source", F.struct("timestamp", "source")).alias("source")
    s = ledger.groupBy("session_id").agg(last, F.count(F.lit(1)).alias("calls"), *_sums())
    return _health(s).orderBy(F.desc("total"), "session_id").limit(top).select("session_id", "source", "calls", "input_tokens", "cache_read", "total", "share", "label", "warn")


def top_calls(ledger: DataFrame, top: int = 20) -> DataFrame:
    """The calls with the most input tokens; ties by time, then by all else, so the list is the same every time."""
    cols = ["timestamp", "source", "model", "session_id", "input_tokens", "output_tokens", "cache_read", "total"]
    return ledger.orderBy(F.desc("input_tokens"), *[F.asc_nulls_first(c) for c in cols]).limit(top).select(F.unix_micros("timestamp").alias("at"), *cols[1:])


def company(source: Column) -> Column:
    """What stands before `` (`` and before ``:``."""
    return F.trim(F.substring_index(F.substring_index(source, " (", 1), ":", 1))


def provider_label(source: Column, *known: tuple[str, str]) -> Column:
    """The first label of which the text occurs in the source; ``Fleet:x`` is x; else the company, or Unknown."""
    out = F.lit(None).cast("string")
    for part, label in reversed(known):
        out = F.when(F.contains(source, F.lit(part)), F.lit(label)).otherwise(out)
    fleet = F.when(F.startswith(source, F.lit("Fleet:")), F.substring_index(source, "Fleet:", -1))
    return F.coalesce(out, F.nullif(fleet, F.lit("")), F.nullif(company(source), F.lit("")), F.lit("Unknown"))


def provider_rollup(ledger: DataFrame) -> DataFrame:
    """By provider, with a TOTAL row; cache creation counts as input."""
    l = ledger.select(provider_label(F.col("source")).alias("provider"), (F.col("input_tokens") + F.col("cache_creation")).alias("input"), "output_tokens", "cache_read", "reasoning", "total")
    r = l.rollup("provider").agg(F.grouping("provider").alias("_g"), F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in ("input", "output_tokens", "cache_read", "reasoning", "total")])
    return r.withColumn("provider", F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("provider"))).drop("_g")


def buckets(ledger: DataFrame, classes: Sequence[tuple[str, str]], other: str = "other") -> DataFrame:
    """Totals of classes told by a part of the model's name (first match); every class has a row, zeros too."""
    label = F.lit(other)
    for part, name in reversed(classes):
        label = F.when(F.contains(F.lower("model"), F.lit(part)), F.lit(name)).otherwise(label)
    every = literal(ledger.sparkSession, [(n,) for n in dict.fromkeys([*(n for _, n in classes), other])], "bucket string")
    sums = ledger.groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("calls"), F.sum("total").alias("total"))
    j = every.join(sums, "bucket", "left")
    return j.select("bucket", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("calls", "total")])


def class_of(model: Column, classes: Sequence[tuple], other: Column) -> Column:
    """The class of the first rule whose part occurs in the model's name; a rule is (part, class) or (part, rules), and rules that say nothing leave it to ``other``."""
    out = other
    for part, what in reversed(classes):
        out = F.when(F.contains(F.lower(model), F.lit(part)), F.lit(what) if isinstance(what, str) else class_of(model, what, other)).otherwise(out)
    return out


def _names(classes: Sequence[tuple]) -> list[str]:
    return [n for _, what in classes for n in ([what] if isinstance(what, str) else _names(what))]


def class_costs(bill: DataFrame, classes: Sequence[tuple], by_rate: Sequence[tuple[int, str]] = (), other: str = "other") -> DataFrame:
    """Calls, total and cost (a decimal) of classes, zeros too, over a bill by model (see ``rates.billed``).

    Models that no name tells take the class of the first threshold that their input rate reaches; without any, ``other``.
    """
    rest = F.lit(other)
    for least, name in reversed(by_rate):
        rest = F.when(F.col("input") >= F.lit(least), F.lit(name)).otherwise(rest)
    every = literal(bill.sparkSession, [(n,) for n in dict.fromkeys([*_names(classes), *(n for _, n in by_rate), other])], "bucket string")
    sums = bill.groupBy(class_of(F.col("model"), classes, rest).alias("bucket")).agg(F.sum("calls").alias("calls"), F.sum("total").alias("total"), F.sum("cost").alias("cost"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,0)" if c == "cost" else "long").alias(c)
    return every.join(sums, "bucket", "left").select("bucket", *[zero(c) for c in ("calls", "total", "cost")])


def delta_text(now: Column, before: Column) -> Column:
    """Change in percent with its sign; ``new`` from nothing, ``-`` from nothing to nothing."""
    pct = F.round(F.try_divide((now - before) * 100.0, before), 1) + F.lit(0.0)
    return F.when(before == 0, F.when(now > 0, "new").otherwise("-")).otherwise(F.concat(F.when(pct >= 0, "+").otherwise(""), F.format_string("%.1f%%", pct)))


def compare_periods(ledger: DataFrame, now: Column, days: int) -> DataFrame:
    """By company, tokens of the last ``days`` against those of the ``days`` before: [now - n, ..) and [now - 2n, now - n)."""
    span = F.expr(f"interval {days} days")
    cur, prev = F.col("timestamp") >= now - span, (F.col("timestamp") >= now - span - span) & (F.col("timestamp") < now - span)
    c = ledger.filter(F.col("timestamp") >= now - span - span).groupBy(company(F.col("source")).alias("company"))
    a = c.agg(*[F.coalesce(F.sum(F.when(w, F.col("total"))), F.lit(0).cast("long")).alias(n) for w, n in ((cur, "current"), (prev, "previous"))])
    return a.withColumn("change", delta_text(F.col("current"), F.col("previous")))


def _start(unit: str, ts: Column) -> Column:
    if unit == "half":
        return F.when(F.month(ts) <= 6, F.date_trunc("year", ts)).otherwise(F.add_months(F.date_trunc("year", ts), 6).cast("timestamp"))
    return F.date_trunc(unit, ts)


def lanes(ledger: DataFrame, now: Column) -> DataFrame:
    """The last 24 hours, and week, month, quarter, half year and year to date, each against the same stretch of the period before it (cut at that period's end)."""
    ts = F.col("timestamp")
    back = {"week": F.expr("interval 7 days"), "month": F.expr("interval 1 month"), "quarter": F.expr("interval 3 months"), "half": F.expr("interval 6 months"), "year": F.expr("interval 1 year")}
    day = F.expr("interval 24 hours")
    windows = {"24h": (now - day, now, now - day - day, now - day)}
    for unit, step in back.items():
        start = _start(unit, now)
        before = start - step
        windows[unit] = (start, now, before, F.least(start, before + (now - start)))
    out = []
    for name, (a, b, c, d) in windows.items():
        first = ts > a if name == "24h" else ts >= a
        second = (ts > c) & (ts <= d) if name == "24h" else (ts >= c) & (ts < d)
        out += [F.coalesce(F.sum(F.when(first & (ts <= b), F.col("total"))), F.lit(0).cast("long")).alias(f"{name}_now"), F.coalesce(F.sum(F.when(second, F.col("total"))), F.lit(0).cast("long")).alias(f"{name}_before")]
    one = ledger.agg(*out)
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("lane"), F.col(f"{n}_now").alias("current"), F.col(f"{n}_before").alias("previous")) for n in windows])))


def records(daily: DataFrame, day: str = "day", value: str = "total") -> DataFrame:
    """The highest day, ISO week and month; ties go to the earliest."""
    d = daily.select(F.col(day).cast("date").alias("d"), F.col(value).alias("v"))
    keys = {"day": F.col("d").cast("string"), "week": F.concat(F.extract(F.lit("yearofweek"), "d").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("d").cast("string"), 2, "0")), "month": F.date_format("d", "yyyy-MM")}
    out = None
    for name, key in keys.items():
        s = d.groupBy(key.alias("k")).agg(F.sum("v").alias("v")).withColumn("r", -F.col("v"))
        best = s.agg(F.min(F.struct("r", "k")).alias("b")).filter("b is not null").select(F.lit(name).alias("period"), F.col("b.k").alias("key"), (-F.col("b.r")).alias("value"))
        out = best if out is None else out.unionByName(best)
    return out


def streaks(daily: DataFrame, today: DataFrame, day: str = "day", value: str = "total") -> DataFrame:
    """One row: longest run of days with anything (the earliest of equals), and the run that reaches today, or else yesterday.

    ``daily`` has one row a day, so the window that numbers days holds days only; ``today`` is one row of one date.
    """
    d = daily.filter(F.col(value) > 0).select(F.col(day).cast("date").alias("d")).distinct()
    runs = d.withColumn("g", F.date_sub("d", F.row_number().over(Window.orderBy("d")))).groupBy("g").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count(F.lit(1)).alias("n"))
    runs = runs.join(F.broadcast(today.toDF("_today").select(F.col("_today").cast("date"))), F.lit(True), "left")
    here = (F.col("last") >= F.date_sub("_today", 1)) & (F.col("last") <= F.col("_today"))
    return runs.agg(
        F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("longest"),
        F.max_by(F.col("first").cast("string"), F.struct("n", -F.unix_date("first"))).alias("longest_first"),
        F.max_by(F.col("last").cast("string"), F.struct("n", -F.unix_date("first"))).alias("longest_last"),
        F.coalesce(F.max(F.when(here, F.col("n"))), F.lit(0).cast("long")).alias("current"),
    )


def spine(daily: DataFrame, key: str, day: str = "day", value: str = "total") -> DataFrame:
    """Every key on every day from the first to the last of all, 0 where it has none: small dimensions, one row each."""
    ends = daily.agg(F.min(day).cast("date").alias("a"), F.max(day).cast("date").alias("b")).filter("a is not null")
    days = ends.select(F.explode(F.transform(F.sequence("a", "b"), lambda x: x.cast("string"))).alias(day))
    keys = daily.select(key).distinct()
    # days x keys is the result itself; the days are broadcast, one row each
    full = keys.withColumn("_all", F.lit(1)).join(F.broadcast(days.withColumn("_all", F.lit(1))), "_all").drop("_all")
    return full.join(daily.select(key, day, value), [key, day], "left").withColumn(value, F.coalesce(value, F.lit(0).cast("long")))


def day_spikes(ledger: DataFrame, times_median: int = 3, least_days: int = 3, least: int = 50_000) -> DataFrame:
    """Days of a source with at least so many times its (upper) median day, counting input and cache creation."""
    daily = ledger.groupBy("source", "day").agg(F.sum(F.col("input_tokens") + F.col("cache_creation")).alias("value"))
    # days of a source: bounded by the calendar
    med = daily.groupBy("source").agg(F.array_sort(F.collect_list("value")).alias("v")).filter(F.size("v") >= least_days).select("source", F.element_at("v", F.floor(F.size("v") / 2).cast("int") + 1).alias("median"))
    return daily.join(med, "source").filter((F.col("value") >= F.lit(times_median) * F.col("median")) & (F.col("value") > least)).select("source", "day", "value", "median")


def findings(ledger: DataFrame) -> DataFrame:
    """(rule, source, subject, value): concentration of tokens in one model, cold caches, cache churn, estimated sources, day spikes.

    A rule that nothing crosses gives no row.
    """
    models = ledger.groupBy("model").agg(F.sum("total").alias("v"))
    grand = models.agg(F.sum("v").alias("all"), F.count(F.lit(1)).alias("n"), F.max(F.struct("v", "model")).alias("m")).filter("n > 1 and all > 0 and m.v >= 0.6 * all")
    r1 = grand.select(F.lit("concentration").alias("rule"), F.lit("").alias("source"), F.col("m.model").alias("subject"), F.round(F.col("m.v") / F.col("all"), 4).alias("value"))
    s = ledger.groupBy("source").agg(*_sums(), F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("exact"), 1)).alias("est"))
    context = F.col("input_tokens") + F.col("cache_creation") + F.col("cache_read")
    one = lambda rule, keep, value: s.filter(keep).select(F.lit(rule).alias("rule"), "source", F.lit("").alias("subject"), F.round(value, 4).alias("value"))
    hit = F.col("cache_read") / context
    r2 = one("cold cache", (context >= 100_000) & (hit < 0.5), hit)
    r3 = one("cache churn", (F.col("cache_creation") > F.col("cache_read")) & (F.col("cache_read") > 0), F.col("cache_creation") / F.col("cache_read"))
    r4 = one("estimated", F.col("est") > 0.5 * F.col("n"), F.col("est") / F.col("n"))
    r5 = day_spikes(ledger).select(F.lit("day spike").alias("rule"), "source", F.col("day").alias("subject"), F.round(F.col("value") / F.col("median"), 4).alias("value"))
    return r1.unionByName(r2).unionByName(r3).unionByName(r4).unionByName(r5)


def cross_check(ledger: DataFrame, native: DataFrame) -> DataFrame:
    """One row: tokens billed here (input, output, reasoning) against a native total (threads, tokens), and the difference in percent; null against none."""
    ours = ledger.agg(F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens") + F.col("reasoning")), F.lit(0).cast("long")).alias("counted"))
    # one row each
    j = ours.join(F.broadcast(native), F.lit(True))
    return j.select("counted", "threads", F.col("tokens").alias("native"), F.round(F.try_divide((F.col("counted") - F.col("tokens")) * 100.0, F.col("tokens")), 2).alias("delta"))

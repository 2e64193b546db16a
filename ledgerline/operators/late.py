"""Late and out-of-order records: periods (days) close by per-source low watermarks.

Every record is a punctuation of its source: nothing older than its stamp is expected from there any
more, so the source's low watermark is its greatest stamp so far less the lateness allowed. A source
passes a day with the first record that moves its watermark beyond the day's end; that record and all
later ones of the day are diverted. For all sources together a day closes when each source has passed it
or was silent for the idle timeout.

The records are replayed in the order of their stamps, in segments: the records of one source and day
between two moves of the source's watermark over a day's end. A segment is one aggregate that combines on the map side, so
a source or a day with a third of all rows moves as few rows as days lie within its records' delays. Watermarks,
passes and closings run over segments; so does the diversion, which is decided by when the source passed the day.
``ledgerline.streaming.late`` has the form that runs on arrival order.

Defined cases: records with an unreadable stamp or period are not considered; ties in the stamp are
broken by ``order``; repeated records change nothing; null values compare as equal to null; a null source
is a source of its own; a source counts from its first stamp on: a day whose bound lies before it does not wait for
it, and its records of that day are all diverted. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

HOUR = 3_600_000_000
DAY = 24 * HOUR


def diverted(stamp: Column, ends: Column, lateness: int) -> Column:
    """Whether the source's low watermark, this record's punctuation included, is beyond the period's end (microseconds)."""
    return F.unix_micros(stamp) - F.lit(lateness) > ends


@dataclass
class Replay:
    """Segments (s, d, p, ...) and passes (s, d, passed_at, idle) of records replayed in the order of their stamps.

    d is the day a record belongs to, p the last day that its source has passed with it.
    """

    segments: DataFrame
    passes: DataFrame

    def closings(self) -> DataFrame:
        """When each day closes for all sources: (day, closed_at, n_passed, n_idle). A day that no source waits for has no row."""
        c = self.passes.groupBy("d").agg(F.timestamp_micros(F.max("passed_at")).alias("closed_at"), F.count(F.when(~F.col("idle"), 1)).alias("n_passed"), F.count(F.when(F.col("idle"), 1)).alias("n_idle"))
        return c.select(F.date_from_unix_date("d").alias("day"), "closed_at", "n_passed", "n_idle")

    def settled(self) -> DataFrame:
        """One row per source and day: what stands after every record in time, and what came too late.

        Columns: source, day, n_in_time, n_late, first_value, last_value, last_stamp, corrected (the last
        value in time differs from the first), missed (a late value differs from the last in time, or none
        was in time). Least and greatest late value decide the latter: some late value differs from v
        exactly if one of these does.
        """
        p = self.passes.select(F.col("s").alias("_s"), F.col("d").alias("_d"), "passed_at", "idle")
        j = self.segments.join(p, self.segments["s"].eqNullSafe(p["_s"]) & (self.segments["d"] == p["_d"]), "left")
        # the record that passes the day is diverted, too; a timeout is no record
        late = F.coalesce(F.when(F.col("idle"), F.col("from") > F.col("passed_at")).otherwise(F.col("from") >= F.col("passed_at")), F.lit(True))
        ok = lambda c: F.when(~F.col("late"), F.col(c))
        no = lambda c: F.when(F.col("late"), F.col(c))
        by = j.withColumn("late", late).groupBy("s", "d").agg(
            F.coalesce(F.sum(ok("n")), F.lit(0).cast("long")).alias("n_in_time"),
            F.coalesce(F.sum(no("n")), F.lit(0).cast("long")).alias("n_late"),
            F.min_by("first", ok("first_at")).alias("f"),
            F.max_by("last", ok("last_at")).alias("l"),
            F.max(ok("last_at")).alias("l_at"),
            F.min(no("lo")).alias("lo"),
            F.max(no("hi")).alias("hi"),
        )
        some_late, none_in_time = F.col("n_late") > 0, F.col("n_in_time") == 0
        return by.select(
            F.col("s").alias("source"),
            F.date_from_unix_date("d").alias("day"),
            "n_in_time",
            "n_late",
            F.col("f.v").alias("first_value"),
            F.col("l.v").alias("last_value"),
            F.col("l_at.t").alias("last_stamp"),
            (~none_in_time & ~F.col("f").eqNullSafe(F.col("l"))).alias("corrected"),
            (none_in_time | (some_late & ~(F.col("lo").eqNullSafe(F.col("l")) & F.col("hi").eqNullSafe(F.col("l"))))).alias("missed"),
        )


def replay(records: DataFrame, source: str, day: str, stamp: str, value: str, order: str, lateness: int = 72 * HOUR, idle: int = 7 * DAY) -> Replay:
    """Replays records (source, day, stamp, value, order); the module says how. ``day`` is a date, ``stamp`` a timestamp."""
    t = F.unix_micros(stamp)
    passed = F.floor((t - F.lit(lateness) - 1) / F.lit(DAY)).cast("int") - 1
    at = F.struct(F.col(stamp).alias("t"), F.col(order).alias("o"))
    # one struct per value keeps a null value apart from no value at all
    r = records.filter(F.col(stamp).isNotNull() & F.col(day).isNotNull()).select(F.col(source).alias("s"), F.unix_date(day).alias("d"), passed.alias("p"), t.alias("t"), F.struct(F.col(value).alias("v")).alias("v"), at.alias("at"))
    segments = cut(
        r.groupBy("s", "d", "p").agg(
            F.count(F.lit(1)).alias("n"), F.min("t").alias("from"), F.max("t").alias("to"), F.min_by("v", "at").alias("first"), F.min("at").alias("first_at"),
            F.max_by("v", "at").alias("last"), F.max("at").alias("last_at"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        )
    )
    return Replay(segments, _passes(segments, lateness, idle))


def _passes(segments: DataFrame, lateness: int, idle: int) -> DataFrame:
    """(s, d, passed_at, idle): when each source passes each day from the first to the last of all.

    That is its first stamp beyond the end of d plus the lateness, or, if it stays silent for ``idle`` after its
    last stamp before that, when the timeout runs out (but not before the bound itself). The window runs
    over the days that a source's watermark stood at, one row each at most.
    """
    marks = segments.groupBy("s", "p").agg(F.min("from").alias("lo"), F.max("to").alias("hi"))
    days = segments.agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"))
    ahead = Window.partitionBy("s").orderBy("p")
    steps = marks.select("s", "p", "hi", F.lead("p").over(ahead).alias("next_p"), F.lead("lo").over(ahead).alias("next_lo")).join(F.broadcast(days), F.lit(True))
    # from p + 1 up to next_p the days are passed by the next record that moves the watermark
    low, high = F.greatest(F.col("p") + 1, F.col("first_day")), F.least(F.coalesce("next_p", F.col("last_day")), F.col("last_day"))
    d = steps.filter(low <= high).withColumn("d", F.explode(F.sequence(low, high)))
    bound = (F.col("d") + 1).cast("long") * F.lit(DAY) + F.lit(lateness)
    timeout = F.greatest(bound, F.col("hi") + F.lit(idle))
    is_idle = F.col("next_lo").isNull() | (F.col("next_lo") > timeout)
    return d.select("s", "d", F.when(is_idle, timeout).otherwise(F.col("next_lo")).alias("passed_at"), is_idle.alias("idle"))

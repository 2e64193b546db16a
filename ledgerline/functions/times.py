"""Instants and days. All results are UTC whatever the session's zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2}|[+-][0-9]{2})?)?$"
#: The white space that ids, names and stamps are trimmed of, at either end.
_EDGES = " \t\n\x0b\x0c\r\u00a0"


def trimmed(text: Column) -> Column:
    """Without white space of any kind (tabs too) at the ends; null stays null."""
    return F.btrim(text, F.lit(_EDGES))


def filled(text: Column) -> Column:
    """Trimmed, and null where nothing is left."""
    return F.nullif(trimmed(text), F.lit(""))


def instant(text: Column) -> Column:
    """An ISO stamp as an instant; without a zone it is UTC.

    Any number of fraction digits (cut to microseconds), ``Z`` or an offset, ``T`` or a blank, a
    bare date (its midnight). Null for null, blank, and anything that is no such stamp or no such day.
    """
    s = F.upper(trimmed(text))
    clock = F.substring(s, 12, 60)
    has_zone = F.contains(clock, F.lit("Z")) | F.contains(clock, F.lit("+")) | F.contains(clock, F.lit("-"))
    zoned = F.when(F.length(s) <= 10, F.concat(s, F.lit("T00:00:00Z"))).when(has_zone, s).otherwise(F.concat(s, F.lit("Z")))
    return F.when(s.rlike(_STAMP), zoned.try_cast("timestamp"))


def day_number(ts: Column) -> Column:
    """Days since 1970-01-01 UTC."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(86_400_000_000)).cast("int")


def day(ts: Column) -> Column:
    """The UTC date of an instant."""
    return F.date_from_unix_date(day_number(ts))


def day_text(ts: Column) -> Column:
    return day(ts).cast("string")


def loose_date(text: Column) -> Column:
    """A date spelled ``YYYY-MM-DD``, ``YYYY/MM/DD`` or ``YYYYMMDD`` with blanks around; null for anything else."""
    # one match; what is left of it are the digits
    s = trimmed(text)
    digits = F.translate(s, "-/", "")
    iso = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    return F.when(s.rlike(r"^[0-9]{4}[-/]?[0-9]{2}[-/]?[0-9]{2}$"), iso.try_cast("date"))


def end_of(date: Column) -> Column:
    """Microseconds since 1970 at which a UTC date ends."""
    return (F.unix_date(date) + 1).cast("long") * F.lit(86_400_000_000)

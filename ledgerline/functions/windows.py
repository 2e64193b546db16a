"""Which stretch of time a report covers: a pure function of its arguments."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone, tzinfo


def resolve(now: datetime, days: int | None = None, weeks: int | None = None, start: str | None = None, end: str | None = None, month: str | None = None, cutoff: str | None = None, compare: int | None = None, history: bool = False, default_days: int = 7, zone: tzinfo = timezone.utc) -> tuple[datetime, datetime | None]:
    """(lower, upper), both inclusive; an upper of None is open.

    A range (its last day whole) goes before a month, a month before a cut-off, that before days back
    from now. Days go before weeks. A comparison of n days needs 2n, the whole history 760. Stamps
    without a zone are in ``zone``. A month that is none raises ValueError.
    """
    span = days if days is not None else weeks * 7 if weeks is not None else default_days
    span = max(span, 2 * (compare or 0), 760 if history else 0)
    at = lambda s: (d := datetime.fromisoformat(s)) if (d := datetime.fromisoformat(s)).tzinfo else d.replace(tzinfo=zone)
    back = now - timedelta(days=span)
    if start or end:
        return (at(start) if start else back, at(end) + timedelta(days=1) if end else None)
    if month:
        year, _, m = month.partition("-")
        first = datetime(int(year), int(m), 1, tzinfo=zone)
        return first, datetime(first.year + first.month // 12, first.month % 12 + 1, 1, tzinfo=zone)
    if cutoff:
        return at(cutoff), None
    return back, None

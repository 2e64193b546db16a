"""What people and programs ask for: a summary of a fleet, its page, its flags, a text report, and table functions.

Each view is a handful of small aggregates; what is collected has a row per machine, machine and day, or model.
"""

from __future__ import annotations

import html
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import human, text_table
from ..operators import fleet, rates, reports
from ..schema import TOKEN_FIELDS
from ..session import cut


def total_of(column: str):
    """The five fields of a token struct; missing ones count 0."""
    return sum((F.coalesce(F.col(f"{column}.{f}"), F.lit(0)) for f in TOKEN_FIELDS), F.lit(0).cast("long"))


@dataclass
class FleetSummary:
    machines: list[dict] = field(default_factory=list)
    days: list[dict] = field(default_factory=list)
    overlaps: list[dict] = field(default_factory=list)
    confidence: float | None = None
    #: What bars, days and the threshold go by: ``cost`` if rates were given, else ``total`` tokens.
    unit: str = "total"

    @property
    def busiest_day(self) -> tuple[str, float] | None:
        sums: dict[str, float] = {}
        for d in self.days:
            sums[d["date"]] = sums.get(d["date"], 0) + d[self.unit]
        return max(sorted(sums.items()), key=lambda x: x[1]) if sums else None

    @property
    def amount(self) -> float:
        return sum(m[self.unit] for m in self.machines)

    def text(self, amount: float) -> str:
        return f"${amount:,.2f}" if self.unit == "cost" else f"{human(int(amount))} tokens"

    @property
    def cache_share(self) -> float:
        all_ = sum(m["total"] for m in self.machines)
        return sum(m["cache_read"] for m in self.machines) / all_ if all_ else 0.0


def fleet_summary(records: DataFrame, now: datetime, days: int | None = None, stale_hours: float = 48, local: str | None = None, price: Callable[[DataFrame], DataFrame] | None = None) -> FleetSummary:
    """Machines, machine days, double counts and the measured share of records with machine and date.

    ``price`` turns records into ``fleet.priced`` rows; with it machines and days have costs, machines are ordered by
    them, and the top model is the dearest. With ``days`` only dates from so many days before now count, but a machine's freshness counts all. The
    local machine is never stale. No tokens at all: the measured share is None.
    """
    usable = records.filter((F.coalesce("machine", F.lit("")) != "") & (F.coalesce("date", F.lit("")) != ""))
    w = usable.filter(F.col("date") >= (now - timedelta(days=days)).strftime("%Y-%m-%d")) if days else usable
    w = w.withColumn("total", total_of("totals"))
    fresh = {r.machine: r for r in fleet.freshness(usable, F.lit(now), stale_hours).collect()}
    per = w.groupBy("machine").agg(F.sum("total").alias("total"), F.sum(F.coalesce("invocations", F.lit(0))).alias("calls"), F.sum(F.coalesce("totals.cache_read", F.lit(0))).alias("cache_read"), F.sum(total_of("exact")).alias("exact"), F.sum(total_of("estimated")).alias("estimated"))
    if price is not None:
        return _priced_summary(w, price(w), fresh, local)
    top = w.select("machine", F.explode("models").alias("model", "t")).groupBy("machine", "model").agg(F.sum(total_of("t")).alias("n")).groupBy("machine").agg(F.max_by("model", F.struct("n", "model")).alias("top_model"))
    rows = per.join(top, "machine", "left").orderBy(F.desc("total"), "machine").collect()
    machines = [r.asDict() | {"age_hours": fresh[r.machine].age_hours, "stale": fresh[r.machine].stale and r.machine != local} for r in rows]
    measured = sum(m["exact"] for m in machines), sum(m["exact"] + m["estimated"] for m in machines)
    return FleetSummary(
        machines,
        [r.asDict() for r in w.groupBy("machine", "date").agg(F.sum("total").alias("total")).orderBy("date", "machine").collect()],
        [r.asDict() for r in fleet.identical_buckets(w).groupBy("date", "machine_a", "machine_b").agg(F.count(F.lit(1)).alias("buckets")).orderBy("date", "machine_a").collect()],
        measured[0] / measured[1] if measured[1] else None,
    )


def _priced_summary(w: DataFrame, days: DataFrame, fresh: dict, local: str | None) -> FleetSummary:
    days = cut(days)
    costs = fleet.machine_costs(w, days).withColumn("cost", rates.money(F.col("cost")))
    sure = w.groupBy("machine").agg(F.sum(total_of("exact")).alias("exact"), F.sum(total_of("estimated")).alias("estimated"))
    rows = costs.join(sure, "machine").orderBy(F.desc("cost"), "machine").collect()
    machines = [r.asDict() | {"age_hours": fresh[r.machine].age_hours, "stale": fresh[r.machine].stale and r.machine != local} for r in rows]
    measured = sum(m["exact"] for m in machines), sum(m["exact"] + m["estimated"] for m in machines)
    per_day = fleet.spend(days, "machine", F.col("day").alias("date")).withColumn("cost", rates.money(F.col("cost")))
    twice = fleet.identical_buckets(w).groupBy("date", "machine_a", "machine_b").agg(F.count(F.lit(1)).alias("buckets"))
    return FleetSummary(machines, [r.asDict() for r in per_day.orderBy("date", "machine").collect()], [r.asDict() for r in twice.orderBy("date", "machine_a").collect()], measured[0] / measured[1] if measured[1] else None, "cost")


def flags(s: FleetSummary, threshold: float = 0) -> list[tuple[str, str]]:
    """(level, text): spend (tokens without rates) over a threshold (0: none), double counts, stale machines, an unmeasured share; else one ``ok``."""
    out = []
    if threshold and s.amount >= threshold:
        out.append(("alert", f"{s.text(s.amount)} reach the threshold of {s.text(threshold)}"))
    out += [("alert", f"{o['machine_a']} and {o['machine_b']} report {o['buckets']} identical counts on {o['date']}") for o in s.overlaps]
    if stale := [m["machine"] for m in s.machines if m["stale"]]:
        out.append(("warn", "not heard of lately: " + ", ".join(stale)))
    if s.confidence is not None and s.confidence < 0.999:
        out.append(("note", f"{s.confidence:.1%} of the tokens are measured, the others estimated"))
    return out or [("ok", "nothing to report")]


def colors(machines: list[str], slots: int = 3) -> dict[str, int]:
    """A slot by sorted name; all beyond the slots share the last."""
    return {m: min(i, slots) for i, m in enumerate(sorted(machines))}


def thinned(labels: list[str], most: int = 8) -> list[str]:
    """So many labels of an axis at most, evenly apart, and the last; the others are empty."""
    step = -(-len(labels) // most) or 1
    return [x if i % step == 0 or i == len(labels) - 1 else "" for i, x in enumerate(labels)]


def page(s: FleetSummary, title: str = "Fleet usage", threshold: float = 0, local: str | None = None) -> str:
    """One page without anything to load: flags, bars, days (if there are two), table; by cost if the summary has rates."""
    e, u = html.escape, s.unit
    slot = colors([m["machine"] for m in s.machines])
    peak = max([m[u] for m in s.machines], default=0) or 1
    bars = "".join(f'<div class="bar"><span>{e(m["machine"])}</span><i class="c{slot[m["machine"]]}" style="width:{max(0.6, 100 * m[u] / peak):.1f}%"></i><b>{s.text(m[u])}</b></div>' for m in s.machines)
    dates = sorted({d["date"] for d in s.days})
    by = {(d["date"], d["machine"]): d[u] for d in s.days}
    tall = max([sum(by.get((d, m), 0) for m in slot) for d in dates], default=0) or 1
    columns = "".join('<div class="day" title="' + e(d) + '">' + "".join(f'<i class="c{slot[m]}" style="height:{100 * by.get((d, m), 0) / tall:.2f}%"></i>' for m in sorted(slot)) + f"<span>{e(label)}</span></div>" for d, label in zip(dates, thinned(dates)))
    chart = f'<section class="days">{columns}</section>' if len(dates) >= 2 else ""
    state = lambda m: "this machine" if m["machine"] == local else "unknown" if m["age_hours"] is None else "stale" if m["stale"] else "ok"
    cells = "".join(f"<tr><td>{e(m['machine'])}</td><td>{state(m)}</td><td>{m['calls']:,}</td><td>{m['total']:,}</td><td>{s.text(m[u])}</td><td>{e(m['top_model'] or '')}</td></tr>" for m in s.machines)
    busiest = f"{s.busiest_day[0]}: {s.text(s.busiest_day[1])}" if s.busiest_day else "-"
    notes = "".join(f'<p class="{k}">{e(t)}</p>' for k, t in flags(s, threshold))
    style = "body{font:14px sans-serif;margin:2em}.bar i,.day i{display:block}.bar i{height:1em}.days{display:flex;height:12em;align-items:flex-end}.day{flex:1;height:100%;display:flex;flex-direction:column-reverse}.c0{background:#36c}.c1{background:#c63}.c2{background:#393}.c3{background:#999}.alert{color:#b00}"
    return f'<!doctype html><meta charset="utf-8"><title>{e(title)}</title><style>{style}</style><h1>{e(title)}</h1><p>{s.text(s.amount)}, {s.cache_share:.0%} read from caches, busiest day {e(busiest)}</p>{notes}<section>{bars}</section>{chart}<table><tr><th>machine<th>state<th>calls<th>tokens<th>amount<th>top model</tr>{cells}</table>'


def text_report(ledger: DataFrame, price: Callable[[DataFrame], DataFrame] | None = None, classes: Sequence[tuple] = (), native: DataFrame | None = None) -> str:
    """The ledger as text: by provider and model, measured share, cache health, classes, dearest calls, findings; with rates the bill, with a native total the cross check.

    ``price`` turns sums by model and day (day null) into ``rates.billed`` rows.
    """
    by_model = reports.breakdown(ledger, "model")
    label = reports.provider_label(F.col("source"))
    tables = {
        "BY PROVIDER": reports.provider_rollup(ledger).orderBy(F.col("provider") == "TOTAL", F.desc("total"), "provider"),
        "BY MODEL": by_model.select("model", "calls", "total").orderBy(F.desc("total"), "model"),
        "MEASURED": reports.exact_split(ledger),
        "CACHE HEALTH BY MODEL": reports.cache_health(ledger).orderBy(F.desc("total"), "model"),
        "CACHE HEALTH BY SESSION": reports.session_health(ledger).withColumn("source", label),
        "LARGEST CALLS": reports.top_calls(ledger).withColumns({"at": F.timestamp_micros("at").cast("string"), "source": label}),
    }
    if classes:
        tables["CLASSES OF MODELS"] = reports.buckets(ledger, classes)
    if price is not None:
        bill = price(by_model.withColumn("day", F.lit(None).cast("string")))
        tables["BILL"] = bill.select("model", "calls", "how", rates.money(F.col("cost")).alias("cost")).orderBy(F.desc("cost"), "model")
        sums = bill.agg(F.sum("cost").alias("c"), F.sum("cold").alias("d"))
        tables["WITHOUT CACHES"] = sums.select(rates.money(F.col("c")).alias("cost"), rates.money(F.col("d")).alias("cold"), rates.money(F.col("d") - F.col("c")).alias("saved"))
    if native is not None:
        tables["CROSS CHECK"] = reports.cross_check(ledger, native)
    tables["FINDINGS"] = reports.findings(ledger).orderBy("rule", "source", "subject")
    return "\n\n".join(f"{name}\n{text_table(df.columns, [tuple(r) for r in df.collect()])}" for name, df in tables.items())


class Kept:
    """A text that is made again only when it is older than its time to live; says how old it is."""

    def __init__(self, make: Callable[[], str], ttl: float = 900, clock: Callable[[], float] = time.monotonic):
        self._make, self._ttl, self._clock = make, ttl, clock
        self._made: tuple[float, str] | None = None

    def get(self) -> tuple[str, float]:
        """(text, age in seconds)"""
        now = self._clock()
        if self._made is None or now - self._made[0] > self._ttl:
            self._made = now, self._make()
        return self._made[1], now - self._made[0]


# ---- table functions: arguments are checked, results are DataFrames


def _days(days) -> int:
    if isinstance(days, bool) or not isinstance(days, int) or not 1 <= days <= 3650:
        raise ValueError("days must be a whole number from 1 to 3650")
    return days


def my_token_usage(ledger: DataFrame, machine: str, now: datetime | None = None, days: int = 7) -> DataFrame:
    """By day, of one machine."""
    return reports.breakdown(reports.in_window(ledger.filter(F.col("machine") == machine), F.lit((now or datetime.now(timezone.utc)) - timedelta(days=_days(days)))), "day")


def machine_token_usage(ledger: DataFrame, now: datetime | None = None, days: int = 7) -> DataFrame:
    """By machine."""
    return reports.breakdown(reports.in_window(ledger, F.lit((now or datetime.now(timezone.utc)) - timedelta(days=_days(days)))), "machine")


#: What a caller of the table functions has to be told beside their rows.
NOTES = {
    "my_token_usage": "Counts of one machine only; calls that were not measured are estimated.",
    "machine_token_usage": "Counts of this ledger only; machines that were not read are missing, not idle.",
    "fleet_token_usage": "Winning daily records; a day marked partial is still growing, and machines that do not export are missing.",
    "token_cost_by_model": "Costs are computed from tokens at the rates given, not from a bill.",
    "token_usage_provenance": "Estimated calls are derived from the length of texts.",
}


def fleet_token_usage(records: DataFrame, days: int | None = None, now: datetime | None = None, price: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """By machine, date, counter and in total, over the winning daily records; with ``price`` (see ``fleet_summary``) by machine with costs."""
    if days is not None:
        records = records.filter(F.col("date") >= ((now or datetime.now(timezone.utc)) - timedelta(days=_days(days))).strftime("%Y-%m-%d"))
    if price is not None:
        return fleet.machine_costs(records, price(records)).withColumn("cost", rates.money(F.col("cost")))
    return fleet.aggregate_long(records)


def token_cost_by_model(ledger: DataFrame, resolved_rates: DataFrame, now: datetime | None = None, days: int = 7) -> DataFrame:
    """Cost by model, each day at the rate in force then."""
    w = reports.in_window(ledger, F.lit((now or datetime.now(timezone.utc)) - timedelta(days=_days(days))))
    b = rates.billed(reports.breakdown(w, "model", "day"), resolved_rates)
    return b.groupBy("model").agg(F.sum("calls").alias("calls"), F.sum("total").alias("total"), rates.money(F.sum("cost")).alias("cost"))


def token_usage_provenance(ledger: DataFrame) -> DataFrame:
    """What is measured and what is estimated."""
    return reports.exact_split(ledger)

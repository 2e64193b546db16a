"""Reports, rates, fleet operators and views on small literal cases."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import windows
from ledgerline.functions.formats import human, humanized
from ledgerline.operators import fleet, ordered, rates, reports, textstats
from ledgerline.plans import views

Z = {"input_tokens": 0, "output_tokens": 0, "cache_creation": 0, "cache_read": 0, "reasoning": 0}
T = "struct<input_tokens:long,output_tokens:long,cache_creation:long,cache_read:long,reasoning:long>"


def calls(spark, rows):
    full = [{"machine": "box", "timestamp": datetime(2026, 8, 1, 12, tzinfo=timezone.utc), "source": "S", "model": "m", "exact": True, "session_id": "s", "fingerprint": "0"} | Z | r for r in rows]
    cols = ["machine", "timestamp", "source", "model", *Z, "exact", "session_id", "fingerprint"]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in full], "machine string, timestamp timestamp, source string, model string, input_tokens long, output_tokens long, cache_creation long, cache_read long, reasoning long, exact boolean, session_id string, fingerprint string")


def at(day, hour=12):
    return datetime(2026, 8, day, hour, tzinfo=timezone.utc)


def found(spark, rows):
    return {(r.rule, r.source, r.subject): r.value for r in reports.findings(reports.normalized(calls(spark, rows))).collect()}


def test_findings_are_silent_until_something_crosses(spark):
    healthy = [{"timestamp": at(d), "input_tokens": 1000, "cache_read": 200_000, "model": m} for d in range(1, 6) for m in ("a", "b")]
    assert found(spark, healthy) == {}
    assert found(spark, []) == {}
    assert found(spark, [{"output_tokens": 1_000_000, "model": "big", "cache_read": 1}, {"output_tokens": 1000, "model": "small"}]) == {("concentration", "", "big"): 0.999}
    assert found(spark, [{"input_tokens": 500_000}]) == {("cold cache", "S", ""): 0.0}
    assert ("cache churn", "S", "") in found(spark, [{"cache_creation": 400_000, "cache_read": 10_000}])
    assert found(spark, [{"exact": False}] * 4) == {("estimated", "S", ""): 1.0}
    days = [{"timestamp": at(d), "input_tokens": 100_000, "cache_read": 900_000} for d in range(1, 6)] + [{"timestamp": at(9), "input_tokens": 5_000_000, "cache_read": 10**8}]
    assert found(spark, days) == {("day spike", "S", "2026-08-09"): 50.0}
    assert found(spark, [{"timestamp": at(d), "input_tokens": n, "cache_read": n} for d, n in ((1, 100_000), (2, 9_000_000))]) == {}


def test_nulls_in_every_column(spark):
    df = spark.createDataFrame([(None,) * 12, (None, at(1), None, None, None, None, None, None, None, None, None, None)], calls(spark, []).schema)
    n = reports.normalized(df)
    assert [(r.model, r.exact, r.total, r.day) for r in n.collect()] == [("unknown", True, 0, "2026-08-01")]
    assert reports.provider_rollup(n).count() == 2 and reports.cache_health(n).count() == 0 and reports.session_health(n).count() == 0
    assert reports.exact_split(n).first().confidence == 100.0 and reports.exact_split(n.limit(0)).first().measured == 0
    assert fleet.rollup_long(df).filter("kind = 'certainty'").first().asDict()["name"] == "estimated"


def test_records_streaks_and_spine(spark):
    d = spark.createDataFrame([("2026-01-01", 5), ("2026-01-02", 5), ("2026-01-03", 0), ("2026-01-04", 1), ("2026-01-05", 1)], "day string, total long")
    assert {r.period: (r.key, r.value) for r in reports.records(d).collect()} == {"day": ("2026-01-01", 5), "week": ("2026-W01", 11), "month": ("2026-01", 12)}
    day = lambda s: spark.createDataFrame([(s,)], "today string")
    assert tuple(reports.streaks(d, day("2026-01-06")).first()) == (2, "2026-01-01", "2026-01-02", 2)
    assert reports.streaks(d, day("2026-01-07")).first().current == 0
    assert tuple(reports.streaks(d.limit(0), day("2026-01-07")).first()) == (0, None, None, 0)
    s = reports.spine(spark.createDataFrame([("a", "2026-01-01", 1), ("b", "2026-01-03", 2)], "k string, day string, total long"), "k")
    assert sorted(tuple(r) for r in s.collect()) == [(k, f"2026-01-0{n}", v) for k, vs in (("a", (1, 0, 0)), ("b", (0, 0, 2))) for n, v in enumerate(vs, 1)]


def test_periods(spark):
    now = at(15)
    l = reports.normalized(calls(spark, [{"timestamp": now - timedelta(days=n), "input_tokens": 10, "source": s} for n, s in ((1, "A (x)"), (7, "A:y"), (8, "A"), (9, "B"), (20, "C"))]))
    got = {r.company: (r.current, r.previous, r.change) for r in reports.compare_periods(l, F.lit(now), 7).collect()}
    assert got == {"A": (20, 10, "+100.0%"), "B": (0, 10, "-100.0%")}
    assert {r.lane: r.current for r in reports.lanes(l, F.lit(now)).collect()}["month"] == 40


def test_rates_resolve_in_order(spark):
    r = spark.createDataFrame([("m-5", 100, 200, 10), ("m-5-pro", 300, 400, 30)], "model string, input long, output long, cached long")
    d = spark.createDataFrame([("s-5", "2000-01-01", "2026-08-31", 2, 10, 1), ("s-5", "2026-09-01", None, 3, 15, 1)], "model string, first_day string, last_day string, input long, output long, cached long")
    days = [("m-5", None), ("m-5-high (estimated)", None), ("m-5-thinking-HIGH", None), ("m-5-pro-latest", None), ("m-5-x", None), ("high", None), ("z:free", None), ("s-5", "2026-08-31"), ("s-5", "2026-09-01"), ("s-5", None), (None, None)]
    got = {(x.model, x.day): (x.how, x.input) for x in rates.resolved(spark.createDataFrame(days, "model string, day string"), r, d, (1, 4, 1)).collect()}
    assert got == {
        ("m-5", None): ("exact", 100), ("m-5-high (estimated)", None): ("family", 100), ("m-5-thinking-HIGH", None): ("family", 100), ("m-5-pro-latest", None): ("family", 300), ("m-5-x", None): ("default", 1), ("high", None): ("default", 1),
        ("z:free", None): ("free", 0), ("s-5", "2026-08-31"): ("dated", 2), ("s-5", "2026-09-01"): ("dated", 3), ("s-5", None): ("default", 1), (None, None): ("default", 1),
    }
    one = spark.createDataFrame([("m", "d", 1_000_000, 0, 0, 1_000_000, 0)], "model string, day string, input_tokens long, output_tokens long, cache_creation long, cache_read long, reasoning long")
    rr = spark.createDataFrame([("m", "d", 500_000_000, 2_500_000_000, 50_000_000, "exact")], "model string, day string, input long, output long, cached long, how string")
    assert rates.billed(one, rr).select(rates.money(F.col("cost")), rates.money(F.col("cold"))).first()[:] == (5.5, 10.0)


def test_sketches_and_overlaps(spark):
    h = lambda k: f"{k * 7919 % 65536:04x}" * 4
    rows = [("d", m, h(k)) for m, ks in (("a", range(400)), ("b", range(200, 600)), ("c", range(5000, 5400))) for k in ks] + [("d", "a", h(1))] * 50 + [("d", "e", None)]
    sk = fleet.bottom_k(spark.createDataFrame(rows, "day string, machine string, h string"), ["day", "machine"], "h")
    got = {r.machine: r.sketch for r in sk.collect()}
    assert got["a"] == sorted({h(k) for k in range(400)})[:64] and "e" not in got
    o = fleet.overlaps(sk, 0.05).collect()
    assert [(r.machine_a, r.machine_b) for r in o] == [("a", "b")] and 0.15 < o[0].jaccard < 0.55
    j = lambda a, b: spark.range(1).select(fleet.jaccard(F.lit(a).cast("array<string>"), F.lit(b).cast("array<string>"))).first()[0]
    assert j([], []) == 0.0 and j(["1", "2"], ["2", "3"]) == pytest.approx(1 / 3)


def records(spark, rows):
    full = [{"schema": 3, "counter": "c1", "machine": "a", "date": "2026-08-01", "generated_at": "2026-08-02T01:00:00Z", "invocations": 1, "totals": Z, "exact": Z, "estimated": Z, "models": {}, "record_id": i} | r for i, r in enumerate(rows)]
    cols = ["record_id", "schema", "counter", "machine", "date", "generated_at", "invocations", "totals", "exact", "estimated", "models"]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in full], f"record_id long, schema int, counter string, machine string, date string, generated_at string, invocations long, totals {T}, exact {T}, estimated {T}, models map<string,{T}>")


def n(k):
    return Z | {"output_tokens": k}


def test_winners_and_aggregate(spark):
    r = records(spark, [{"totals": n(1), "generated_at": "2026-08-02T01"}, {"totals": n(500), "generated_at": "2026-08-02T09", "exact": n(100), "estimated": n(300)}, {"totals": n(7), "generated_at": "2026-08-02T09"}, {"machine": "b", "totals": n(40), "generated_at": None, "counter": " "}, {"schema": 999}, {"machine": None}])
    w = fleet.winners(fleet.readable(r, 3), "record_id")
    assert sorted((x.machine, x.totals.output_tokens) for x in w.collect()) == [("a", 500), ("b", 40)]
    g = {(x.kind, x.name): (x.records, x.total, x.confidence) for x in fleet.aggregate_long(w).collect()}
    assert g["all", ""] == (2, 540, 0.25) and g["counter", "unstamped"] == (1, 40, 1.0) and g["machine", "a"] == (1, 500, 0.25)
    assert fleet.aggregate_long(r.limit(0)).count() == 0


def test_cohorts(spark):
    many = [{"counter": "old"}] * 4 + [{"counter": "new", "machine": "b", "date": f"2026-08-0{k}"} for k in (2, 3)] + [{"counter": None}] * 9 + [{"counter": "x+dirty"}] * 9
    r = records(spark, many)
    current = lambda *known: [x.counter for x in fleet.cohorts(r, list(known)).collect() if x.current]
    assert current() == ["old"] and current("new") == ["new"]
    assert not any(x.current for x in fleet.cohorts(records(spark, [{"counter": None}])).collect())
    s = {x.machine: (x.records, x.first_date, x.last_date) for x in fleet.stale_ranges(r.filter("counter in ('old', 'new')"), fleet.cohorts(r)).collect()}
    assert s == {"b": (2, "2026-08-02", "2026-08-03")}


def test_anomalies(spark):
    series = lambda xs: spark.createDataFrame([(f"d{i:02}", x) for i, x in enumerate(xs)], "day string, total long")
    spikes = lambda xs: [r.day for r in fleet.anomalies(series(xs)).collect()]
    assert spikes([1000 + k for k in range(14)] + [90_000]) == ["d14"]
    assert spikes([1, 1, 1, 10**9]) == [] and spikes([5] * 9) == [] and spikes([]) == []
    assert spikes([5] * 11 + [500_000]) == ["d11"]


def test_freshness_double_counts_and_summary(spark):
    t = n(100)
    r = records(spark, [{"machine": m, "models": {"x": t, "z": Z}, "totals": t, "exact": t, "generated_at": g} for m, g in (("b", "2026-08-08T10:00:00Z"), ("a", "2026-08-01T00:00:00Z"), ("c", "unknown"))] + [{"machine": "a", "date": "2026-05-01", "totals": n(9)}])
    now = datetime(2026, 8, 8, 12, tzinfo=timezone.utc)
    f = {x.machine: (x.age_hours, x.stale) for x in fleet.freshness(r, F.lit(now)).collect()}
    assert f["b"] == (2.0, False) and f["a"][1] and f["c"] == (None, True)
    assert [(x.model, x.machines, x.machine_a, x.machine_b) for x in fleet.identical_buckets(r).collect()] == [("x", 3, "a", "b")]
    s = views.fleet_summary(r, now, days=30, local="c")
    assert [m["machine"] for m in s.machines] == ["a", "b", "c"] and [m["stale"] for m in s.machines] == [True, False, False] and s.confidence == 1.0
    assert s.busiest_day == ("2026-08-01", 300) and s.machines[0]["total"] == 100
    assert [k for k, _ in views.flags(s, 10)] == ["alert", "alert", "warn"] and views.flags(views.FleetSummary()) == [("ok", "nothing to report")]
    p = views.page(s, "<x>")
    assert "&lt;x&gt;" in p and "http" not in p and 'class="days"' not in p


def test_a_summary_with_rates_goes_by_cost(spark):
    million = lambda out: Z | {"output_tokens": out * 10**6}
    r = records(spark, [{"machine": "boxa", "models": {"m-5": million(1)}, "totals": million(1), "exact": million(1), "invocations": 3}, {"machine": "boxb", "models": {"m-5-high": million(2)}, "totals": million(2), "exact": million(2), "date": "2026-08-02"}, {"machine": "none", "models": None}])
    rate = spark.createDataFrame([("m-5", 10**8, 10 * 10**8, 10**7)], "model string, input long, output long, cached long")
    dated = spark.createDataFrame([("m-5", "2026-08-02", None, 10**8, 5 * 10**8, 10**7)], "model string, first_day string, last_day string, input long, output long, cached long")
    price = lambda by_date: lambda x: fleet.priced(x, rate, dated, (1, 4, 1), by_date=by_date)
    assert {x.machine: float(x.cost) / 1e16 for x in fleet.spend(price(False)(r), "machine").collect()} == {"boxa": 10.0, "boxb": 20.0}
    now = datetime(2026, 8, 3, tzinfo=timezone.utc)
    s = views.fleet_summary(r, now, price=price(True))
    assert [(m["machine"], m["cost"], m["top_model"], m["calls"]) for m in s.machines] == [("boxb", 20.0, "m-5-high", 1), ("boxa", 10.0, "m-5", 3), ("none", 0.0, None, 1)]
    assert s.busiest_day == ("2026-08-02", 20.0) and s.amount == 30.0
    assert views.flags(s, 25)[0] == ("alert", "$30.00 reach the threshold of $25.00") and views.flags(s, 31)[0][0] != "alert"
    p = views.page(s, threshold=25, local="boxa")
    assert "$20.00" in p and 'class="days"' in p and "this machine" in p
    assert views.fleet_token_usage(r, price=price(True)).filter("machine = 'boxb'").first().cost == 20.0
    assert fleet.spend(price(True)(r.limit(0))).first().cost == 0 and fleet.machine_costs(r.limit(0), price(True)(r.limit(0))).count() == 0
    bars = {x.machine: (x.share_of_peak, x.width) for x in fleet.cost_bars(fleet.machine_costs(r, price(True)(r))).collect()}
    assert bars == {"boxb": (1.0, 100.0), "boxa": (0.5, 50.0), "none": (0.0, 0.6)}


def test_flags_as_rows(spark):
    c = spark.createDataFrame([("a", 30), ("b", 12)], "machine string, cost long").withColumn("cost", F.col("cost").cast("decimal(38,0)"))
    f = spark.createDataFrame([("a", False), ("b", True)], "machine string, stale boolean")
    i = spark.createDataFrame([("d", "a", "b"), ("d", "a", "b")], "date string, machine_a string, machine_b string")
    sure = lambda x, y: spark.createDataFrame([(x, y)], "exact long, estimated long")
    got = lambda *a: sorted((r.level, r.flag, r.subject, r.value) for r in fleet.flags(*a).collect())
    assert got(c, f, i, sure(1, 3), 42) == [("alert", "counted twice", "d a b", 2.0), ("alert", "spend", "", 42 / 1e16), ("note", "estimated share", "", 0.25), ("warn", "stale machines", "", 1.0)]
    assert got(c, f.filter("not stale"), i.limit(0), sure(0, 0), 43) == [("ok", "nothing to report", "", 0.0)] == got(c, f.limit(0), i.limit(0), sure(None, None))


def test_audits_stamps_and_labels(spark, tmp_path):
    from ledgerline.operators import audit

    d = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "m string, v int")
    assert {r.m: (r.n, r.there, r.score) for r in audit.scores(d, ["m"], {"there": F.col("v").isNotNull()}).collect()} == {"a": (2, 1, 0), "b": (1, 1, 1)}
    for k, text in enumerate(['{"servers": {"x": {"p": 1}, "y": 2}}', "broken", '{"servers": {"y": 3}}', '{"servers": 5}']):
        (tmp_path / f"{k}.json").write_text(text)
    got = audit.merged_maps(spark, [str(tmp_path / f"{k}.json") for k in (0, 1, 2, 3, 9)], "servers")
    assert {r.name: r.value for r in got.collect()} == {"x": '{"p":1}', "y": "3"}
    audit.log(d, str(tmp_path / "log"))
    audit.log(d, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6

    def one(x):
        """Says one thing."""
        return x + 1  # and that

    def same(x):
        return x + 1

    def other(x):
        return x + 2

    same.__name__ = "one"
    assert len(audit.counter_stamp(one)) == 12 and audit.counter_stamp(one, dirty=True) == audit.counter_stamp(one) + "+dirty" and audit.counter_stamp(one) != audit.counter_stamp(other)
    assert views.thinned([str(k) for k in range(20)]) == [str(k) if k % 3 == 0 or k == 19 else "" for k in range(20)] and views.thinned([]) == []


def test_digests_of_published_sketches_and_batches_of_texts(spark):
    from hashlib import blake2b

    d = spark.createDataFrame([("2026-08-01", None, 5)], "t string, m string, n long")
    want = blake2b("2026-08-01\x1fNone\x1f5".encode(), digest_size=8).hexdigest()
    assert d.select(fleet.published_fingerprint(F.col("t"), F.col("m"), F.col("n"))).first()[0] == want

    def counts(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad")
        return [len(t) for t in texts]

    t = spark.createDataFrame([("ab",), ("bad",), (None,), ("",), ("abcd",)], "t string")
    r = textstats.length_stats(t, "t", counter=textstats.batch_counter(counts, 2)).first()
    assert (r.docs, r.nulls, r.tokens) == (5, 1, 6)


def test_classes_nest_and_fall_back_to_rates(spark):
    b = spark.createDataFrame([("X-Pro-mini", 5, 1, 10, 1), ("x-zzz", 5, 2, 20, 2), ("q", 300, 3, 30, 3), ("free", 0, 4, 40, 4)], "model string, input long, calls long, total long, cost long").withColumn("cost", F.col("cost").cast("decimal(38,0)"))
    rules = (("x", (("mini", "small"), ("max", "big"))), ("never", "none"))
    got = {r.bucket: (r.calls, r.total, int(r.cost)) for r in reports.class_costs(b, rules, ((100, "dear"), (1, "cheap"))).collect()}
    assert got == {"small": (1, 10, 1), "big": (0, 0, 0), "none": (0, 0, 0), "dear": (3, 30, 3), "cheap": (2, 20, 2), "other": (4, 40, 4)}


def test_text_report_and_tools(spark):
    l = reports.normalized(calls(spark, [{"input_tokens": 5, "timestamp": at(2)}, {"input_tokens": 7, "source": "Fleet:X", "timestamp": at(1)}]))
    text = views.text_report(l)
    assert "TOTAL" in text and "BY MODEL" in text and "Fleet" not in text
    assert "LARGEST CALLS" in text and "CACHE HEALTH" in text and "BILL" not in text and "CROSS CHECK" not in text
    rate = spark.createDataFrame([("m", 10**8, 10**9, 10**7)], "model string, input long, output long, cached long")
    none = spark.createDataFrame([], "model string, first_day string, last_day string, input long, output long, cached long")
    price = lambda sums: rates.billed(sums.drop("day").withColumn("day", F.lit("")), rates.resolved(sums.select("model", "day"), rate, none, (1, 1, 1)).withColumn("day", F.lit("")))
    native = spark.createDataFrame([(2, 24)], "threads long, tokens long")
    text = views.text_report(l, price, [("m", "all of m")], native)
    assert "BILL" in text and "all of m" in text and "WITHOUT CACHES" in text and "CROSS CHECK" in text
    assert views.my_token_usage(l, "box", at(2), 1).count() == 2 and views.machine_token_usage(l, at(3), 1).first().total == 5
    for bad in (0, 3651, True, "7"):
        with pytest.raises(ValueError):
            views.machine_token_usage(l, at(3), bad)


def test_ordered_winners_and_split(spark):
    df = spark.createDataFrame([(1, "k"), (2, "k"), (3, None), (4, None), (5, "j"), (6, "k")], "o long, k string")
    assert sorted(r.o for r in ordered.first_wins(df, F.col("k"), "o").collect()) == [1, 3, 4, 5]
    assert sorted((r.o, r.first_order) for r in ordered.last_wins(df, F.col("k"), "o").collect()) == [(5, 5), (6, 1)]
    s = spark.createDataFrame([(28, 24), (10, 99), (5, 0), (7, 7)], "o long, t long").select(ordered.split_thinking(F.col("o"), F.col("t")).alias("s"))
    assert [tuple(r.s) for r in s.collect()] == [(4, 24), (10, 0), (5, 0), (0, 7)]


def test_length_stats(spark):
    d = spark.createDataFrame([("a b c",), ("",), (None,), ("x",)], "t string")
    r = textstats.length_stats(d, "t").first()
    assert (r.docs, r.nulls, r.empties, r.tokens, r["mean"], r["median"]) == (4, 1, 2, 4, 1.0, 0.5)
    assert textstats.length_stats(d.limit(1), "t").first().stddev is None and textstats.length_stats(d.limit(0), "t").first().docs == 0


def test_states_of_lengths_unite(spark):
    d = spark.createDataFrame([(" ".join("x" * (k % 23)),) for k in range(200)] + [(None,), ("",)], "t string")
    halves = textstats.length_state(d.limit(90), "t").unionByName(textstats.length_state(d.exceptAll(d.limit(90)), "t"))
    assert textstats.finished(halves).first() == textstats.length_stats(d, "t").first()
    assert textstats.finished(textstats.length_state(d.limit(0), "t")).first().docs == 0
    assert "median" in textstats.distribution_report(textstats.length_stats(d, "t"), "T") and "stddev" not in textstats.distribution_report(textstats.length_stats(d.limit(1), "t"), "T")


def test_kept_text_has_an_age():
    clock, made = [0.0], []
    k = views.Kept(lambda: made.append(1) or f"t{len(made)}", 10, lambda: clock[0])
    assert k.get() == ("t1", 0.0)
    clock[0] = 9.0
    assert k.get() == ("t1", 9.0)
    clock[0] = 11.0
    assert k.get() == ("t2", 0.0)


def test_windows():
    now = datetime(2026, 8, 15, tzinfo=timezone.utc)
    d = lambda *a: datetime(*a, tzinfo=timezone.utc)
    w = windows.resolve
    assert w(now) == (d(2026, 8, 8), None) and w(now, days=3, weeks=9)[0] == d(2026, 8, 12) and w(now, weeks=1)[0] == d(2026, 8, 8)
    assert w(now, start="2026-08-01", end="2026-08-02", month="2026-01") == (d(2026, 8, 1), d(2026, 8, 3))
    assert w(now, month="2025-12", cutoff="2020-01-01") == (d(2025, 12, 1), d(2026, 1, 1))
    assert w(now, cutoff="2026-08-15T17:00") == (d(2026, 8, 15, 17), None) and w(now, compare=30)[0] == d(2026, 6, 16)
    assert (now - w(now, history=True)[0]).days == 760
    with pytest.raises(ValueError):
        w(now, month="2026-13")


def test_numbers(spark):
    df = spark.createDataFrame([(5,), (1234,), (12_340_000,), (1_230_000_000,)], "n long")
    assert [r[0] for r in df.select(humanized(F.col("n"))).collect()] == ["5", "1.2K", "12.34M", "1.23B"] == [human(x) for x in (5, 1234, 12_340_000, 1_230_000_000)]


def test_estimators_cover_the_whole_table(spark):
    from ledgerline.plans import usage

    folder = "/root/testdata/sf0.001"
    calls = usage._steps(spark, folder).filter("role = 'assistant'").count()
    assert calls > usage.QUERIES["q_planner_estimator"](spark, folder).count()
    for name in ("q_planner_estimator_whole", "q_session_estimator_whole"):
        assert usage.QUERIES[name](spark, folder).count() == calls


def test_the_bench_times_every_query(monkeypatch, capsys):
    import json
    from unittest.mock import MagicMock

    import bench

    names = ["q_day_totals", "p4_table", "p8_sources", "q_daily_roundtrip"]
    monkeypatch.setattr(bench, "build", MagicMock())
    monkeypatch.setattr(bench, "sweep", MagicMock())
    monkeypatch.setattr(bench.entry, "queries", lambda: {n: MagicMock() for n in names})
    bench.main([])
    assert set(json.loads(capsys.readouterr().out)["queries"]) == set(names)


def test_inputs_of_few_splits_are_spread_and_others_left(spark, tmp_path):
    from ledgerline.session import cut, spread

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.range(1000).repartition(6).write.parquet(str(tmp_path / "six"))
        six = spark.read.parquet(str(tmp_path / "six"))
        assert "Exchange" in spread(six, 7)._jdf.queryExecution().executedPlan().toString() and "Exchange" not in spread(six, 6)._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # read in any unit
        six = spark.range(100_000).repartition(1)
        six.write.parquet(str(tmp_path / "one"))
        six = spark.read.parquet(str(tmp_path / "one"))
        assert "Exchange" not in spread(six, 7)._jdf.queryExecution().executedPlan().toString()
        assert cut(six.filter("id < 0")).schema == six.schema
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_printed_report_is_read_back():
    from ledgerline.functions.formats import parsed_tables, text_table

    rows = [("box one", 16_654, None, True), ("b", 10_888_376_074, "x  y", False), ("", 1, "z", None)]
    text = "\n\n".join(["FIRST\n" + text_table(["machine", "n", "what", "ok"], rows), "a remark alone", "NONE\n" + text_table(["a", "b"], [])])
    got = parsed_tables(text)
    assert list(got) == ["FIRST", "NONE"] and got["NONE"] == []
    assert [list(r.values()) for r in got["FIRST"]] == [["box one", "16,654", "", "True"], ["b", "10,888,376,074", "x  y", "False"], ["", "1", "z", ""]]

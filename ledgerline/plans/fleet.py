"""Queries over the daily records of many machines, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, times
from ..operators import audit, fleet, rates, reports
from ..schema import SCHEMA_VERSION, TOKEN_FIELDS
from ..session import fresh_folder, table
from ..sources import dailies
from . import usage
from .problems import stamp_sql
from .usage import L, ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_SUMS = ", ".join(f"CAST(sum({f}) AS BIGINT) AS {f}" for f in TOKEN_FIELDS)
_LONG = f"""raw AS (SELECT machine, strftime("timestamp" AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, coalesce(source, 'unknown') AS source, coalesce(model, 'unknown') AS model, coalesce(exact, false) AS exact, fingerprint,
 {", ".join(f"coalesce({f}, 0) AS {f}" for f in TOKEN_FIELDS)} FROM invocations WHERE "timestamp" IS NOT NULL),
 long AS (SELECT machine, day, 'source' AS kind, source AS name, count(*) AS calls, {_SUMS} FROM raw GROUP BY ALL UNION ALL SELECT machine, day, 'model', model, count(*), {_SUMS} FROM raw GROUP BY ALL
 UNION ALL SELECT machine, day, 'certainty', CASE WHEN exact THEN 'exact' ELSE 'estimated' END, count(*), {_SUMS} FROM raw GROUP BY ALL)"""


@query(f"WITH {_LONG} SELECT * FROM long")
def q_rollup_daily(spark, folder):
    return fleet.rollup_long(table(spark, folder, "invocations"))


def _flat(r: DataFrame) -> DataFrame:
    """A nested record as scalar columns that can be compared."""
    total = lambda c: sum((F.coalesce(F.col(f"{c}.{f}"), F.lit(0)) for f in TOKEN_FIELDS), F.lit(0).cast("long"))
    return r.select(
        "machine", "day", "invocations", total("totals").alias("total"), total("exact").alias("exact_total"), total("estimated").alias("estimated_total"),
        F.array_join(F.array_sort(F.map_keys("sources")), "|").alias("source_names"), F.array_join(F.array_sort(F.map_keys("models")), "|").alias("model_names"),
        F.size("sketch").cast("long").alias("sketch_size"), F.array_join("sketch", ",").alias("sketch"),
    )


_FLAT = f"""WITH {_LONG}, t AS (SELECT machine, day, count(*) AS invocations, CAST(sum({" + ".join(TOKEN_FIELDS)}) AS BIGINT) AS total, CAST(coalesce(sum({" + ".join(TOKEN_FIELDS)}) FILTER (exact), 0) AS BIGINT) AS exact_total,
 CAST(coalesce(sum({" + ".join(TOKEN_FIELDS)}) FILTER (NOT exact), 0) AS BIGINT) AS estimated_total, array_to_string(list_sort(list(DISTINCT source)), '|') AS source_names, array_to_string(list_sort(list(DISTINCT model)), '|') AS model_names,
 list_slice(list_sort(list(DISTINCT fingerprint)), 1, 64) AS sk FROM raw GROUP BY 1, 2)
SELECT machine, day, invocations, total, exact_total, estimated_total, source_names, model_names, len(sk) AS sketch_size, array_to_string(sk, ',') AS sketch FROM t"""


@query(_FLAT)
def q_daily_records(spark, folder):
    return _flat(fleet.daily_records(table(spark, folder, "invocations")))


@query(_FLAT)
def q_daily_roundtrip(spark, folder):
    """Records exported as files by machine and date, and read back."""
    out = fresh_folder(spark, "dailies-export")
    records = fleet.daily_records(table(spark, folder, "invocations"))
    dailies.export(records, out, counter="v1")
    back = dailies.load(spark, out)
    return _flat(back.withColumnRenamed("date", "day"))


@query("""SELECT machine, date, record_id FROM dailies WHERE schema = 3 AND machine IS NOT NULL AND date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY machine, date ORDER BY coalesce(generated_at, '') DESC, record_id) = 1""")
def q_winners(spark, folder):
    return _winners(spark, folder).select("machine", "date", "record_id")


def _readable(spark, folder) -> DataFrame:
    return fleet.readable(table(spark, folder, "dailies"), SCHEMA_VERSION)


def _winners(spark, folder) -> DataFrame:
    return fleet.winners(_readable(spark, folder), "record_id")


_READ = "r AS (SELECT * FROM dailies WHERE schema = 3 AND machine IS NOT NULL AND date IS NOT NULL)"
_W = f"{_READ}, w AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY machine, date ORDER BY coalesce(generated_at, '') DESC, record_id) = 1)"
_COUNTER = r"coalesce(nullif(regexp_replace(counter, '^\s+|\s+$', '', 'g'), ''), 'unstamped')"
_TOTAL = lambda c: "(" + " + ".join(f"coalesce({c}.{f}, 0)" for f in TOKEN_FIELDS) + ")"


@query(f"""WITH {_W}, x AS (SELECT machine, date, {_COUNTER} AS counter, coalesce(invocations, 0) AS invocations, {_TOTAL("totals")} AS total, {_TOTAL("exact")} AS exact, {_TOTAL("estimated")} AS estimated FROM w),
 k AS (SELECT unnest(['machine', 'date', 'counter', 'all']) AS kind, unnest([machine, date, counter, '']) AS name, * FROM x)
SELECT kind, name, count(*) AS records, CAST(sum(invocations) AS BIGINT) AS invocations, CAST(sum(total) AS BIGINT) AS total, CAST(sum(exact) AS BIGINT) AS exact, CAST(sum(estimated) AS BIGINT) AS estimated,
 round(coalesce(sum(exact) / nullif(sum(exact) + sum(estimated), 0), 1.0), 6) AS confidence FROM k GROUP BY 1, 2""")
def q_fleet_aggregate(spark, folder):
    return fleet.aggregate_long(_winners(spark, folder))


def _map_sql(column: str) -> str:
    return f"""WITH {_W}, e AS (SELECT unnest(map_entries({column})) AS e FROM w) SELECT e.key AS name, count(*) AS records, {", ".join(f"CAST(coalesce(sum(e.value.{f}), 0) AS BIGINT) AS {f}" for f in TOKEN_FIELDS)} FROM e GROUP BY 1"""


@query(_map_sql("sources"))
def q_fleet_sources(spark, folder):
    return fleet.map_breakdown(_winners(spark, folder), "sources")


@query(_map_sql("models"))
def q_fleet_models(spark, folder):
    return fleet.map_breakdown(_winners(spark, folder), "models")


@query(f"WITH {_W} SELECT machine, date FROM w WHERE coalesce(partial, false)")
def q_partial_days(spark, folder):
    return _winners(spark, folder).filter(F.coalesce("partial", F.lit(False))).select("machine", "date")


_COHORTS = f"""{_W}, c AS (SELECT {_COUNTER} AS counter, count(*) AS records, max(coalesce(generated_at, '')) AS newest FROM w GROUP BY 1),
 b AS (SELECT counter AS best FROM c WHERE counter <> 'unstamped' AND NOT ends_with(counter, '+dirty') ORDER BY records DESC, newest DESC, counter DESC LIMIT 1)"""


@query(f"WITH {_COHORTS} SELECT counter, records, newest, coalesce(counter = best, false) AS current, coalesce(counter <> best, true) AS stale FROM c LEFT JOIN b ON true")
def q_cohorts(spark, folder):
    return fleet.cohorts(_winners(spark, folder))


@query(f"WITH {_COHORTS} SELECT machine, count(*) AS records, min(date) AS first_date, max(date) AS last_date FROM w WHERE {_COUNTER} NOT IN (SELECT best FROM b) GROUP BY 1")
def q_stale_range(spark, folder):
    w = _winners(spark, folder)
    return fleet.stale_ranges(w, fleet.cohorts(w))


@query(f"""WITH f AS (SELECT trim(regexp_replace(lower(machine), '[^a-z0-9]+', '-', 'g'), '-') AS machine, max({stamp_sql("generated_at")}) AS seen FROM dailies GROUP BY 1)
SELECT machine, epoch_us(seen) AS last_seen, round((epoch_us(TIMESTAMP '2026-01-30 00:00:00') - epoch_us(seen)) / 3.6e9, 4) AS age_hours, coalesce((epoch_us(TIMESTAMP '2026-01-30 00:00:00') - epoch_us(seen)) / 3.6e9 > 48, true) AS stale FROM f""")
def q_freshness(spark, folder):
    d = table(spark, folder, "dailies").withColumn("machine", names.slug(F.col("machine")))
    return fleet.freshness(d, F.lit("2026-01-30T00:00:00Z").cast("timestamp"))


@query(f"""WITH {_READ}, e AS (SELECT machine, date, unnest(map_entries(models)) AS e FROM r), f AS (SELECT DISTINCT machine, date, e.key AS model, {", ".join(f"coalesce(e.value.{f}, 0) AS {f}" for f in TOKEN_FIELDS)} FROM e)
SELECT date, model, {", ".join(TOKEN_FIELDS)}, count(*) AS machines, min(machine) AS machine_a, list_sort(list(machine))[2] AS machine_b FROM f WHERE {" OR ".join(f"{f} <> 0" for f in TOKEN_FIELDS)} GROUP BY ALL HAVING count(*) > 1""")
def q_identical_buckets(spark, folder):
    return fleet.identical_buckets(_readable(spark, folder))


def _sketches(spark, folder) -> DataFrame:
    return fleet.bottom_k(ledger(spark, folder), ["day", "machine"], "fingerprint")


_SK = f"{L}, s AS (SELECT day, machine, list_slice(list_sort(list(DISTINCT fingerprint)), 1, 64) AS sk FROM l GROUP BY 1, 2)"


@query(f"WITH {_SK} SELECT day, machine, array_to_string(sk, ',') AS sketch FROM s")
def q_minhash(spark, folder):
    return _sketches(spark, folder).select("day", "machine", F.array_join("sketch", ",").alias("sketch"))


@query(f"""WITH {_SK}, p AS (SELECT a.day, a.machine AS machine_a, b.machine AS machine_b, a.sk AS x, b.sk AS y, list_slice(list_sort(list_distinct(list_concat(a.sk, b.sk))), 1, 64) AS u FROM s a JOIN s b ON a.day = b.day AND a.machine < b.machine)
SELECT day, machine_a, machine_b, round(len(list_intersect(list_intersect(x, y), u)) / len(u), 6) AS jaccard FROM p WHERE len(list_intersect(list_intersect(x, y), u)) / len(u) >= 0.05""")
def q_jaccard_overlaps(spark, folder):
    return fleet.overlaps(_sketches(spark, folder), 0.05).withColumn("jaccard", F.round("jaccard", 6))


@query("""WITH d AS (SELECT strftime(o_orderdate, '%Y-%m') AS day, sum(CAST(floor(o_totalprice) AS BIGINT)) AS total FROM orders GROUP BY 1), x AS (SELECT *, log10(total + 1.0) AS x FROM d), m AS (SELECT *, (SELECT median(x) FROM x) AS m FROM x),
 s AS (SELECT median(abs(x - m)) AS mad, avg(abs(x - m)) AS aad FROM m), z AS (SELECT day, total, m, (x - m) / CASE WHEN mad > 0 THEN mad / 0.6745 ELSE aad / 0.7979 END AS z FROM m, s)
SELECT day, CAST(total AS BIGINT) AS total, round_even(z, 1) AS z, round_even(total / (pow(10, m) - 1), 2) AS ratio FROM z WHERE abs(z) >= 3.5""")
def q_anomalies(spark, folder):
    """Months of orders against the typical month: the last, unfinished one stands out."""
    m = table(spark, folder, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("day")).agg(F.sum(F.floor("o_totalprice").cast("long")).alias("total"))
    return fleet.anomalies(m)


# ---- costs: tokens of the winning records at made-up rates


def _spelled(spark, folder) -> DataFrame:
    """Winning records with one spelling of machine and date."""
    d = table(spark, folder, "dailies").filter(F.col("schema") == SCHEMA_VERSION)
    return fleet.winners(d.withColumns({"machine": names.slug(F.col("machine")), "date": times.loose_date(F.col("date")).cast("string")}).filter("date is not null"), "record_id")


def _priced(records: DataFrame, by_date: bool) -> DataFrame:
    return fleet.priced(records, *usage._rates(records.sparkSession), usage.DEFAULT, usage._free(), by_date)


_SPELLED = """s AS (SELECT * REPLACE (coalesce(nullif(trim(regexp_replace(lower(coalesce(machine, '')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown-machine') AS machine, strftime(try_strptime(replace(replace(trim(date), '-', ''), '/', ''), '%Y%m%d'), '%Y-%m-%d') AS date) FROM dailies WHERE schema = 3),
 w AS (SELECT * FROM s WHERE date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY machine, date ORDER BY coalesce(generated_at, '') DESC, record_id) = 1)"""
_MODEL_DAYS = f"""{_SPELLED}, e AS (SELECT machine, date AS day, unnest(map_entries(models)) AS e FROM w),
 sums AS (SELECT machine, day, e.key AS model, {", ".join(f"coalesce(e.value.{f}, 0) AS {f}" for f in TOKEN_FIELDS)}, {" + ".join(f"coalesce(e.value.{f}, 0)" for f in TOKEN_FIELDS)} AS total FROM e WHERE e.value IS NOT NULL)"""
_FLAT_BILL = f"{_MODEL_DAYS}, {usage.rated_sql(False)}"
_DATED_BILL = f"{_MODEL_DAYS}, {usage.rated_sql(True)}"
_SPEND = "CAST(sum(total) AS BIGINT) AS total, CAST(sum(cache_read) AS BIGINT) AS cache_read, round(CAST(sum(cost) AS DOUBLE) / 1e16, 10) AS cost"


@query(f"WITH {_FLAT_BILL} SELECT machine, {_SPEND} FROM bill GROUP BY 1")
def q_spend_machines(spark, folder):
    """Spend by machine at undated rates."""
    return fleet.spend(_priced(_spelled(spark, folder), False), "machine").withColumn("cost", F.round(rates.money(F.col("cost")), 10))


@query(f"WITH {_FLAT_BILL} SELECT model, {_SPEND} FROM bill GROUP BY 1")
def q_spend_models(spark, folder):
    """Spend by model at undated rates."""
    return fleet.spend(_priced(_spelled(spark, folder), False), "model").withColumn("cost", F.round(rates.money(F.col("cost")), 10))


@query(f"WITH {_DATED_BILL} SELECT day, model, {_SPEND} FROM bill GROUP BY 1, 2")
def q_spend_model_days(spark, folder):
    """Spend by day and model, each day at the rate in force then."""
    return fleet.spend(_priced(_spelled(spark, folder), True), "day", "model").withColumn("cost", F.round(rates.money(F.col("cost")), 10))


_MACHINE_COSTS = f"""{_DATED_BILL}, c AS (SELECT machine, count(DISTINCT date) AS days, CAST(coalesce(sum(invocations), 0) AS BIGINT) AS calls FROM w GROUP BY 1),
 m AS (SELECT machine, model, sum(total) AS total, sum(cache_read) AS cache_read, sum(cost) AS cost FROM bill GROUP BY 1, 2),
 b AS (SELECT machine, sum(total) AS total, sum(cache_read) AS cache_read, sum(cost) AS cost FROM m GROUP BY 1), top AS (SELECT machine, model AS top_model FROM m QUALIFY row_number() OVER (PARTITION BY machine ORDER BY cost DESC, model DESC) = 1),
 costs AS (SELECT c.machine, days, calls, CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(cache_read, 0) AS BIGINT) AS cache_read, coalesce(cost, 0) AS cost, top_model FROM c LEFT JOIN b ON b.machine = c.machine LEFT JOIN top ON top.machine = c.machine)"""


@query(f"WITH {_MACHINE_COSTS} SELECT * REPLACE (round(CAST(cost AS DOUBLE) / 1e16, 10) AS cost) FROM costs")
def q_machine_costs(spark, folder):
    """What each machine cost, with its dearest model."""
    w = _spelled(spark, folder)
    return fleet.machine_costs(w, _priced(w, True)).withColumn("cost", F.round(rates.money(F.col("cost")), 10))


@query(f"WITH {_MACHINE_COSTS} SELECT machine, round(CAST(cost AS DOUBLE) / 1e16, 10) AS cost, round(coalesce(CAST(cost AS DOUBLE) / nullif(CAST(max(cost) OVER () AS DOUBLE), 0), 0), 6) AS share_of_peak, round(greatest(0.6, coalesce(CAST(cost AS DOUBLE) / nullif(CAST(max(cost) OVER () AS DOUBLE), 0), 0) * 100), 4) AS width FROM costs")
def q_cost_bars(spark, folder):
    w = _spelled(spark, folder)
    return fleet.cost_bars(fleet.machine_costs(w, _priced(w, True))).select("machine", F.round(rates.money(F.col("cost")), 10).alias("cost"), F.round("share_of_peak", 6).alias("share_of_peak"), F.round("width", 4).alias("width"))


@query(f"""WITH {_DATED_BILL}, d AS (SELECT machine, day, sum(cost) AS cost FROM bill GROUP BY 1, 2), t AS (SELECT unnest(generate_series(min(CAST(day AS DATE)), max(CAST(day AS DATE)), INTERVAL 1 DAY)) AS t FROM d)
SELECT m.machine, strftime(t, '%Y-%m-%d') AS day, round(CAST(coalesce(d.cost, 0) AS DOUBLE) / 1e16, 10) AS cost FROM (SELECT DISTINCT machine FROM d) m CROSS JOIN t LEFT JOIN d ON d.machine = m.machine AND d.day = strftime(t, '%Y-%m-%d')""")
def q_machine_day_costs(spark, folder):
    """The matrix of machines and days, days without a record included."""
    d = fleet.spend(_priced(_spelled(spark, folder), True), "machine", "day").select("machine", "day", F.col("cost").cast("decimal(38,0)").alias("cost"))
    return reports.spine(d, "machine", "day", "cost").select("machine", "day", F.round(rates.money(F.col("cost")), 10).alias("cost"))


@query(f"""WITH {_DATED_BILL}, d AS (SELECT day, sum(cost) AS cost FROM bill GROUP BY 1), sh AS (SELECT sum(cache_read) / sum(total) AS share FROM bill)
SELECT day, round(CAST(cost AS DOUBLE) / 1e16, 10) AS cost, round(share, 6) AS cache_share FROM d, sh ORDER BY cost DESC, day LIMIT 1""")
def q_busiest_day(spark, folder):
    """The dearest day (the earliest of equals) and the share of tokens read from caches."""
    p = _priced(_spelled(spark, folder), True)
    best = fleet.spend(p, "day").agg(F.max_by(F.struct("day", "cost"), F.struct("cost", -F.unix_date(F.col("day").cast("date")))).alias("b"))
    share = fleet.spend(p).select(F.try_divide("cache_read", "total").alias("share"))
    return best.join(F.broadcast(share), F.lit(True)).filter("b is not null").select("b.day", F.round(rates.money(F.col("b.cost")), 10).alias("cost"), F.round("share", 6).alias("cache_share"))


@query(f"""WITH {_MACHINE_COSTS}, f AS (SELECT machine, max({stamp_sql("generated_at")}) AS seen FROM w GROUP BY 1), st AS (SELECT count(*) AS n FROM f WHERE coalesce((epoch_us(TIMESTAMP '2026-01-30 00:00:00') - epoch_us(seen)) / 3.6e9 > 48, true)),
 x AS (SELECT DISTINCT machine, day, model, {", ".join(TOKEN_FIELDS)} FROM sums WHERE {" OR ".join(f"{f} <> 0" for f in TOKEN_FIELDS)}), g AS (SELECT day, model, min(machine) AS a, list_sort(list(machine))[2] AS b FROM x GROUP BY day, model, {", ".join(TOKEN_FIELDS)} HAVING count(*) > 1),
 cf AS (SELECT sum({_TOTAL("exact")}) AS ex, sum({_TOTAL("estimated")}) AS es FROM w),
 found AS (SELECT 'alert' AS level, 'spend' AS flag, '' AS subject, round(CAST(sum(cost) AS DOUBLE) / 1e16, 10) AS value FROM costs HAVING sum(cost) >= 1000000000000000
 UNION ALL SELECT 'alert', 'counted twice', day || ' ' || a || ' ' || b, CAST(count(*) AS DOUBLE) FROM g GROUP BY day, a, b
 UNION ALL SELECT 'warn', 'stale machines', '', CAST(n AS DOUBLE) FROM st WHERE n > 0 UNION ALL SELECT 'note', 'estimated share', '', round(ex / (ex + es), 6) FROM cf WHERE ex / nullif(ex + es, 0) < 0.999)
SELECT * FROM found UNION ALL SELECT 'ok', 'nothing to report', '', 0.0 WHERE (SELECT count(*) FROM found) = 0""")
def q_flags(spark, folder):
    """What a page of the fleet warns of."""
    w = _spelled(spark, folder)
    s = lambda c: sum((F.coalesce(F.col(f"{c}.{f}"), F.lit(0)) for f in TOKEN_FIELDS), F.lit(0).cast("long"))
    measured = w.agg(F.sum(s("exact")).alias("exact"), F.sum(s("estimated")).alias("estimated"))
    return fleet.flags(fleet.machine_costs(w, _priced(w, True)), fleet.freshness(w, F.lit("2026-01-30T00:00:00Z").cast("timestamp")), fleet.identical_buckets(w), measured, 10**15).withColumn("value", F.round("value", 10))


@query(f"""WITH {_SK}, p AS (SELECT a.day, a.machine AS machine_a, b.machine AS machine_b, a.sk AS x, b.sk AS y, list_slice(list_sort(list_distinct(list_concat(a.sk, b.sk))), 1, 64) AS u FROM s a JOIN s b ON a.day = b.day AND a.machine < b.machine)
SELECT day, machine_a, machine_b, round(len(list_intersect(list_intersect(x, y), u)) / len(u), 6) AS jaccard FROM p WHERE len(list_intersect(list_intersect(x, y), u)) / len(u) >= 0.05 ORDER BY len(list_intersect(list_intersect(x, y), u)) / len(u) DESC, day, machine_a, machine_b LIMIT 5""")
def q_top_overlaps(spark, folder):
    """The five pairs of machines and days most alike."""
    return fleet.overlaps(_sketches(spark, folder), 0.05, top=5).withColumn("jaccard", F.round("jaccard", 6))


_PEAK = f"{_W}, c AS (SELECT machine, CAST(sum({_TOTAL('totals')}) AS BIGINT) AS total FROM w GROUP BY 1)"


@query(f"WITH {_PEAK} SELECT machine, total, round(total / max(total) OVER (), 6) AS share_of_peak, CAST(dense_rank() OVER (ORDER BY machine) AS INTEGER) AS slot FROM c")
def q_machine_bars(spark, folder):
    """Machines against the busiest one, with a stable slot by name."""
    from pyspark.sql import Window

    t = sum((F.coalesce(F.col(f"totals.{f}"), F.lit(0)) for f in TOKEN_FIELDS), F.lit(0).cast("long"))
    c = _winners(spark, folder).groupBy("machine").agg(F.sum(t).alias("total"))
    peak = c.agg(F.max("total").alias("peak"))
    # the windows run over machines, one row each
    j = c.join(F.broadcast(peak), F.lit(True))
    return j.select("machine", "total", F.round(F.col("total") / F.col("peak"), 6).alias("share_of_peak"), F.dense_rank().over(Window.orderBy("machine")).alias("slot"))


@query(f"""WITH p AS (SELECT CAST({stamp_sql('"timestamp"')} AS DATE) AS d, coalesce(nullif(lower(trim(provider)), ''), 'fleet') AS provider,
 greatest(coalesce(input_tokens, 0), 0) + greatest(coalesce(output_tokens, 0), 0) AS tokens FROM fleet_usage)
SELECT strftime(d, '%Y-%m-%d') AS day, provider, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM p WHERE d IS NOT NULL GROUP BY 1, 2""")
def q_stream_daily(spark, folder):
    """The ledger as a file stream: every row counts; summed by day, upserted batch by batch."""
    from ..streaming import daily

    return daily.replay(spark, f"{folder}/fleet_usage.parquet")


@query(r"""WITH t AS (SELECT nullif(regexp_replace(requestId, '^\s+|\s+$', '', 'g'), '') AS r FROM transcripts)
SELECT r IS NOT NULL AS has_id, CASE WHEN count(r) = 0 THEN count(*) ELSE count(DISTINCT r) END AS rows, count(DISTINCT r) AS ids FROM t GROUP BY r IS NOT NULL""")
def q_stream_messages(spark, folder):
    """The transcripts as a file stream: the first delivery of each request is passed on, rows without an id all are."""
    from ..functions.times import filled
    from ..streaming import messages

    m = messages.replay(spark, f"{folder}/transcripts.parquet", F.col("requestId")).withColumn("r", filled(F.col("requestId")))
    return m.groupBy(F.col("r").isNotNull().alias("has_id")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("r").alias("ids"))


# ---- checks of the records


_CHECKS = """CASE WHEN schema IS NULL OR schema <> 3 THEN 'other version' WHEN machine IS NULL OR trim(machine) = '' OR date IS NULL OR trim(date) = '' THEN 'no machine or date' WHEN totals IS NULL THEN 'no totals'
 WHEN partial THEN 'partial' ELSE 'ok' END"""


@query(f"SELECT {_CHECKS} AS verdict, count(*) AS n FROM dailies GROUP BY 1")
def q_verdicts(spark, folder):
    """How many records each verdict holds."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    v = F.when(F.coalesce(F.col("schema") != SCHEMA_VERSION, F.lit(True)), "other version").when(blank("machine") | blank("date"), "no machine or date").when(F.col("totals").isNull(), "no totals").when(F.col("partial"), "partial").otherwise("ok")
    return audit.verdicts(table(spark, folder, "dailies").select(v.alias("verdict")))


@query("SELECT machine, count(*) AS n, count(*) FILTER (coalesce(schema = 3, false)) AS version, count(*) FILTER (sketch IS NOT NULL) AS sketched, count(*) FILTER (coalesce(NOT partial, false)) AS complete FROM dailies GROUP BY machine")
def q_audit(spark, folder):
    """Of each machine, how many records pass each check."""
    return audit.scores(table(spark, folder, "dailies"), ["machine"], {"version": F.col("schema") == SCHEMA_VERSION, "sketched": F.col("sketch").isNotNull(), "complete": ~F.col("partial")}).drop("score")

"""Queries over the invocation ledger, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, times
from ..operators import ordered, rates, reports, textstats
from ..schema import TOKEN_FIELDS
from ..session import literal, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    return reports.normalized(table(spark, folder, "invocations"))


TOKENS = " + ".join(f"coalesce({f}, 0)" for f in TOKEN_FIELDS)
L = f"""l AS (SELECT machine, "timestamp" AT TIME ZONE 'UTC' AS ts, source, coalesce(model, 'unknown') AS model, {", ".join(f"coalesce({f}, 0) AS {f}" for f in TOKEN_FIELDS)},
 coalesce(exact, true) AS exact, session_id, source_file, fingerprint, strftime("timestamp" AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, {TOKENS} AS total FROM invocations WHERE "timestamp" IS NOT NULL)"""
SUMS = ", ".join(f"CAST(sum({f}) AS BIGINT) AS {f}" for f in (*TOKEN_FIELDS, "total"))


# ---- breakdowns


@query(f"WITH {L} SELECT day, count(*) AS calls, {SUMS} FROM l GROUP BY 1")
def q_day_totals(spark, folder):
    return reports.breakdown(ledger(spark, folder), "day")


@query(f"WITH {L} SELECT model, count(*) AS calls, {SUMS} FROM l GROUP BY 1")
def q_model_breakdown(spark, folder):
    return reports.breakdown(ledger(spark, folder), "model")


@query(f"WITH {L} SELECT source, session_id, count(*) AS calls, {SUMS} FROM l GROUP BY 1, 2")
def q_session_breakdown(spark, folder):
    return reports.breakdown(ledger(spark, folder), "source", "session_id")


@query(f"WITH {L} SELECT day, model, CAST(grouping(day) * 2 + grouping(model) AS BIGINT) AS level, count(*) AS calls, {SUMS} FROM l GROUP BY GROUPING SETS ((day), (model), ())")
def q_grouping_sets(spark, folder):
    return reports.day_model_all(ledger(spark, folder))


@query(f"""WITH {L} SELECT provider, count(*) AS calls, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read) AS BIGINT) AS cache_read,
 CAST(sum(reasoning) AS BIGINT) AS reasoning, CAST(sum(total) AS BIGINT) AS total FROM (
 SELECT unnest([CASE WHEN starts_with(source, 'Fleet:') AND length(source) > 6 THEN substr(source, 7) ELSE coalesce(nullif(trim(split_part(split_part(source, ' (', 1), ':', 1)), ''), 'Unknown') END, 'TOTAL']) AS provider,
  input_tokens + cache_creation AS input, * EXCLUDE (input_tokens) FROM l) GROUP BY 1""")
def q_provider_rollup(spark, folder):
    return reports.provider_rollup(ledger(spark, folder))


@query(f"""WITH {L} SELECT count(*) FILTER (exact) AS measured_calls, count(*) FILTER (NOT exact) AS estimated_calls, CAST(coalesce(sum(total) FILTER (exact), 0) AS BIGINT) AS measured,
 CAST(coalesce(sum(total) FILTER (NOT exact), 0) AS BIGINT) AS estimated, round(coalesce(coalesce(sum(total) FILTER (exact), 0) * 100.0 / nullif(sum(total), 0), 100.0), 6) AS confidence FROM l""")
def q_exact_split(spark, folder):
    return reports.exact_split(ledger(spark, folder))


HEALTH = """CASE WHEN share >= 0.95 THEN 'Excellent' WHEN share >= 0.85 THEN 'Good' WHEN share >= 0.60 THEN 'Warning' ELSE 'Cold context leak' END AS label,
 input_tokens > 250000 OR share < 0.85 AS warn"""


@query(f"""WITH {L}, s AS (SELECT model, count(*) AS calls, {SUMS} FROM l GROUP BY 1), h AS (SELECT *, cache_read / total AS share FROM s WHERE total > 0)
SELECT model, calls, input_tokens, cache_read, total, round(share, 6) AS share, {HEALTH} FROM h""")
def q_cache_health_model(spark, folder):
    return reports.cache_health(ledger(spark, folder))


@query(f"""WITH {L}, s AS (SELECT session_id, max_by(source, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || source) AS source, count(*) AS calls, {SUMS} FROM l GROUP BY 1), h AS (SELECT *, cache_read / total AS share FROM s WHERE total > 0)
SELECT session_id, source, calls, input_tokens, cache_read, total, round(share, 6) AS share, {HEALTH} FROM h ORDER BY total DESC, session_id LIMIT 10""")
def q_cache_health_sessions(spark, folder):
    return reports.session_health(ledger(spark, folder))


#: Classes told by a part of the model's name; a parameter, here for the models of the test tables.
CLASSES = (("thinking", "thinking"), ("pro", "large"), ("large", "large"), ("flash", "fast"), ("mini", "fast"), ("coder", "code"), ("free", "local"), ("9b", "local"))
_CASE = " ".join(f"WHEN contains(lower(model), '{p}') THEN '{n}'" for p, n in CLASSES)


@query(f"""WITH {L}, b AS (SELECT CASE {_CASE} ELSE 'other' END AS bucket, count(*) AS calls, sum(total) AS total FROM l GROUP BY 1)
SELECT e.bucket, coalesce(calls, 0) AS calls, CAST(coalesce(total, 0) AS BIGINT) AS total FROM (SELECT unnest({list(dict.fromkeys([*(n for _, n in CLASSES), "other"]))}) AS bucket) e LEFT JOIN b ON e.bucket = b.bucket""")
def q_class_buckets(spark, folder):
    return reports.buckets(ledger(spark, folder), CLASSES)


_HOGS = "source, model, session_id, input_tokens, output_tokens, cache_read, total"


@query(f"WITH {L} SELECT epoch_us(ts) AS at, {_HOGS} FROM l ORDER BY input_tokens DESC, {', '.join(f'{c} NULLS FIRST' for c in ('ts', *_HOGS.split(', ')))} LIMIT 20")
def q_top_calls(spark, folder):
    return reports.top_calls(ledger(spark, folder))


@query(f"WITH {L} SELECT machine, max_by(model, lpad(CAST(t AS VARCHAR), 20, '0') || model) AS model FROM (SELECT machine, model, sum(total) AS t FROM l GROUP BY 1, 2) GROUP BY 1")
def q_top_model(spark, folder):
    s = ledger(spark, folder).groupBy("machine", "model").agg(F.sum("total").alias("t"))
    return s.groupBy("machine").agg(F.max_by("model", F.struct("t", "model")).alias("model"))


@query(f"""WITH {L} SELECT count(*) AS calls, CAST(sum(total) AS BIGINT) AS total FROM l WHERE ts >= TIMESTAMP '2026-01-10 12:00:00' AND ts <= TIMESTAMP '2026-01-20 00:00:00'""")
def q_window(spark, folder):
    at = lambda s: F.lit(s).cast("timestamp")
    w = reports.in_window(ledger(spark, folder), at("2026-01-10T12:00:00Z"), at("2026-01-20T00:00:00Z"))
    return w.agg(F.count(F.lit(1)).alias("calls"), F.sum("total").alias("total"))


# ---- rates: any table of rates is a parameter; this one is made up for the models of the test tables

RATES = (("sable-4-large", 500_000_000, 2_500_000_000, 50_000_000), ("sable-4-mini", 100_000_000, 500_000_000, 10_000_000), ("corvid-2-pro", 200_000_000, 1_200_000_000, 20_000_000), ("corvid-2-flash", 30_000_000, 250_000_000, 3_000_000), ("marl-1", 300_000_000, 1_500_000_000, 30_000_000), ("thistle-coder", 175_000_000, 1_400_000_000, 17_500_000))
DATED = (("sable-3-large", "2000-01-01", "2026-01-12", 200_000_000, 1_000_000_000, 20_000_000), ("sable-3-large", "2026-01-13", None, 300_000_000, 1_500_000_000, 30_000_000))
DEFAULT = (100_000_000, 400_000_000, 10_000_000)


def _rates(spark):
    return literal(spark, RATES, "model string, input long, output long, cached long"), literal(spark, DATED, "model string, first_day string, last_day string, input long, output long, cached long")


def _free() -> Column:
    return F.endswith("key", F.lit(":free")) | F.endswith("key", F.lit("-free"))


def _billed(spark, folder, by_day: bool):
    l = ledger(spark, folder)
    sums = reports.breakdown(l if by_day else l.withColumn("day", F.lit("")), "model", "day")
    keys = sums.select("model", F.col("day") if by_day else F.lit(None).cast("string").alias("day"))
    r = rates.resolved(keys, *_rates(spark), DEFAULT, _free())
    return rates.billed(sums, r if by_day else r.withColumn("day", F.lit("")))


_VALUES = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
_STRIP = "regexp_replace({}, '-(" + "|".join(rates.VARIANTS) + ")$', '', 'i')"
_K0 = "trim(replace(model, ' (estimated)', ''))"
_K1 = _STRIP.format(_K0)
_K2 = _STRIP.format(_K1)
_K3 = _STRIP.format(_K2)


def rated_sql(by_day: bool, sums: str = "sums") -> str:
    """CTEs rate, dated, k, r and bill over a CTE ``sums`` with model, day and the five fields."""
    return f"""rate(model, input, output, cached) AS (VALUES {_VALUES(RATES)}), dated(model, first_day, last_day, input, output, cached) AS (VALUES {_VALUES(DATED)}),
 k AS (SELECT *, {_K0} AS k0, {_K1} AS k1, {_K2} AS k2, {_K3} AS k3 FROM {sums}),
 r AS (SELECT k.*, ends_with(k0, ':free') OR ends_with(k0, '-free') AS fr, d.model IS NOT NULL AS is_dated, r0.model IS NOT NULL AS is_exact, coalesce(r1.model, r2.model, r3.model) IS NOT NULL AS is_family,
  {", ".join(f"CASE WHEN ends_with(k0, ':free') OR ends_with(k0, '-free') THEN 0 ELSE coalesce(d.{c}, r0.{c}, r1.{c}, r2.{c}, r3.{c}, {v}) END AS {c}" for c, v in zip(("input", "output", "cached"), DEFAULT))}
  FROM k LEFT JOIN dated d ON {str(by_day).lower()} AND d.model = k0 AND day >= d.first_day AND (d.last_day IS NULL OR day <= d.last_day)
  LEFT JOIN rate r0 ON r0.model = k0 LEFT JOIN rate r1 ON r1.model = k1 LEFT JOIN rate r2 ON r2.model = k2 LEFT JOIN rate r3 ON r3.model = k3),
 bill AS (SELECT *, CASE WHEN fr THEN 'free' WHEN is_dated THEN 'dated' WHEN is_exact THEN 'exact' WHEN is_family THEN 'family' ELSE 'default' END AS how,
  CAST(input_tokens AS DECIMAL(38,0)) * 100 * input + CAST(cache_creation AS DECIMAL(38,0)) * 125 * input + CAST(cache_read AS DECIMAL(38,0)) * 100 * cached + CAST(output_tokens + reasoning AS DECIMAL(38,0)) * 100 * output AS cost,
  CAST(input_tokens + cache_creation + cache_read AS DECIMAL(38,0)) * 100 * input + CAST(output_tokens + reasoning AS DECIMAL(38,0)) * 100 * output AS cold FROM r)"""


def _billed_sql(by_day: bool) -> str:
    day = "day" if by_day else "''"
    return f"{L}, sums AS (SELECT model, {day} AS day, count(*) AS calls, {SUMS} FROM l GROUP BY 1, 2), {rated_sql(by_day)}"


@query(f"WITH {_billed_sql(False)} SELECT model, calls, total, how, CAST(cost AS DOUBLE) / 1e16 AS cost, CAST(cold AS DOUBLE) / 1e16 AS cold FROM bill")
def q_model_bill(spark, folder):
    return _billed(spark, folder, False).select("model", "calls", "total", "how", rates.money(F.col("cost")).alias("cost"), rates.money(F.col("cold")).alias("cold"))


@query(f"WITH {_billed_sql(True)} SELECT model, day, how, CAST(cost AS DOUBLE) / 1e16 AS cost FROM bill")
def q_dated_bill(spark, folder):
    return _billed(spark, folder, True).select("model", "day", "how", rates.money(F.col("cost")).alias("cost"))


@query(f"""WITH {_billed_sql(False)} SELECT CAST(sum(cost) AS DOUBLE) / 1e16 AS cost, CAST(sum(cold) AS DOUBLE) / 1e16 AS cold, CAST(sum(cold) - sum(cost) AS DOUBLE) / 1e16 AS saved, round(sum(cache_read) / sum(total), 6) AS cache_share,
 bool_or(how IN ('family', 'default')) AS estimated FROM bill""")
def q_shadow_bill(spark, folder):
    b = _billed(spark, folder, False)
    return b.agg(
        rates.money(F.sum("cost")).alias("cost"), rates.money(F.sum("cold")).alias("cold"), rates.money(F.sum("cold") - F.sum("cost")).alias("saved"),
        F.round(F.sum("cache_read") / F.sum("total"), 6).alias("cache_share"), F.bool_or(F.col("how").isin("family", "default")).alias("estimated"),
    )


#: Nested classes, and classes by the input rate for models that no name tells; parameters.
NESTED = (("sable", (("mini", "cheap"), ("large", "premium"))), ("flash", "cheap"), ("9b", "local"))
BY_RATE = ((300_000_000, "premium"), (100_000_000, "standard"), (1, "cheap"), (0, "local"))
_NESTED_CASE = "CASE WHEN contains(lower(model), 'sable') AND contains(lower(model), 'mini') THEN 'cheap' WHEN contains(lower(model), 'sable') AND contains(lower(model), 'large') THEN 'premium' WHEN NOT contains(lower(model), 'sable') AND contains(lower(model), 'flash') THEN 'cheap' WHEN NOT contains(lower(model), 'sable') AND NOT contains(lower(model), 'flash') AND contains(lower(model), '9b') THEN 'local' WHEN input >= 300000000 THEN 'premium' WHEN input >= 100000000 THEN 'standard' WHEN input >= 1 THEN 'cheap' WHEN input >= 0 THEN 'local' ELSE 'other' END"


@query(f"""WITH {_billed_sql(False)}, b AS (SELECT {_NESTED_CASE} AS bucket, sum(calls) AS calls, sum(total) AS total, sum(cost) AS cost FROM bill GROUP BY 1)
SELECT e.bucket, CAST(coalesce(calls, 0) AS BIGINT) AS calls, CAST(coalesce(total, 0) AS BIGINT) AS total, round(CAST(coalesce(cost, 0) AS DOUBLE) / 1e16, 10) AS cost FROM (SELECT unnest(['cheap', 'premium', 'local', 'standard', 'other']) AS bucket) e LEFT JOIN b ON e.bucket = b.bucket""")
def q_class_costs(spark, folder):
    """Classes by nested parts of the name, else by the model's rate, with their cost."""
    return reports.class_costs(_billed(spark, folder, False), NESTED, BY_RATE).withColumn("cost", F.round(rates.money(F.col("cost")), 10))


# ---- periods, records, streaks


def _with_now(l: DataFrame) -> DataFrame:
    """The ledger with its latest stamp beside every row: one row, broadcast."""
    return l.join(F.broadcast(l.agg(F.max("timestamp").alias("now"))), F.lit(True))


_COMPANY = "trim(split_part(split_part(source, ' (', 1), ':', 1))"


@query(f"""WITH {L}, n AS (SELECT max(ts) AS now FROM l), c AS (SELECT {_COMPANY} AS company, CAST(coalesce(sum(total) FILTER (ts >= now - INTERVAL 7 DAY), 0) AS BIGINT) AS current,
 CAST(coalesce(sum(total) FILTER (ts < now - INTERVAL 7 DAY), 0) AS BIGINT) AS previous FROM l, n WHERE ts >= now - INTERVAL 14 DAY GROUP BY 1),
 d AS (SELECT *, round((current - previous) * 100.0 / nullif(previous, 0), 1) AS pct FROM c)
SELECT company, current, previous, CASE WHEN previous = 0 THEN CASE WHEN current > 0 THEN 'new' ELSE '-' END ELSE CASE WHEN pct >= 0 THEN '+' ELSE '' END || format('{{:.1f}}', CAST(pct AS DOUBLE)) || '%' END AS change FROM d""")
def q_compare_periods(spark, folder):
    return reports.compare_periods(_with_now(ledger(spark, folder)), F.col("now"), 7)


def _lane_sql(name, a, b, c, d, strict=False):
    lo, hi = (">", "<=") if strict else (">=", "<")
    return f"SELECT '{name}' AS lane, CAST(coalesce(sum(total) FILTER (ts {lo} {a} AND ts <= {b}), 0) AS BIGINT) AS current, CAST(coalesce(sum(total) FILTER (ts {lo} {c} AND ts {hi} {d}), 0) AS BIGINT) AS previous FROM l, n"


_HALF = "CASE WHEN month(now) <= 6 THEN date_trunc('year', now) ELSE date_trunc('year', now) + INTERVAL 6 MONTH END"
_LANES = [("week", "date_trunc('week', now)", "INTERVAL 7 DAY"), ("month", "date_trunc('month', now)", "INTERVAL 1 MONTH"), ("quarter", "date_trunc('quarter', now)", "INTERVAL 3 MONTH"), ("half", _HALF, "INTERVAL 6 MONTH"), ("year", "date_trunc('year', now)", "INTERVAL 1 YEAR")]


@query(
    f"WITH {L}, n AS (SELECT max(ts) AS now FROM l) "
    + _lane_sql("24h", "now - INTERVAL 24 HOUR", "now", "now - INTERVAL 48 HOUR", "now - INTERVAL 24 HOUR", True)
    + "".join(" UNION ALL " + _lane_sql(n, f"({s})", "now", f"(({s}) - {b})", f"least(({s}), (({s}) - {b}) + (now - ({s})))") for n, s, b in _LANES)
)
def q_lanes(spark, folder):
    return reports.lanes(_with_now(ledger(spark, folder)), F.col("now"))


_DAILY = f"{L}, daily AS (SELECT day, sum(total) AS total FROM l GROUP BY 1)"


@query(f"""WITH {_DAILY}, k AS (SELECT 'day' AS period, day AS key, total AS v FROM daily UNION ALL SELECT 'week', strftime(CAST(day AS DATE), '%G-W%V'), total FROM daily UNION ALL SELECT 'month', left(day, 7), total FROM daily),
 s AS (SELECT period, key, CAST(sum(v) AS BIGINT) AS value FROM k GROUP BY 1, 2) SELECT period, key, value FROM s QUALIFY row_number() OVER (PARTITION BY period ORDER BY value DESC, key) = 1""")
def q_records(spark, folder):
    return reports.records(reports.breakdown(ledger(spark, folder), "day"))


@query("""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, sum(CAST(floor(o_totalprice) AS BIGINT)) AS v FROM orders GROUP BY 1), g AS (SELECT d, d - CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS g FROM o WHERE v > 0),
 r AS (SELECT min(d) AS f, max(d) AS l, count(*) AS n FROM g GROUP BY g), t AS (SELECT max(d) AS today FROM o)
SELECT max(n) AS longest, (SELECT strftime(f, '%Y-%m-%d') FROM r ORDER BY n DESC, f LIMIT 1) AS longest_first, (SELECT strftime(l, '%Y-%m-%d') FROM r ORDER BY n DESC, f LIMIT 1) AS longest_last,
 coalesce(max(n) FILTER (l >= today - 1 AND l <= today), 0) AS current FROM r, t""")
def q_streaks(spark, folder):
    o = table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum(F.floor("o_totalprice").cast("long")).alias("total"))
    return reports.streaks(o, o.agg(F.max("day").alias("today")))


@query(f"""WITH {L}, d AS (SELECT machine, day, sum(total) AS total FROM l GROUP BY 1, 2), s AS (SELECT unnest(generate_series(min(CAST(day AS DATE)), max(CAST(day AS DATE)), INTERVAL 1 DAY)) AS t FROM d)
SELECT m.machine, strftime(t, '%Y-%m-%d') AS day, CAST(coalesce(d.total, 0) AS BIGINT) AS total FROM (SELECT DISTINCT machine FROM d) m CROSS JOIN s LEFT JOIN d ON d.machine = m.machine AND d.day = strftime(t, '%Y-%m-%d')""")
def q_calendar_spine(spark, folder):
    return reports.spine(reports.breakdown(ledger(spark, folder), "machine", "day").select("machine", "day", "total"), "machine")


# ---- findings

_SPIKES = """d AS (SELECT source, day, sum(input_tokens + cache_creation) AS value FROM l GROUP BY 1, 2), m AS (SELECT source, list_sort(list(value))[count(*) // 2 + 1] AS median FROM d GROUP BY 1 HAVING count(*) >= 3),
 spikes AS (SELECT d.source, day, CAST(value AS BIGINT) AS value, CAST(median AS BIGINT) AS median FROM d JOIN m ON d.source = m.source WHERE value >= 3 * median AND value > 50000)"""


@query(f"WITH {L}, {_SPIKES} SELECT * FROM spikes")
def q_day_spikes(spark, folder):
    return reports.day_spikes(ledger(spark, folder))


@query(f"""WITH {L}, {_SPIKES}, mo AS (SELECT model, sum(total) AS v FROM l GROUP BY 1), s AS (SELECT source, {SUMS}, count(*) AS n, count(*) FILTER (NOT exact) AS est, sum(input_tokens + cache_creation + cache_read) AS ctx FROM l GROUP BY 1)
SELECT 'concentration' AS rule, '' AS source, max_by(model, v) AS subject, round(max(v) / sum(v), 4) AS value FROM mo HAVING count(*) > 1 AND max(v) >= 0.6 * sum(v)
UNION ALL SELECT 'cold cache', source, '', round(cache_read / ctx, 4) FROM s WHERE ctx >= 100000 AND cache_read / ctx < 0.5
UNION ALL SELECT 'cache churn', source, '', round(cache_creation / cache_read, 4) FROM s WHERE cache_creation > cache_read AND cache_read > 0
UNION ALL SELECT 'estimated', source, '', round(est / n, 4) FROM s WHERE est > 0.5 * n
UNION ALL SELECT 'day spike', source, day, round(value / median, 4) FROM spikes""")
def q_findings(spark, folder):
    return reports.findings(ledger(spark, folder))


# ---- ordered state over sessions of documents

_STEPS = """st AS (SELECT session_id, doc_id, epoch_us(created_at) AS at_us, CASE WHEN source IN ('agent_replies', 'tool_output', 'commit_log') THEN 'assistant' WHEN source = 'session_notes' THEN 'system' ELSE 'user' END AS role,
 coalesce(length(text), 0) AS n, nullif(model, '') AS cand FROM documents WHERE session_id IS NOT NULL AND created_at IS NOT NULL)"""


def _steps(spark, folder):
    d = table(spark, folder, "documents").filter("session_id is not null and created_at is not null")
    role = F.when(F.col("source").isin("agent_replies", "tool_output", "commit_log"), "assistant").when(F.col("source") == "session_notes", "system").otherwise("user")
    s = d.select("session_id", "doc_id", F.unix_micros("created_at").alias("at"), role.alias("role"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"), F.nullif(F.col("model"), F.lit("")).alias("cand"))
    return s.withColumn("chunk", F.floor(F.col("at") / F.lit(86_400_000_000)))


_WINDOW = (1_767_225_600_000_000 + 30 * 86_400_000_000, 1_767_225_600_000_000 + 240 * 86_400_000_000)


@query(f"""WITH {_STEPS} SELECT session_id, doc_id, coalesce(last_value(cand IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY at_us, doc_id ROWS UNBOUNDED PRECEDING), 'sable-4-mini') AS model FROM st""")
def q_model_ffill(spark, folder):
    s = _steps(spark, folder)
    return ordered.forward_fill(s, "session_id", "chunk", ["at", "doc_id"], "cand", "sable-4-mini", "model").select("session_id", "doc_id", "model")


def _estimate_sql(first: str, own: bool) -> str:
    return f"""WITH {_STEPS}, {first}, c AS (SELECT * FROM p WHERE role = 'assistant'),
 b AS (SELECT *, coalesce(lag(acc{" + n" if own else ""}) OVER (PARTITION BY session_id ORDER BY at_us, doc_id), 0) AS before FROM c)
SELECT session_id, doc_id, CAST(CASE WHEN before > 0 THEN greatest(0, acc // 4 - before // 4) ELSE acc // 4 + 6000 END AS BIGINT) AS input_tokens, CAST(CASE WHEN before > 0 THEN before // 4 + 6000 ELSE 0 END AS BIGINT) AS cache_read,
 CAST(greatest(1, n // 4) AS BIGINT) AS output_tokens FROM b"""


_OVER = "OVER (PARTITION BY session_id ORDER BY at_us, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_EST = ["session_id", "doc_id", "input_tokens", "cache_read", "output_tokens"]


@query(_estimate_sql(f"p AS (SELECT *, CAST(coalesce(sum(n) {_OVER}, 0) AS BIGINT) AS acc FROM st WHERE at_us BETWEEN {_WINDOW[0]} AND {_WINDOW[1]})", True))
def q_planner_estimator(spark, folder):
    """Steps outside the window add nothing; a call has sent its own characters too."""
    s = _steps(spark, folder).filter(F.col("at").between(*_WINDOW))
    return ordered.estimated_calls(s, "session_id", "chunk", ["at", "doc_id"], "n", F.col("role") == "assistant", own=True).select(*_EST)


@query(_estimate_sql(f"q AS (SELECT *, CASE WHEN role = 'system' THEN 0 ELSE n END AS add_n FROM st), r AS (SELECT *, CAST(coalesce(sum(add_n) {_OVER}, 0) AS BIGINT) AS acc FROM q), p AS (SELECT * FROM r WHERE at_us BETWEEN {_WINDOW[0]} AND {_WINDOW[1]})", False))
def q_session_estimator(spark, folder):
    """Steps outside the window add to the context too; a call's own characters do not count as sent."""
    s = _steps(spark, folder).withColumn("adds", F.when(F.col("role") == "system", F.lit(0).cast("long")).otherwise(F.col("n")))
    call = (F.col("role") == "assistant") & F.col("at").between(*_WINDOW)
    return ordered.estimated_calls(s, "session_id", "chunk", ["at", "doc_id"], "adds", call, own=False).select(*_EST)


@query(_estimate_sql(f"p AS (SELECT *, CAST(coalesce(sum(n) {_OVER}, 0) AS BIGINT) AS acc FROM st)", True))
def q_planner_estimator_whole(spark, folder):
    """q_planner_estimator over the whole table, without a window of dates."""
    s = _steps(spark, folder)
    return ordered.estimated_calls(s, "session_id", "chunk", ["at", "doc_id"], "n", F.col("role") == "assistant", own=True).select(*_EST)


@query(_estimate_sql(f"q AS (SELECT *, CASE WHEN role = 'system' THEN 0 ELSE n END AS add_n FROM st), p AS (SELECT *, CAST(coalesce(sum(add_n) {_OVER}, 0) AS BIGINT) AS acc FROM q)", False))
def q_session_estimator_whole(spark, folder):
    """q_session_estimator over the whole table, without a window of dates."""
    s = _steps(spark, folder).withColumn("adds", F.when(F.col("role") == "system", F.lit(0).cast("long")).otherwise(F.col("n")))
    return ordered.estimated_calls(s, "session_id", "chunk", ["at", "doc_id"], "adds", F.col("role") == "assistant", own=False).select(*_EST)


@query(r"""WITH k AS (SELECT row_id, coalesce(nullif(regexp_replace(requestId, '^\s+|\s+$', '', 'g'), ''), nullif(regexp_replace(uuid, '^\s+|\s+$', '', 'g'), '')) AS k FROM transcripts WHERE message.usage IS NOT NULL)
SELECT row_id FROM k QUALIFY k IS NULL OR row_number() OVER (PARTITION BY k ORDER BY row_id) = 1""")
def q_request_dedup(spark, folder):
    """First wins by request, else by row id of the client; rows without either are all kept."""
    t = table(spark, folder, "transcripts").filter("message.usage is not null").select("row_id", "requestId", "uuid")
    return ordered.first_wins(t, F.coalesce(times.filled(F.col("requestId")), times.filled(F.col("uuid"))), "row_id").select("row_id")


@query(r"""WITH k AS (SELECT *, nullif(regexp_replace(requestId, '^\s+|\s+$', '', 'g'), '') AS k FROM transcripts), e AS (SELECT k, min(row_id) AS first_order, max(row_id) AS l FROM k WHERE k IS NOT NULL GROUP BY 1)
SELECT t.row_id, first_order, message.model AS model FROM k t JOIN e ON t.k = e.k AND t.row_id = e.l""")
def q_last_wins_dedup(spark, folder):
    t = table(spark, folder, "transcripts").select("row_id", "requestId", F.col("message.model").alias("model"))
    return ordered.last_wins(t, times.filled(F.col("requestId")), "row_id").select("row_id", "first_order", "model")


# ---- joins and sets


@query("""SELECT session_id, count(*) AS calls FROM invocations i WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.session_id = i.session_id) AND session_id IS NOT NULL GROUP BY 1""")
def q_live_anti_join(spark, folder):
    """Sessions that were not seen live."""
    live = table(spark, folder, "documents").select("session_id").distinct()
    return table(spark, folder, "invocations").filter("session_id is not null").join(live, "session_id", "left_anti").groupBy("session_id").agg(F.count(F.lit(1)).alias("calls"))


@query("""SELECT i.machine, count(*) AS calls FROM invocations i WHERE i.machine IN (SELECT machine FROM dailies WHERE machine IS NOT NULL) GROUP BY 1""")
def q_known_semi(spark, folder):
    known = table(spark, folder, "dailies").select("machine").distinct()
    return table(spark, folder, "invocations").join(known, "machine", "left_semi").groupBy("machine").agg(F.count(F.lit(1)).alias("calls"))


@query("""WITH a AS (SELECT machine, count(*) AS calls FROM invocations GROUP BY 1), b AS (SELECT machine, count(*) AS lines FROM transcripts GROUP BY 1)
SELECT coalesce(a.machine, b.machine) AS machine, coalesce(calls, 0) AS calls, coalesce(lines, 0) AS lines FROM a FULL JOIN b ON a.machine = b.machine""")
def q_full_outer_compare(spark, folder):
    a = table(spark, folder, "invocations").groupBy("machine").agg(F.count(F.lit(1)).alias("calls"))
    b = table(spark, folder, "transcripts").groupBy("machine").agg(F.count(F.lit(1)).alias("lines"))
    zero = F.lit(0).cast("long")
    return a.join(b, "machine", "full_outer").select("machine", F.coalesce("calls", zero).alias("calls"), F.coalesce("lines", zero).alias("lines"))


_SETS = "a AS (SELECT DISTINCT machine FROM invocations), b AS (SELECT DISTINCT machine FROM dailies WHERE machine IS NOT NULL)"


@query(f"""WITH {_SETS} SELECT 'union' AS op, machine FROM (SELECT machine FROM a UNION SELECT machine FROM b) UNION ALL SELECT 'intersect', machine FROM (SELECT machine FROM a INTERSECT SELECT machine FROM b)
UNION ALL SELECT 'except', machine FROM (SELECT machine FROM b EXCEPT SELECT machine FROM a)""")
def q_set_ops(spark, folder):
    a, b = (table(spark, folder, n).select("machine").filter("machine is not null") for n in ("invocations", "dailies"))
    out = [a.union(b).distinct(), a.intersect(b), b.exceptAll(a.distinct()).join(a.distinct(), "machine", "left_anti").distinct()]
    r = [d.select(F.lit(n).alias("op"), "machine") for n, d in zip(("union", "intersect", "except"), out)]
    return r[0].unionByName(r[1]).unionByName(r[2])


@query("""SELECT source, kind, count(*) AS rows, CAST(sum(n) AS BIGINT) AS tokens FROM (
 SELECT source, 'invocation' AS kind, coalesce(input_tokens, 0) AS n FROM invocations
 UNION ALL SELECT 'Fleet:' || coalesce(nullif(regexp_replace(provider, '^\\s+|\\s+$', '', 'g'), ''), 'Fleet'), 'ledger', greatest(coalesce(input_tokens, 0), 0) FROM fleet_usage) GROUP BY 1, 2""".replace("\\\\", "\\"))
def q_union_lanes(spark, folder):
    """Lanes of different shape brought into one."""
    zero = F.lit(0).cast("long")
    a = table(spark, folder, "invocations").select("source", F.lit("invocation").alias("kind"), F.coalesce("input_tokens", zero).alias("n"))
    b = table(spark, folder, "fleet_usage").select(F.concat(F.lit("Fleet:"), F.coalesce(times.filled(F.col("provider")), F.lit("Fleet"))).alias("source"), F.lit("ledger").alias("kind"), F.greatest(F.coalesce("input_tokens", zero), zero).alias("n"))
    return a.unionByName(b).groupBy("source", "kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens"))


@query("""WITH o AS (SELECT coalesce(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0) + coalesce(reasoning, 0)), 0) AS counted FROM invocations WHERE "timestamp" IS NOT NULL),
 n AS (SELECT count(*) AS threads, sum(coalesce(message.usage.input_tokens, 0) + coalesce(message.usage.output_tokens, 0)) AS native FROM transcripts WHERE message.usage IS NOT NULL)
SELECT CAST(counted AS BIGINT) AS counted, threads, CAST(native AS BIGINT) AS native, round((counted - native) * 100.0 / nullif(native, 0), 2) AS delta FROM o, n""")
def q_cross_check(spark, folder):
    """What was counted against another count of the same."""
    zero = F.lit(0).cast("long")
    u = lambda c: F.coalesce(F.col(f"message.usage.{c}"), zero)
    native = table(spark, folder, "transcripts").filter("message.usage is not null").agg(F.count(F.lit(1)).alias("threads"), F.sum(u("input_tokens") + u("output_tokens")).alias("tokens"))
    return reports.cross_check(ledger(spark, folder), native)


# ---- scalar functions and texts


@query("""SELECT machine, trim(regexp_replace(lower(machine), '[^a-z0-9]+', '-', 'g'), '-') AS slug, count(*) AS n FROM dailies WHERE machine IS NOT NULL GROUP BY 1, 2""")
def q_slugs(spark, folder):
    return table(spark, folder, "dailies").filter("machine is not null").groupBy("machine", names.slug(F.col("machine")).alias("slug")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT day, strftime(d, '%G-W%V') AS week, strftime(date_trunc('month', d), '%Y-%m-%d') AS month, strftime(date_trunc('quarter', d), '%Y-%m-%d') AS quarter,
 strftime(CASE WHEN month(d) <= 6 THEN date_trunc('year', d) ELSE date_trunc('year', d) + INTERVAL 6 MONTH END, '%Y-%m-%d') AS half, strftime(date_trunc('year', d), '%Y-%m-%d') AS year FROM (
 SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def q_period_starts(spark, folder):
    d = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    half = F.when(F.month("d") <= 6, F.trunc("d", "year")).otherwise(F.add_months(F.trunc("d", "year"), 6))
    week = F.concat(F.extract(F.lit("yearofweek"), "d").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("d").cast("string"), 2, "0"))
    return d.select(text("d").alias("day"), week.alias("week"), text(F.trunc("d", "month")).alias("month"), text(F.trunc("d", "quarter")).alias("quarter"), text(half).alias("half"), text(F.trunc("d", "year")).alias("year"))


_STATS = """count(*) AS docs, count(*) FILTER (text IS NULL) AS nulls, count(*) FILTER (coalesce(text, '') = '') AS empties, CAST(sum(n) AS BIGINT) AS tokens, round(avg(n), 4) AS mean, round(quantile_cont(n, 0.5), 4) AS median,
 round(quantile_cont(n, 0.75) - quantile_cont(n, 0.25), 4) AS iqr, round(quantile_cont(n, 0.95), 4) AS p95, round(quantile_cont(n, 0.99), 4) AS p99, round(stddev_samp(n), 4) AS stddev"""
_LENGTHS = "n AS (SELECT *, coalesce(length(text) // 4, 0) AS n FROM documents)"


@query(f"WITH {_LENGTHS} SELECT {_STATS} FROM n")
def q_doc_stats(spark, folder):
    return textstats.length_stats(table(spark, folder, "documents"), "text", counter=textstats.chars_tokens)


@query(f"WITH {_LENGTHS} SELECT {_STATS} FROM n")
def q_doc_stats_state(spark, folder):
    """The same from states of two halves, united."""
    d = table(spark, folder, "documents")
    halves = [textstats.length_state(d.filter(F.col("source").isNull() == b), "text", textstats.chars_tokens) for b in (True, False)]
    return textstats.finished(halves[0].unionByName(halves[1]))


@query(f"WITH {_LENGTHS} SELECT source, {_STATS} FROM n GROUP BY 1")
def q_doc_stats_by_source(spark, folder):
    return textstats.length_stats(table(spark, folder, "documents"), "text", ["source"], textstats.chars_tokens)


_PATTERNS = textstats.PRIVATE | {"secret": textstats.SECRET}


@query(" UNION ALL ".join("SELECT '{}' AS pattern, count(*) FILTER (regexp_matches(text, '{}')) AS docs FROM documents".format(n, p.replace("'", "''")) for n, p in _PATTERNS.items()))
def q_privacy_scan(spark, folder):
    return textstats.pattern_counts(table(spark, folder, "documents"), "text", _PATTERNS)

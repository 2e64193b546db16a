"""Queries of the general problems 2 to 5 over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, times
from ..operators import deliveries, late, rolling, schema_drift
from ..schema import SCHEMA_VERSION, TOKEN_FIELDS
from ..session import cut, fresh_folder, table


# ---- 2: late and out-of-order events


def exports(spark: SparkSession, folder: str) -> DataFrame:
    """The exports that count: machine, date, stamp, totals, record_id."""
    return _exports(table(spark, folder, "dailies"))


def _exports(dailies: DataFrame) -> DataFrame:
    d = dailies.filter(F.col("schema") == SCHEMA_VERSION)
    d = d.select("record_id", names.slug(F.col("machine")).alias("machine"), times.loose_date(F.col("date")).alias("date"), times.instant(F.col("generated_at")).alias("stamp"), "totals")
    return d.filter("date is not null and stamp is not null")


def _replayed(spark: SparkSession, folder: str) -> late.Replay:
    return late.replay(exports(spark, folder), "machine", "date", "stamp", "totals", "record_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    outcomes = F.array_compact(F.array(F.when(F.col("corrected"), F.lit("corrected")), F.when(F.col("missed"), F.lit("missed"))))
    return _replayed(spark, folder).settled().select(F.col("source").alias("machine"), F.col("day").cast("string").alias("date"), F.explode(outcomes).alias("outcome"))


def p2_date_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Each date's totals as they stand after every export in time, and when the date closed for the whole fleet."""
    r = _replayed(spark, folder)
    sums = [F.sum(F.coalesce(F.col(f"last_value.{f}"), F.lit(0))).cast("long").alias(f) for f in TOKEN_FIELDS]
    totals = r.settled().groupBy("day").agg(
        F.count(F.when(F.col("n_in_time") > 0, 1)).alias("machines"),
        *[F.coalesce(x, F.lit(0).cast("long")).alias(f) for x, f in zip(sums, TOKEN_FIELDS)],
        F.count(F.when(F.col("corrected"), 1)).alias("corrected"),
        F.count(F.when(F.col("missed"), 1)).alias("missed"),
        F.sum("n_late").cast("long").alias("late_records"),
    )
    return totals.join(r.closings().select("day", F.unix_micros("closed_at").alias("closed_us")), "day", "left").withColumn("date", F.col("day").cast("string")).drop("day")


def p2_closings(spark: SparkSession, folder: str) -> DataFrame:
    """When each date closes for the whole fleet, and how many machines were idle by then."""
    return _replayed(spark, folder).closings().select(F.col("day").cast("string").alias("day"), F.unix_micros("closed_at").alias("closed_us"), "n_passed", "n_idle")


def p2_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The exports run through the stream of late records: first and last totals in time of each machine and date."""
    from ..streaming.daily import file_stream
    from ..streaming.late import LateTotals

    out = fresh_folder(spark, "late")
    e = _exports(file_stream(spark, f"{folder}/dailies.parquet", 1_000_000))
    batch = e.select(F.col("machine").alias("source"), F.col("date").alias("period"), "stamp", F.col("totals").alias("value"), F.col("record_id").alias("order"))
    s = LateTotals(spark, f"{out}/state", e.schema["totals"].dataType.simpleString())
    s.start(batch, f"{out}/checkpoint").awaitTermination()
    standing = s.open(0).unionByName(s.final())
    total = lambda c: sum((F.coalesce(F.col(f"{c}.{f}"), F.lit(0)) for f in TOKEN_FIELDS), F.lit(0).cast("long"))
    return standing.select(F.col("source").alias("machine"), F.col("period").cast("string").alias("date"), F.col("n").alias("in_time"), total("f").alias("first_total"), total("l").alias("last_total"))


_STAMP_SQL = r"""CASE WHEN regexp_full_match(trim({c}), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]+)?)?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?')
 THEN try_cast(replace(left(regexp_replace(trim({c}), '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$', ''), 26), 'T', ' ') AS TIMESTAMP)
 - to_minutes(CASE WHEN regexp_matches(trim({c}), '[+-][0-9]{{2}}:?[0-9]{{2}}$') AND length(trim({c})) > 16
   THEN CAST(regexp_extract(trim({c}), '([+-])[0-9]{{2}}:?[0-9]{{2}}$', 1) || '1' AS INTEGER) * (60 * CAST(regexp_extract(trim({c}), '[+-]([0-9]{{2}}):?[0-9]{{2}}$', 1) AS INTEGER) + CAST(regexp_extract(trim({c}), '[+-][0-9]{{2}}:?([0-9]{{2}})$', 1) AS INTEGER)) ELSE 0 END) END"""


def stamp_sql(column: str) -> str:
    """The instant of a stamp column as a UTC TIMESTAMP, in SQL."""
    return _STAMP_SQL.format(c=column)


_EXPORTS_SQL = rf"""exports AS (
 SELECT record_id, trim(regexp_replace(lower(machine), '[^a-z0-9]+', '-', 'g'), '-') AS machine,
  try_strptime(replace(replace(trim(date), '-', ''), '/', ''), '%Y%m%d') AS date,
  {stamp_sql("generated_at")} AS stamp, totals
 FROM dailies WHERE schema = 3),
 timed AS (SELECT *, stamp <= date + INTERVAL 4 DAY AS ok FROM exports WHERE date IS NOT NULL AND stamp IS NOT NULL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY machine, date, ok ORDER BY stamp, record_id) AS up,
  row_number() OVER (PARTITION BY machine, date, ok ORDER BY stamp DESC, record_id DESC) AS down FROM timed),
 standing AS (SELECT machine, date, max(CASE WHEN ok AND up = 1 THEN totals END) AS f, max(CASE WHEN ok AND down = 1 THEN totals END) AS l,
  count(*) FILTER (ok) AS n_in, count(*) FILTER (NOT ok) AS n_late FROM ranked GROUP BY 1, 2),
 lates AS (SELECT t.machine, t.date, bool_or(t.totals IS DISTINCT FROM s.l) AS differs FROM timed t JOIN standing s ON t.machine = s.machine AND t.date = s.date WHERE NOT t.ok GROUP BY 1, 2),
 settled AS (SELECT s.*, n_in > 0 AND f IS DISTINCT FROM l AS corrected, n_in = 0 OR coalesce(differs, false) AS missed
  FROM standing s LEFT JOIN lates x ON x.machine = s.machine AND x.date = s.date)"""

P2_FOUND_SQL = f"""WITH {_EXPORTS_SQL}
SELECT machine, strftime(date, '%Y-%m-%d') AS date, 'corrected' AS outcome FROM settled WHERE corrected
UNION ALL SELECT machine, strftime(date, '%Y-%m-%d'), 'missed' FROM settled WHERE missed"""

_CLOSINGS_SQL = """e AS (SELECT machine AS s, date, stamp FROM exports WHERE date IS NOT NULL AND stamp IS NOT NULL),
 days AS (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM e),
 pairs AS (SELECT d, s, d + INTERVAL 4 DAY AS bound, min(stamp) FILTER (stamp > d + INTERVAL 4 DAY) AS nxt, max(stamp) FILTER (stamp <= d + INTERVAL 4 DAY) AS before FROM days, e GROUP BY 1, 2),
 timeouts AS (SELECT *, greatest(bound, before + INTERVAL 7 DAY) AS timeout FROM pairs WHERE before IS NOT NULL),
 told AS (SELECT *, nxt IS NULL OR nxt > timeout AS idle FROM timeouts),
 closings AS (SELECT strftime(d, '%Y-%m-%d') AS day, epoch_us(max(CASE WHEN idle THEN timeout ELSE nxt END)) AS closed_us, count(*) FILTER (NOT idle) AS n_passed, count(*) FILTER (idle) AS n_idle FROM told GROUP BY 1)"""

P2_DATE_TOTALS_SQL = f"""WITH {_EXPORTS_SQL}, {_CLOSINGS_SQL},
 t AS (SELECT strftime(date, '%Y-%m-%d') AS date, count(*) FILTER (n_in > 0) AS machines,
{", ".join(f"CAST(coalesce(sum(coalesce(l.{f}, 0)), 0) AS BIGINT) AS {f}" for f in TOKEN_FIELDS)},
count(*) FILTER (corrected) AS corrected, count(*) FILTER (missed) AS missed, CAST(sum(n_late) AS BIGINT) AS late_records
FROM settled GROUP BY 1) SELECT t.*, closed_us FROM t LEFT JOIN closings ON day = t.date"""

P2_CLOSINGS_SQL = f"WITH {_EXPORTS_SQL.partition(' timed AS')[0].rstrip(', ' + chr(10))}, {_CLOSINGS_SQL} SELECT * FROM closings"

P2_STREAM_SQL = f"""WITH {_EXPORTS_SQL} SELECT machine, strftime(date, '%Y-%m-%d') AS date, n_in AS in_time, {", ".join(f"CAST({' + '.join(f'coalesce({c}.{f}, 0)' for f in TOKEN_FIELDS)} AS BIGINT) AS {n}" for c, n in (("f", "first_total"), ("l", "last_total")))}
FROM settled WHERE n_in > 0"""


# ---- 3: rolling totals


def _rolled(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "fleet_usage")
    count = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0).cast("long")), F.lit(0).cast("long"))
    rows = f.select(names.provider(F.col("provider")).alias("provider"), times.day(times.instant(F.col("timestamp"))).alias("day"), (count("input_tokens") + count("output_tokens")).alias("tokens"))
    return rolling.trailing_totals(rows, "provider", "day", "tokens", (7, 30))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    r = _rolled(spark, folder).filter("nth >= 30 and sum30 > 0 and sum7 * 30 >= 2 * sum30 * 7")
    return r.select("provider", F.col("day").cast("string").alias("day"))


def p3_rolling(spark: SparkSession, folder: str) -> DataFrame:
    return _rolled(spark, folder).select("provider", F.col("day").cast("string").alias("day"), "nth", "tokens", "sum7", "sum30", F.round("avg7", 4).alias("avg7"), F.round("avg30", 4).alias("avg30"))


_ROLLED_SQL = rf"""base AS (
 SELECT coalesce(nullif(lower(trim(provider)), ''), 'fleet') AS provider, CAST({stamp_sql("timestamp")} AS DATE) AS day,
  greatest(coalesce(input_tokens, 0), 0) + greatest(coalesce(output_tokens, 0), 0) AS tokens FROM fleet_usage),
 daily AS (SELECT provider, day, sum(tokens) AS tokens FROM base WHERE day IS NOT NULL GROUP BY 1, 2),
 span AS (SELECT provider, min(day) AS f, max(day) AS l FROM daily GROUP BY 1),
 calendar AS (SELECT provider, f, CAST(unnest(generate_series(f, l, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
 full_days AS (SELECT c.provider, c.f, c.day, coalesce(d.tokens, 0) AS tokens FROM calendar c LEFT JOIN daily d ON c.provider = d.provider AND c.day = d.day),
 rolled AS (SELECT provider, day, date_diff('day', f, day) + 1 AS nth, tokens,
  sum(tokens) OVER (PARTITION BY provider ORDER BY day ROWS 6 PRECEDING) AS sum7,
  sum(tokens) OVER (PARTITION BY provider ORDER BY day ROWS 29 PRECEDING) AS sum30 FROM full_days)"""

P3_FOUND_SQL = f"WITH {_ROLLED_SQL} SELECT provider, strftime(day, '%Y-%m-%d') AS day FROM rolled WHERE nth >= 30 AND sum30 > 0 AND sum7 * 30 >= 2 * sum30 * 7"
P3_ROLLING_SQL = f"""WITH {_ROLLED_SQL} SELECT provider, strftime(day, '%Y-%m-%d') AS day, CAST(nth AS INTEGER) AS nth, CAST(tokens AS BIGINT) AS tokens, CAST(sum7 AS BIGINT) AS sum7,
CAST(sum30 AS BIGINT) AS sum30, round(CAST(sum7 AS DOUBLE) / 7, 4) AS avg7, round(CAST(sum30 AS DOUBLE) / 30, 4) AS avg30 FROM rolled"""


# ---- 4: schemas that drift between files


def _layouts(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.reduced(table(spark, folder, "daily_files"), "file_id", "machine", "received_at", "body")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.changes(_layouts(spark, folder)).select(F.col("id").alias("file_id"), "field", "change", "new_field")


def p4_schema(spark: SparkSession, folder: str) -> DataFrame:
    """The fused schema with every alternative type per path and the file that brought it."""
    return schema_drift.inferred(_layouts(spark, folder))


P4_SCHEMA_SQL = r"""WITH RECURSIVE f AS (SELECT file_id, received_at, CAST(body AS JSON) AS j FROM daily_files WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
 w(file_id, received_at, path, v, listed) AS (SELECT file_id, received_at, '', j, false FROM f
  UNION ALL SELECT file_id, received_at, CASE WHEN is_map THEN path || '.*' WHEN path = '' THEN key ELSE path || '.' || key END, json_extract(v, '$."' || replace(key, '"', '\"') || '"'), NOT is_map
  FROM (SELECT *, unnest(json_keys(v)) AS key FROM (SELECT *, path <> '' AND listed AND len(json_keys(v)) > 0 AND len(list_filter(json_keys(v), lambda k: json_type(json_extract(v, '$."' || replace(k, '"', '\"') || '"')) <> 'OBJECT')) = 0 AS is_map FROM w WHERE json_type(v) = 'OBJECT')) x),
 k AS (SELECT file_id, received_at, path, CASE json_type(v) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'number' WHEN 'NULL' THEN 'null' ELSE 'integer' END AS kind FROM w WHERE listed),
 t AS (SELECT file_id, received_at, path AS field, coalesce(nullif(array_to_string(list_sort(list(DISTINCT kind) FILTER (kind <> 'null')), '|'), ''), 'null') AS type FROM k GROUP BY ALL),
 n AS (SELECT field, type, count(*) AS files, arg_min(file_id, received_at) AS first_id FROM t GROUP BY 1, 2),
 u AS (SELECT field, array_to_string(list_sort(list(DISTINCT type)), '|') AS alternatives FROM n WHERE type <> 'null' GROUP BY 1)
SELECT n.*, coalesce(alternatives, 'null') AS alternatives FROM n LEFT JOIN u ON u.field = n.field"""


#: So many names of fields go to every worker at most. Beyond that each file comes with the names that concern it.
MOST_NAMES = 100_000


def p4_table(spark: SparkSession, folder: str) -> DataFrame:
    """Every readable file as one row with the fields of daily_fields; values of other types also in branches."""
    files, wanted = table(spark, folder, "daily_files"), table(spark, folder, "daily_fields")
    layouts = _layouts(spark, folder)
    names_ = cut(schema_drift.aliases(cut(schema_drift.changes(layouts)), wanted))
    fields = [(r.field, r.json_type) for r in wanted.collect()]  # the columns of the result
    told = None
    if names_.count() <= MOST_NAMES:
        told = {r.path: r.canonical for r in names_.collect()}
    else:
        files = schema_drift.named_files(files, "file_id", layouts, names_)
    t = schema_drift.consistent(files, "file_id", "machine", "received_at", "body", fields, told)
    return t.withColumnRenamed("_id", "file_id").drop("_source", "_received")


# ---- 5: messages delivered more than once

_COUNTED = "message.usage is not null"


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    return deliveries.deletion_vectors(spark, path, F.col("requestId"), F.col("uuid"), "row_id", F.expr(_COUNTED))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The surplus copies, read off the deletion vectors."""
    path = f"{folder}/transcripts.parquet"
    return deliveries.read_dropped(spark, path, _vectors(spark, path)).select("row_id")


def p5_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Exactly one whole row per call, read under the deletion vectors of the surplus copies."""
    path = f"{folder}/transcripts.parquet"
    kept = deliveries.read_kept(spark, path, _vectors(spark, path)).filter(_COUNTED)
    u = "message.usage."
    return kept.select(
        "row_id", "batch_id", "line_no", "machine", "project_name", "timestamp", F.col("message.model").alias("model"),
        *[F.col(u + c).alias(c) for c in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")],
    )


_MESSAGES_SQL = r"""e AS (SELECT row_id, nullif(regexp_replace(requestId, '^\s+|\s+$', '', 'g'), '') AS r, lower(nullif(regexp_replace(uuid, '^\s+|\s+$', '', 'g'), '')) AS u
  FROM transcripts WHERE message.usage IS NOT NULL),
 g AS (SELECT u, min(r) AS r0, max(r) AS r1 FROM e WHERE u IS NOT NULL GROUP BY u),
 links AS (SELECT DISTINCT e.r AS a, g.r0 AS b FROM e JOIN g ON e.u = g.u WHERE e.r IS NOT NULL AND e.r <> g.r0),
 both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
 reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
 comp AS (SELECT a AS r, least(a, min(b)) AS c FROM reach GROUP BY a),
 keyed AS (SELECT e.row_id, coalesce(c1.c, e.r, c2.c, g.r0, 'u:' || e.u, 'row:' || e.row_id) AS k
  FROM e LEFT JOIN comp c1 ON e.r = c1.r LEFT JOIN g ON e.r IS NULL AND e.u = g.u LEFT JOIN comp c2 ON g.r0 = c2.r),
 ranked AS (SELECT row_id, row_number() OVER (PARTITION BY k ORDER BY row_id) AS n FROM keyed)"""

P5_FOUND_SQL = f"WITH RECURSIVE {_MESSAGES_SQL} SELECT row_id FROM ranked WHERE n > 1"
P5_MESSAGES_SQL = f"""WITH RECURSIVE {_MESSAGES_SQL} SELECT t.row_id, batch_id, line_no, machine, project_name, "timestamp", message.model AS model,
message.usage.input_tokens AS input_tokens, message.usage.output_tokens AS output_tokens, message.usage.cache_creation_input_tokens AS cache_creation_input_tokens,
message.usage.cache_read_input_tokens AS cache_read_input_tokens FROM transcripts t JOIN ranked r ON t.row_id = r.row_id WHERE r.n = 1"""


QUERIES = {"p2_found": p2_found, "p2_date_totals": p2_date_totals, "p2_closings": p2_closings, "p2_stream": p2_stream, "p3_found": p3_found, "p3_rolling": p3_rolling, "p4_found": p4_found, "p4_schema": p4_schema, "p4_table": p4_table, "p5_found": p5_found, "p5_messages": p5_messages}
SQL = {"p2_found": P2_FOUND_SQL, "p2_date_totals": P2_DATE_TOTALS_SQL, "p2_closings": P2_CLOSINGS_SQL, "p2_stream": P2_STREAM_SQL, "p3_found": P3_FOUND_SQL, "p3_rolling": P3_ROLLING_SQL, "p4_schema": P4_SCHEMA_SQL, "p5_found": P5_FOUND_SQL, "p5_messages": P5_MESSAGES_SQL}

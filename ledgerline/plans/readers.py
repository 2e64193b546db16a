"""Queries that write the test tables out as raw logs and read them back, with their SQL over the tables themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..functions.formats import humanized
from ..operators import fleet, ordered
from ..schema import TOKEN_FIELDS
from ..session import fresh_folder, table
from ..sources import dailies, logs
from .problems import stamp_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


_SUMS = [f"CAST(sum({f}) AS BIGINT) AS {f}" for f in TOKEN_FIELDS]


def _summed(calls: DataFrame, *by: str) -> DataFrame:
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), *[F.sum(f).alias(f) for f in TOKEN_FIELDS])


def _log(rows: DataFrame, spark: SparkSession, *order: str) -> str:
    """Writes rows as JSON lines, in this order over all files."""
    out = fresh_folder(spark, "log")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.json(out)
    _renamed(spark, out)
    return out


def _renamed(spark: SparkSession, folder: str, ending: str = ".json") -> None:
    """Spark names files ``.json`` or ``.txt``; logs of lines are ``.jsonl``."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(path(folder)):
        name = f.getPath().getName()
        if name.endswith(ending):
            fs.rename(f.getPath(), path(folder, name.removesuffix(ending) + ".jsonl"))


_READ = f"""e AS (SELECT row_id, coalesce(nullif(requestId, ''), nullif(uuid, '')) AS k, coalesce(nullif(message.model, ''), 'unknown') AS model, CAST({stamp_sql('"timestamp"')} AS DATE) AS d,
  coalesce(message.usage.input_tokens, 0) AS input_tokens, coalesce(message.usage.output_tokens, 0) AS output_tokens, coalesce(message.usage.cache_creation_input_tokens, 0) AS cache_creation, coalesce(message.usage.cache_read_input_tokens, 0) AS cache_read, 0 AS reasoning
  FROM transcripts WHERE coalesce(message.usage.input_tokens, message.usage.output_tokens, message.usage.cache_creation_input_tokens, message.usage.cache_read_input_tokens) IS NOT NULL),
 f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY row_id) AS nth FROM e WHERE d IS NOT NULL)"""


@query(f"WITH {_READ} SELECT strftime(d, '%Y-%m-%d') AS day, model, count(*) AS calls, {', '.join(_SUMS)} FROM f WHERE k IS NULL OR nth = 1 GROUP BY 1, 2")
def q_read_transcripts(spark, folder):
    """The transcripts as logs of lines: each request counts once, its first line by file and place."""
    out = _log(table(spark, folder, "transcripts"), spark, "row_id")
    return _summed(logs.transcripts(spark, out).withColumn("day", times.day_text(F.col("timestamp"))), "day", "model")


@query("""WITH l AS (SELECT 'Fleet:' || coalesce(nullif(provider, ''), 'Fleet') AS source, coalesce(nullif(model, ''), 'unknown') AS model, coalesce(input_tokens, 0) AS input_tokens, coalesce(output_tokens, 0) AS output_tokens, 0 AS cache_creation,
  coalesce(cached_tokens, 0) AS cache_read, coalesce(reasoning_tokens, 0) AS reasoning FROM fleet_usage WHERE coalesce(input_tokens, output_tokens) IS NOT NULL AND """ + stamp_sql('"timestamp"') + f""" IS NOT NULL)
SELECT source, model, count(*) AS calls, {', '.join(_SUMS)} FROM l GROUP BY 1, 2""")
def q_read_ledger(spark, folder):
    """The ledger appended to as JSON lines in two goes, and read back; repeated rows all count."""
    out = fresh_folder(spark, "ledger")
    rows = table(spark, folder, "fleet_usage")
    half = F.pmod(F.xxhash64("timestamp", "provider", "model"), F.lit(2)) == 0
    for part in (rows.filter(half), rows.filter(~half)):
        logs.append(part, out)
    return _summed(logs.ledger(spark, out), "source", "model")


@query(f"""WITH l AS (SELECT strftime("timestamp" AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, greatest(coalesce(input_tokens, 0), 0) AS input_tokens, coalesce(output_tokens, 0) AS output_tokens, 0 AS cache_creation, coalesce(cache_read, 0) AS cache_read, coalesce(reasoning, 0) AS reasoning FROM invocations WHERE "timestamp" IS NOT NULL)
SELECT day, 'thread' AS model, count(*) AS calls, {', '.join(_SUMS)} FROM l GROUP BY 1""")
def q_read_rollouts(spark, folder):
    """The calls as event logs of threads: the thread names the model, cached input is part of the input there."""
    z = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    usage = F.struct((z("input_tokens") + z("cache_read")).alias("input_tokens"), z("output_tokens").alias("output_tokens"), z("cache_read").alias("cached_input_tokens"), z("reasoning").alias("reasoning_output_tokens"))
    event = F.struct(F.lit("token_count").alias("type"), F.struct(usage.alias("last_token_usage")).alias("info"))
    i = table(spark, folder, "invocations").filter("timestamp is not null")
    out = _log(i.select(F.lit("event_msg").alias("type"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), event.alias("payload")), spark, "timestamp")
    threads = spark.read.text(out).select(F.lit("thread").alias("model"), F.col("_metadata.file_path").alias("rollout_path")).distinct()
    return _summed(logs.rollouts(spark, threads, out).withColumn("day", times.day_text(F.col("timestamp"))), "day", "model")


@query("SELECT coalesce(machine, '__HIVE_DEFAULT_PARTITION__') AS machine, count(*) AS steps, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM documents GROUP BY 1")
def q_read_steps(spark, folder):
    """The documents as steps of agents, a folder of lines per machine, as many files as it takes."""
    out = fresh_folder(spark, "steps")
    d = table(spark, folder, "documents").select("machine", F.col("text").alias("content"), F.lit("USER").alias("source"), F.lit("TEXT").alias("type"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), "doc_id")
    d.repartitionByRange("machine", "doc_id").sortWithinPartitions("machine", "doc_id").write.partitionBy("machine").json(out)
    s = logs.steps(spark, [out], glob="*.json")
    return s.groupBy(F.substring_index("conversation", "=", -1).alias("machine")).agg(F.count(F.lit(1)).alias("steps"), F.sum("chars").alias("chars"))


@query("""SELECT coalesce(role, '') AS role, count(*) AS messages, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM (SELECT text, CASE WHEN doc_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role FROM documents) GROUP BY 1""")
def q_read_sessions(spark, folder):
    """The documents as messages of chat sessions, one a line, in each of the shapes that content takes."""
    text, n = F.coalesce("text", F.lit("")), F.col("doc_id") % 3
    content = F.when(n == 0, F.to_json(F.struct(text.alias("x")))).when(n == 1, F.to_json(F.struct(F.struct(text.alias("text")).alias("x")))).otherwise(F.to_json(F.struct(F.array(F.struct(text.alias("text"))).alias("x"))))
    kind = F.when(F.col("doc_id") % 2 == 0, "user").otherwise("gemini")
    line = F.concat(F.lit('{"id":"m'), F.col("doc_id").cast("string"), F.lit('","type":"'), kind, F.lit('","content":'), F.expr("substring(c, 6, length(c) - 6)"), F.lit("}"))
    out = fresh_folder(spark, "sessions")
    table(spark, folder, "documents").withColumn("c", content).select(line.alias("value")).write.text(out)
    _renamed(spark, out, ".txt")
    m = logs.sessions(spark, out)
    return m.groupBy("role").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.length("text").cast("long")).alias("chars"))


@query(f"""SELECT CASE WHEN coalesce(model, '') = '' THEN 'unknown' ELSE model END AS model, count(DISTINCT strftime("timestamp" AT TIME ZONE 'UTC', '%Y-%m-%d')) AS calls, {', '.join(f'CAST(sum(coalesce({f}, 0)) AS BIGINT) AS {f}' for f in TOKEN_FIELDS)} FROM invocations WHERE "timestamp" IS NOT NULL GROUP BY 1""")
def q_read_snapshots(spark, folder):
    """Sums by model and day as saved answers of a service, a file per model with an entry per day."""
    z = {f: F.sum(F.coalesce(f, F.lit(0))).alias(f) for f in TOKEN_FIELDS}
    sums = table(spark, folder, "invocations").filter("timestamp is not null").groupBy(F.coalesce("model", F.lit("")).alias("model"), times.day_text(F.col("timestamp")).alias("day")).agg(*z.values())
    usage = F.struct(F.col("input_tokens").alias("inputTokens"), F.col("output_tokens").alias("outputTokens"), F.col("cache_creation").alias("cacheWriteTokens"), F.col("cache_read").alias("cacheReadTokens"), F.col("reasoning").alias("thinkingTokens"))
    chat = F.struct(F.when(F.col("model") != "", F.concat(F.lit("models/"), "model")).alias("model"), F.struct(F.concat("day", F.lit("T00:00:00Z")).alias("createdAt")).alias("chatStartMetadata"), usage.alias("usage"))
    # as many entries to a file as days
    files = sums.groupBy("model").agg(F.collect_list(F.struct(chat.alias("chatModel"))).alias("generatorMetadata"))
    out = fresh_folder(spark, "snapshots")
    files.withColumn("m", F.col("model")).select("m", "generatorMetadata").repartition("m").write.partitionBy("m").json(out)
    return _summed(logs.snapshots(spark, out), "model")


@query("SELECT count(*) AS docs, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, count(*) FILTER (coalesce(text, '') = '') AS empty FROM documents")
def q_read_documents(spark, folder):
    """The documents as JSON lines; a line without the field is an empty text."""
    out = fresh_folder(spark, "documents")
    # an object without fields would be left out as a line
    table(spark, folder, "documents").select("doc_id", "text").write.json(out)
    d = logs.documents(spark, out)
    return d.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text").cast("long")).alias("chars"), F.count(F.when(F.col("text") == "", 1)).alias("empty"))


_DAYS = """SELECT machine, count(*) AS records, CAST(sum(n) AS BIGINT) AS invocations FROM (SELECT machine, strftime("timestamp" AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n FROM invocations WHERE "timestamp" IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""


def _exported(spark, folder) -> str:
    out = fresh_folder(spark, "dailies-export")
    dailies.export(fleet.daily_records(table(spark, folder, "invocations")), out, counter="v1")
    return out


@query(_DAYS)
def q_load_files(spark, folder):
    """Exported records read as one file each."""
    f = dailies.load_files(spark, f"{_exported(spark, folder)}/*/*/*.json")
    # the folders of the export say machine and date
    machine = F.url_decode(F.regexp_extract("file_path", "/machine=([^/]*)/", 1))
    return f.groupBy(machine.alias("machine")).agg(F.count(F.lit(1)).alias("records"), F.sum("invocations").alias("invocations"))


@query("""SELECT DISTINCT machine FROM invocations WHERE "timestamp" IS NOT NULL""")
def q_known_machines(spark, folder):
    return dailies.known_machines(spark, _exported(spark, folder))


@query("""SELECT machine, max_by(CAST(input_tokens AS VARCHAR) || ' ' || CAST(output_tokens AS VARCHAR), row_id) AS usage FROM (SELECT row_id, machine, coalesce(message.usage.input_tokens, -1) AS input_tokens, coalesce(message.usage.output_tokens, -1) AS output_tokens FROM transcripts
 WHERE coalesce(message.usage.input_tokens, message.usage.output_tokens, message.usage.cache_creation_input_tokens, message.usage.cache_read_input_tokens) IS NOT NULL) GROUP BY 1""")
def q_last_usage(spark, folder):
    """The usage in the last line that has any, by machine; lines that are no JSON lie between."""
    t = table(spark, folder, "transcripts").select("machine", "row_id", F.coalesce(F.to_json(F.col("message")), F.lit("noise {")).alias("line"))
    u = logs.last_usage(t, "machine", "line", "row_id").withColumn("u", F.try_parse_json("usage"))
    n = lambda k: F.coalesce(F.try_variant_get("u", f"$.{k}", "bigint"), F.lit(-1)).cast("string")
    return u.select("machine", F.concat_ws(" ", n("input_tokens"), n("output_tokens")).alias("usage"))


@query("""WITH m AS (SELECT DISTINCT model FROM invocations), x AS (SELECT unnest([model, 'models/' || model, 'MODEL_PLACEHOLDER_' || model]) AS id FROM m)
SELECT DISTINCT id, CASE WHEN coalesce(id, '') = '' THEN 'unknown' WHEN starts_with(id, 'MODEL_PLACEHOLDER_') THEN 'gemini-' || lower(split_part(id, '_', -1)) WHEN regexp_replace(id, '^models/', '') = 'sable-4-mini' THEN 'small' ELSE regexp_replace(id, '^models/', '') END AS model FROM x""")
def q_resolved_models(spark, folder):
    """Ids of models with prefixes, placeholders and one alias."""
    m = table(spark, folder, "invocations").select("model").distinct()
    ids = m.select(F.explode(F.array(F.col("model"), F.concat(F.lit("models/"), "model"), F.concat(F.lit("MODEL_PLACEHOLDER_"), "model"))).alias("id")).distinct()
    return ids.select("id", logs.resolved_model(F.col("id"), {"sable-4-mini": "small"}).alias("model"))


@query("""WITH x AS (SELECT model, coalesce(output_tokens, 0) AS o, coalesce(reasoning, 0) AS t FROM invocations)
SELECT model, CAST(sum(CASE WHEN t > 0 AND t <= o THEN o - t ELSE o END) AS BIGINT) AS output, CAST(sum(CASE WHEN t > 0 AND t <= o THEN t ELSE 0 END) AS BIGINT) AS reasoning FROM x GROUP BY 1""")
def q_split_thinking(spark, folder):
    z = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    s = table(spark, folder, "invocations").select("model", ordered.split_thinking(z("output_tokens"), z("reasoning")).alias("s"))
    return s.groupBy("model").agg(F.sum("s.output").alias("output"), F.sum("s.reasoning").alias("reasoning"))


@query("""WITH x AS (SELECT model, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS n FROM invocations GROUP BY 1)
SELECT model, n, CASE WHEN n >= 1000000000 THEN format('{:.2f}B', n / 1e9) WHEN n >= 1000000 THEN format('{:.2f}M', n / 1e6) WHEN n >= 1000 THEN format('{:.1f}K', n / 1e3) ELSE CAST(n AS VARCHAR) END AS text FROM x""")
def q_humanized(spark, folder):
    s = table(spark, folder, "invocations").groupBy("model").agg(F.sum(F.coalesce("input_tokens", F.lit(0))).alias("n"))
    return s.select("model", "n", humanized(F.col("n")).alias("text"))

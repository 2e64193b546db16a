"""Readers of raw agent logs into the invocation schema.

Lines are read as text, so one bad line costs that line and no more; JSON is parsed on the JVM into
VARIANT and every field is taken with a try, whatever its type. Files of lines are read split by split and
their lines ordered by split and place; only files that are one JSON document are read whole.

Defined cases: blank and malformed lines are skipped (for sessions, see there); a missing or empty usage
has no row; counts that are missing or no integers are 0; an unreadable stamp is null and in no window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import times
from ..operators import ordered
from ..schema import LEDGER

_STAMPS = ("timestamp", "created_at", "startTime", "start_time")


def placed_lines(spark: SparkSession, path: str, glob: str | None = None, keep: Column | None = None) -> DataFrame:
    """(file, block, mid, line): every line; (file, block, mid) orders the lines of a file.

    A file is read in as many blocks as it has splits, whatever its size. ``mid`` goes up by one per line within a block; it is
    the same in every scan of the same files. ``keep`` is a condition on ``_metadata`` and drops whole files.
    """
    raw = spark.read.option("lineSep", "\n").text(path, recursiveFileLookup=True, pathGlobFilter=glob)
    raw = raw if keep is None else raw.filter(keep)
    line = F.when(F.endswith("value", F.lit("\r")), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"), line.alias("line"))


def lines(spark: SparkSession, path: str, glob: str | None = None, keep: Column | None = None) -> DataFrame:
    """(file, nth, line, v): every line that is not blank, with its number in the file from 0; v is its JSON or null.

    Lines are numbered within blocks, and blocks by how many lines stand before them: one row per split, which is
    no more than the driver holds to plan the scan, so it is broadcast.
    """
    raw = placed_lines(spark, path, glob, keep)
    blocks = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", "first", before.alias("before"))
    d = raw.join(F.broadcast(starts), ["file", "block"]).select("file", (F.col("before") + F.col("mid") - F.col("first")).cast("int").alias("nth"), "line")
    return d.filter(F.trim("line") != "").withColumn("v", F.try_parse_json("line"))


def text_of(v: Column | str, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def long_of(v: Column | str, *paths: str) -> Column:
    """The first that is there and not 0, else 0."""
    return F.coalesce(*[F.nullif(F.try_variant_get(v, p, "bigint"), F.lit(0).cast("long")) for p in paths], F.lit(0).cast("long"))


def stamp_of(v: Column | str) -> Column:
    """The first of the usual fields that is not empty, as an instant."""
    return times.instant(F.coalesce(*[F.nullif(text_of(v, f"$.{s}"), F.lit("")) for s in _STAMPS]))


def is_object(v: Column) -> Column:
    """A JSON object with at least one field."""
    s = F.schema_of_variant(v)
    return v.isNotNull() & F.startswith(s, F.lit("OBJECT<")) & (s != "OBJECT<>")


def _between(at: Column, lower, upper) -> Column:
    keep = at.isNotNull()
    if lower is not None:
        keep &= at >= F.lit(lower).cast("timestamp")
    if upper is not None:
        keep &= at <= F.lit(upper).cast("timestamp")
    return keep


def transcripts(spark: SparkSession, path: str, lower=None, upper=None) -> DataFrame:
    """Request transcripts, ``**/*.jsonl``: one row per request, the first by file and line; rows without any id all count.

    The window is applied before repeats are told.
    """
    d = placed_lines(spark, path, "*.jsonl").withColumn("v", F.try_parse_json("line"))
    usage = F.coalesce(*[F.when(is_object(F.try_variant_get("v", p, "variant")), F.try_variant_get("v", p, "variant")) for p in ("$.message.usage", "$.usage")])
    d = d.withColumn("at", stamp_of("v")).filter(_between(F.col("at"), lower, upper)).withColumn("u", usage).filter("u is not null")
    key = F.coalesce(*[F.nullif(text_of("v", f"$.{k}"), F.lit("")) for k in ("requestId", "request_id", "uuid")])
    parent = F.url_decode(F.element_at(F.split("file", "/"), -2))
    rows = d.select(
        F.col("at").alias("timestamp"), F.lit("Transcripts").alias("source"), F.coalesce(*[F.nullif(text_of("v", p), F.lit("")) for p in ("$.message.model", "$.model")], F.lit("unknown")).alias("model"),
        long_of("u", "$.input_tokens").alias("input_tokens"), long_of("u", "$.output_tokens").alias("output_tokens"), long_of("u", "$.cache_creation_input_tokens").alias("cache_creation"), long_of("u", "$.cache_read_input_tokens").alias("cache_read"),
        long_of("u", "$.reasoning_tokens").alias("reasoning"), F.lit(True).alias("exact"), F.coalesce(F.nullif(text_of("v", "$.project_name"), F.lit("")), parent).alias("session_id"), F.col("file").alias("source_file"), key.alias("_key"),
        F.struct("file", "block", "mid").alias("_order"),
    )
    return ordered.first_wins(rows, F.col("_key"), "_order").drop("_key", "_order")


def snapshots(spark: SparkSession, path: str, lower=None, upper=None) -> DataFrame:
    """Saved answers of a local service, one JSON object a file: ``generatorMetadata[].chatModel`` with its usage under any of several names."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    m = whole.select("file", F.explode(F.try_variant_get("v", "$.generatorMetadata", "array<variant>")).alias("g")).select("file", F.try_variant_get("g", "$.chatModel", "variant").alias("c"))
    m = m.withColumn("at", times.instant(text_of("c", "$.chatStartMetadata.createdAt"))).withColumn("u", F.try_variant_get("c", "$.usage", "variant")).filter(is_object(F.col("u")) & _between(F.col("at"), lower, upper))
    return m.select(
        F.col("at").alias("timestamp"), F.lit("Snapshots").alias("source"), resolved_model(text_of("c", "$.model")).alias("model"), long_of("u", "$.inputTokens", "$.input_tokens").alias("input_tokens"), long_of("u", "$.outputTokens", "$.output_tokens").alias("output_tokens"),
        long_of("u", "$.cacheWriteTokens", "$.cache_creation").alias("cache_creation"), long_of("u", "$.cacheReadTokens", "$.cache_read").alias("cache_read"), long_of("u", "$.thinkingOutputTokens", "$.thinkingTokens", "$.reasoning").alias("reasoning"),
        F.lit(True).alias("exact"), F.regexp_extract("file", r"([^/]*?)(\.json)?$", 1).alias("session_id"), F.col("file").alias("source_file"),
    )


def resolved_model(id: Column, known: dict[str, str] | None = None) -> Column:
    """A model id without ``models/``, by its alias if it has one; ``MODEL_PLACEHOLDER_X`` is gemini-x; nothing is unknown."""
    m = F.regexp_replace(id, "^models/", "")
    alias = F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), m) if known else F.lit(None).cast("string")
    placeholder = F.when(F.startswith(m, F.lit("MODEL_PLACEHOLDER_")), F.concat(F.lit("gemini-"), F.lower(F.substring_index(m, "_", -1))))
    return F.when(F.coalesce(id, F.lit("")) == "", "unknown").otherwise(F.coalesce(alias, placeholder, m))


def native_total(threads: DataFrame, lower: int, upper: int) -> DataFrame:
    """One row: threads updated in (lower, upper] seconds, and the tokens they say they used."""
    return threads.filter((F.col("updated_at") > lower) & (F.col("updated_at") <= upper)).agg(F.count(F.lit(1)).alias("threads"), F.coalesce(F.sum("tokens_used"), F.lit(0).cast("long")).alias("tokens"))


def rollouts(spark: SparkSession, threads: DataFrame, path: str, lower=None, upper=None) -> DataFrame:
    """Token counts of threads (model, rollout_path, updated_at) from their event logs; the model is the thread's, nothing is deduplicated.

    Cached input is part of the input there, and is taken out of it.
    """
    d = placed_lines(spark, path, "*.jsonl").withColumn("v", F.try_parse_json("line")).filter((text_of("v", "$.type") == "event_msg") & (text_of("v", "$.payload.type") == "token_count"))
    d = d.withColumn("u", F.try_variant_get("v", "$.payload.info.last_token_usage", "variant")).withColumn("at", stamp_of("v")).filter(is_object(F.col("u")) & _between(F.col("at"), lower, upper))
    t = threads.filter("rollout_path is not null").select(F.col("model").alias("_model"), F.regexp_replace("rollout_path", "^file:/*", "/").alias("_path"))
    j = d.join(t, F.regexp_replace(F.url_decode("file"), "^file:/*", "/") == F.col("_path"))
    cached = long_of("u", "$.cached_input_tokens")
    return j.select(
        F.col("at").alias("timestamp"), F.lit("Rollouts").alias("source"), F.coalesce("_model", F.lit("unknown")).alias("model"), F.greatest(F.lit(0).cast("long"), long_of("u", "$.input_tokens") - cached).alias("input_tokens"), long_of("u", "$.output_tokens").alias("output_tokens"),
        F.lit(0).cast("long").alias("cache_creation"), cached.alias("cache_read"), long_of("u", "$.reasoning_output_tokens").alias("reasoning"), F.lit(True).alias("exact"), F.regexp_extract("file", r"([^/]*)\.jsonl$", 1).alias("session_id"), F.col("file").alias("source_file"),
    )


def ledger(spark: SparkSession, path: str, lower=None, upper=None) -> DataFrame:
    """The append-only usage ledger, JSON lines; nothing is deduplicated."""
    return ledger_invocations(spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(path), lower, upper)


def ledger_invocations(rows: DataFrame, lower=None, upper=None) -> DataFrame:
    """Ledger rows, of a batch or a stream, as invocations of the source ``Fleet:<provider>``."""
    d = rows.withColumn("at", times.instant(F.col("timestamp"))).filter(_between(F.col("at"), lower, upper))
    zero = F.lit(0).cast("long")
    return d.select(
        F.col("at").alias("timestamp"), F.concat(F.lit("Fleet:"), F.coalesce(F.nullif(F.col("provider"), F.lit("")), F.lit("Fleet"))).alias("source"), F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit("unknown")).alias("model"), F.coalesce("input_tokens", zero).alias("input_tokens"),
        F.coalesce("output_tokens", zero).alias("output_tokens"), zero.alias("cache_creation"), F.coalesce("cached_tokens", zero).alias("cache_read"), F.coalesce("reasoning_tokens", zero).alias("reasoning"), F.lit(True).alias("exact"),
        F.coalesce(F.nullif(F.col("lane"), F.lit("")), F.lit("fleet")).alias("session_id"), F.lit(None).cast("string").alias("source_file"),
    )


def content_text(v: Column) -> Column:
    """The text of a message: a string is itself, an object its text or content, a list those of its items one after the other, anything else its JSON."""
    one = lambda x: F.coalesce(F.when(F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), F.coalesce(F.nullif(text_of(x, "$.text"), F.lit("")), text_of(x, "$.content"), F.lit(""))), F.try_variant_get(x, "$", "string"))
    many = F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), one), "")
    return F.when(v.isNull(), F.lit("")).when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), many).otherwise(one(v))


def last_usage(answers: DataFrame, key: str, line: str, order: str) -> DataFrame:
    """(key, usage): of the lines an agent printed, the usage in the last one that is JSON and has any."""
    d = answers.withColumn("_v", F.try_parse_json(line)).withColumn("_u", F.try_variant_get("_v", "$.usage", "variant")).filter(is_object(F.col("_u")))
    return d.groupBy(key).agg(F.max_by(F.to_json("_u"), order).alias("usage"))


def sessions(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Messages of chat sessions, ``session-YYYY-MM-DD*.json`` (messages[] in one object) or ``.jsonl`` (one a line).

    Files whose name says a day more than one outside the given days are not opened. A file with any malformed line is passed over whole. A message that comes again under its id takes the
    last values at the first place; messages are ordered by stamp, those without first, then by place.
    Columns: file, id, nth, at, role, text, thoughts (characters), model, tokens (input, output, cached, thoughts; null if not measured).
    """
    named = F.regexp_extract(F.col("_metadata.file_name"), r"session-([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    keep = F.lit(True)
    if first_day:
        keep &= (named == "") | (named >= F.date_sub(F.lit(first_day).cast("date"), 1).cast("string"))
    if last_day:
        keep &= (named == "") | (named <= F.date_add(F.lit(last_day).cast("date"), 1).cast("string"))
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").filter(keep).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    d = whole.select("file", F.posexplode(F.try_variant_get("v", "$.messages", "array<variant>")).alias("nth", "v"))
    one_a_line = lines(spark, path, "*.jsonl", keep)
    # a few names of files
    bad = one_a_line.filter("v is null").select("file").distinct()
    d = d.unionByName(one_a_line.join(bad, "file", "left_anti").select("file", "nth", "v")).withColumn("id", F.nullif(text_of("v", "$.id"), F.lit("")))
    named = d.filter("id is not null")
    last = named.groupBy("file", "id").agg(F.min("nth").alias("nth"), F.max_by(F.to_json("v"), "nth").alias("j")).select("file", "id", "nth", F.parse_json("j").alias("v"))
    m = last.unionByName(d.filter("id is null").select("file", "id", "nth", "v"))
    role = F.coalesce(F.nullif(text_of("v", "$.type"), F.lit("")), text_of("v", "$.role"))
    content = F.coalesce(F.try_variant_get("v", "$.content", "variant"), F.try_variant_get("v", "$.text", "variant"))
    tok = F.try_variant_get("v", "$.tokens", "variant")
    tokens = F.when(is_object(tok), F.struct(*[long_of(tok, f"$.{k}").alias(k) for k in ("input", "output", "cached", "thoughts")]))
    thoughts = F.coalesce(F.length(text_of("v", "$.thoughts")), F.length(F.to_json(F.try_variant_get("v", "$.thoughts", "variant"))), F.lit(0))
    return m.select("file", "id", "nth", stamp_of("v").alias("at"), F.when(role.isin("gemini", "assistant", "model"), "assistant").when(role == "user", "user").otherwise(F.coalesce(role, F.lit(""))).alias("role"), content_text(content).alias("text"), thoughts.cast("long").alias("thoughts"), F.nullif(text_of("v", "$.model"), F.lit("")).alias("model"), tokens.alias("tokens"))


def session_calls(messages: DataFrame, lower=None, upper=None, default: str = "unknown") -> DataFrame:
    """Calls of sessions: measured where tokens were recorded, estimated from the text before them elsewhere.

    Messages outside the window add to the context too. The model is the last one named, else the session's first.
    """
    zero = F.lit(0).cast("long")
    size = F.when(F.col("role") == "user", F.length("text")).when(F.col("role") == "assistant", F.length("text") + F.col("thoughts")).otherwise(0).cast("long")
    m = messages.withColumns({"adds": size, "when_us": F.coalesce(F.unix_micros("at"), zero), "out_n": F.length("text").cast("long")}).withColumn("chunk", F.floor(F.col("when_us") / F.lit(86_400_000_000)))
    first = m.filter("model is not null").groupBy("file").agg(F.min_by("model", F.struct("when_us", "nth")).alias("seed"))
    order = ["when_us", "nth"]
    calls = ordered.estimated_calls(m, "file", "chunk", order, "adds", (F.col("role") == "assistant") & _between(F.col("at"), lower, upper), own=False)
    calls = ordered.forward_fill(calls, "file", "chunk", order, "model", "", "named").join(first, "file", "left")
    t = lambda k, e: F.when(F.col("tokens").isNotNull(), F.col(f"tokens.{k}")).otherwise(e)
    fresh = F.greatest(zero, F.col("tokens.input") - F.col("tokens.cached"))
    return calls.select(
        F.col("at").alias("timestamp"), F.lit("Sessions").alias("source"), F.coalesce(F.nullif("named", F.lit("")), "seed", F.lit(default)).alias("model"), F.when(F.col("tokens").isNotNull(), fresh).otherwise(F.col("input_tokens")).alias("input_tokens"),
        t("output", F.greatest(F.lit(1).cast("long"), ordered.tokens_of(F.col("out_n")))).alias("output_tokens"), zero.alias("cache_creation"), t("cached", F.col("cache_read")).alias("cache_read"), t("thoughts", ordered.tokens_of(F.col("thoughts"))).alias("reasoning"),
        F.col("tokens").isNotNull().alias("exact"), F.regexp_extract("file", r"([^/]*)\.jsonl?$", 1).alias("session_id"), F.col("file").alias("source_file"),
    )


#: The sentence in which an agent says that its model was changed (a fixed value).
MODEL_CHANGE = r"<USER_SETTINGS_CHANGE>\s*The user changed setting `Model Selection` from .*? to (.*?)(?:\.\s|\.$|$)"


def chosen_model(text: Column, known: Sequence[tuple[str, str]] = ()) -> Column:
    """The model that a step's text says was chosen, else null: up to a full stop at the end or before white space, so ``3.5`` stays whole.

    ``known`` are (part of the name in lower case, model): the first part found in the name gives the model; any other name is kept as it is.
    """
    name = F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), MODEL_CHANGE, 1)), F.lit(""))
    out = name
    for part, model in reversed(known):
        out = F.when(F.contains(F.lower(name), F.lit(part)), F.lit(model)).otherwise(out)
    return out


def steps(spark: SparkSession, paths: list[str], live: DataFrame | None = None, known: Sequence[tuple[str, str]] = (), glob: str = "transcript.jsonl") -> DataFrame:
    """Steps of agent transcripts (``transcript.jsonl`` in a folder per conversation), the first of several folders winning.

    Columns: conversation, nth, at, source, type, chars (content, thinking and tool calls as JSON), chosen (a model
    named in a settings change, by ``known`` as in ``chosen_model``). ``live`` (conversation) are those already measured; they are left out.
    """
    out = None
    for rank, p in enumerate(paths):
        d = lines(spark, p, glob).select(F.lit(rank).alias("rank"), F.url_decode(F.element_at(F.split("file", "/"), -2)).alias("conversation"), "nth", "v")
        out = d if out is None else out.unionByName(d)
    size = lambda p: F.coalesce(F.length(text_of("v", p)), F.length(F.to_json(F.try_variant_get("v", p, "variant"))), F.lit(0))
    d = out.filter("v is not null").select("rank", "conversation", "nth", stamp_of("v").alias("at"), text_of("v", "$.source").alias("source"), text_of("v", "$.type").alias("type"), (size("$.content") + size("$.thinking") + size("$.tool_calls")).cast("long").alias("chars"), chosen_model(text_of("v", "$.content"), known).alias("chosen"))
    if live is not None:
        d = d.join(live.select("conversation").distinct(), "conversation", "left_anti")
    first = d.groupBy("conversation", "nth").agg(F.min("rank").alias("rank"))
    return d.join(first, ["conversation", "nth", "rank"]).drop("rank")


def step_calls(rows: DataFrame, lower=None, upper=None, default: str = "unknown") -> DataFrame:
    """Planner answers with estimated tokens. The model chosen is carried over all steps; only steps in the window add characters."""
    zero = F.lit(0).cast("long")
    s = rows.withColumn("chunk", F.floor(F.col("nth") / F.lit(10_000)))
    s = ordered.forward_fill(s, "conversation", "chunk", ["nth"], "chosen", default, "model").filter(_between(F.col("at"), lower, upper))
    c = ordered.estimated_calls(s, "conversation", "chunk", ["nth"], "chars", (F.col("source") == "MODEL") & (F.col("type") == "PLANNER_RESPONSE"), own=True)
    return c.select(F.col("at").alias("timestamp"), F.lit("Steps").alias("source"), F.concat("model", F.lit(" (estimated)")).alias("model"), "input_tokens", "output_tokens", zero.alias("cache_creation"), "cache_read", zero.alias("reasoning"), F.lit(False).alias("exact"), F.col("conversation").alias("session_id"), F.lit(None).cast("string").alias("source_file"))


def documents(spark: SparkSession, path: str, field: str = "text", kind: str = "jsonl", limit: int | None = None) -> DataFrame:
    """(text, coerced) of a JSONL, text or Parquet file. A malformed JSON line is the document itself; what is no string becomes its text, and null ``None``."""
    if kind == "parquet":
        d = spark.read.parquet(path).select(F.col(field).cast("string").alias("text"))
        d = d.select(F.coalesce("text", F.lit("None")).alias("text"), F.col("text").isNull().alias("coerced"))
    elif kind == "text":
        d = spark.read.text(path).select(F.col("value").alias("text"), F.lit(False).alias("coerced"))
    elif kind == "jsonl":
        r = spark.read.text(path).filter(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
        x = F.try_variant_get("v", f"$.{field}", "variant")
        is_text = F.schema_of_variant(x) == "STRING"
        there = F.when(F.schema_of_variant(x) == "VOID", F.lit("None")).otherwise(F.coalesce(text_of("v", f"$.{field}"), F.to_json(x), F.lit("")))
        d = r.select(F.when(F.col("v").isNull(), F.col("value")).otherwise(there).alias("text"), (F.col("v").isNotNull() & x.isNotNull() & ~is_text).alias("coerced"))
    else:
        raise ValueError(f"unknown kind of file: {kind}")
    return d.limit(limit) if limit else d


def append(rows: DataFrame, path: str) -> None:
    """Appends ledger rows as JSON lines; counts that are no integers become 0. Rows with neither count are left out."""
    zero = F.lit(0).cast("long")
    have = [c for c in ("input_tokens", "output_tokens") if c in rows.columns]
    kept = rows.filter(F.coalesce(*[F.col(c).cast("string") for c in have]).isNotNull())
    cols = [F.coalesce(F.col(f.name).try_cast("long"), zero).alias(f.name) if f.name.endswith("_tokens") else F.col(f.name).cast("string").alias(f.name) for f in LEDGER.fields if f.name in rows.columns]
    kept.select(*cols).write.mode("append").json(path)


__all__ = ["append", "chosen_model", "content_text", "documents", "last_usage", "ledger", "ledger_invocations", "lines", "native_total", "placed_lines", "resolved_model", "rollouts", "session_calls", "sessions", "snapshots", "step_calls", "steps", "transcripts"]

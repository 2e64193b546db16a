"""Field names and types of the invocation ledger."""

from pyspark.sql import types as T

#: The five disjoint, additive token fields of one call.
TOKEN_FIELDS = ("input_tokens", "output_tokens", "cache_creation", "cache_read", "reasoning")

TOKENS = T.StructType([T.StructField(f, T.LongType()) for f in TOKEN_FIELDS])

INVOCATION = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("model", T.StringType()),
        *TOKENS.fields,
        T.StructField("exact", T.BooleanType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("source_file", T.StringType()),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("lane", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("cached_tokens", T.LongType()),
        T.StructField("reasoning_tokens", T.LongType()),
        T.StructField("source", T.StringType()),
    ]
)

DAILY = T.StructType(
    [
        T.StructField("schema", T.IntegerType()),
        T.StructField("counter", T.StringType()),
        T.StructField("machine", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("partial", T.BooleanType()),
        T.StructField("generated_at", T.StringType()),
        T.StructField("generated_by", T.StringType()),
        T.StructField("invocations", T.LongType()),
        T.StructField("totals", TOKENS),
        T.StructField("exact", TOKENS),
        T.StructField("estimated", TOKENS),
        T.StructField("sketch", T.ArrayType(T.StringType())),
        T.StructField("sources", T.MapType(T.StringType(), TOKENS)),
        T.StructField("models", T.MapType(T.StringType(), TOKENS)),
    ]
)

#: The version of the daily record that is read; others are passed over.
SCHEMA_VERSION = 3

"""Messages delivered more than once, as a stream: the first delivery of each id is passed on.

The watermark runs on the time of arrival, not on the stamps inside the messages, so no message is ever too
late to be passed on; state holds the ids that arrived within the delay. A repeat that comes after the delay is
passed on again; ``operators.deliveries`` removes those from what was written. Of repeats within one batch,
which one is passed on is not defined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import filled
from ..session import fresh_folder
from .daily import file_stream


def first_deliveries(stream: DataFrame, id: Column, delay: str = "7 days") -> DataFrame:
    """Rows as they came, repeats of an id left out. Ids are trimmed; rows with a blank or null id all pass."""
    keyed = stream.withColumn("_id", filled(id)).withColumn("_arrived", F.current_timestamp())
    # a row without an id has a key of its own
    own = keyed.withColumn("_key", F.coalesce(F.concat(F.lit("i"), F.col("_id")), F.concat(F.lit("u"), F.uuid())))
    return own.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(["_key"]).drop("_id", "_key", "_arrived")


def replay(spark: SparkSession, path: str, id: Column, delay: str = "7 days") -> DataFrame:
    """A finished table run through the stream, to its end."""
    folder = fresh_folder(spark, "messages")
    rows = first_deliveries(file_stream(spark, path), id, delay)
    rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")

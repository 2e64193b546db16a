"""The append-only ledger as a stream: summed by day and provider, upserted.

The ledger has no id and repeated rows count, so every row counts as often as it comes, however late;
the stream keeps no state of rows. Sums of a batch go to a table of versions in the shared folder, one
per batch, so a batch that runs again after a failure replaces its own version and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, times
from ..session import fresh_folder


def prepared(stream: DataFrame) -> DataFrame:
    """Rows with a readable stamp: at, provider, tokens (null and negative counts are 0)."""
    at = times.instant(F.col("timestamp"))
    zero = F.lit(0).cast("long")
    n = lambda c: F.greatest(F.coalesce(F.col(c), zero), zero)
    return stream.select(at.alias("at"), names.provider(F.col("provider")).alias("provider"), (n("input_tokens") + n("output_tokens")).alias("tokens")).filter("at is not null")


def start(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None):
    """Runs the upsert; ``out`` gets one folder per batch with the sums of that batch."""

    def merge(batch: DataFrame, nth: int) -> None:
        sums = batch.groupBy(times.day_text(F.col("at")).alias("day"), "provider").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{out}/batch={nth}")

    return prepared(stream).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def totals(spark: SparkSession, out: str) -> DataFrame:
    """What stands after all batches."""
    s = spark.read.schema("day string, provider string, calls long, tokens long, batch long").parquet(out)
    return s.groupBy("day", "provider").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"))


def file_stream(spark: SparkSession, path: str, files_a_batch: int = 8) -> DataFrame:
    """A finished Parquet table, one file or a folder of them, as a stream of its files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    one_file = there.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(there).isFile()
    above, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(above) if one_file else reader.parquet(path)


def replay(spark: SparkSession, path: str) -> DataFrame:
    """A finished ledger run through the stream, to its end."""
    folder = fresh_folder(spark, "stream")
    start(file_stream(spark, path), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return totals(spark, f"{folder}/out")

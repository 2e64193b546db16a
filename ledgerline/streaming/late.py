"""Late and out-of-order records as a stream, in the order they arrive.

Each source has a low watermark: its greatest stamp so far less the lateness allowed; every record is a
punctuation. A period closes when the watermark of every source is beyond its end; a source that lags
the newest stamp of all by more than the idle timeout is idle and waited for no longer. What comes for a
period after its bound, or after it closed, is diverted and changes nothing.

State lies in the shared folder, a version per batch: watermarks (a row per source), standing values (a
row per source and open period, the closed ones leave), and the frontier (one number: as watermarks only rise, all
periods up to it are closed). A batch reads the version before its own and writes its own, so one that runs
again after a failure gives the same again.

Sources fall idle by event time alone: silence of all sources closes nothing. Watermarks move between batches,
not within one; where a batch ends therefore decides what an idle source may still bring in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.late import DAY, HOUR, diverted

_EMPTY = {
    "marks": "source string, high timestamp",
    "frontier": "low long",
}


class LateTotals:
    """Applies batches of (source, period date, stamp timestamp, value, order); see the module."""

    def __init__(self, spark: SparkSession, folder: str, value_type: str, lateness: int = 72 * HOUR, idle: int = 7 * DAY):
        self.spark, self.folder, self.lateness, self.idle = spark, folder, lateness, idle
        at = "struct<t:timestamp,o:long>"
        self.schemas = _EMPTY | {"standing": f"source string, period date, f {value_type}, f_at {at}, l {value_type}, l_at {at}, n long"}

    def _version(self, name: str, nth: int) -> DataFrame:
        schema = self.schemas[name]
        return self.spark.createDataFrame([], schema) if nth < 0 else self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/v={nth}")

    def merge(self, batch: DataFrame, nth: int) -> None:
        """For foreachBatch."""
        last = nth - 1
        marks, standing, frontier = (self._version(n, last) for n in ("marks", "standing", "frontier"))
        b = batch.filter("stamp is not null and period is not null")
        ends = (F.unix_date("period") + 1).cast("long") * F.lit(DAY)
        # one row beside the batch
        before = frontier.agg(F.max("low").alias("low"))
        told = b.join(F.broadcast(before), F.lit(True)).withColumn("late", diverted(F.col("stamp"), ends, self.lateness) | F.coalesce(F.col("low") - F.lit(self.lateness) > ends, F.lit(False)))
        told.filter("late").drop("low", "late").write.mode("overwrite").parquet(f"{self.folder}/diverted/v={nth}")

        at = F.struct(F.col("stamp").alias("t"), F.col("order").alias("o"))
        fresh = told.filter("not late").select("source", "period", F.col("value").alias("f"), at.alias("f_at"), F.col("value").alias("l"), at.alias("l_at"), F.lit(1).cast("long").alias("n"))
        w = lambda v, a, pick: pick(F.struct(F.col(v).alias("v")), a)["v"].alias(v)
        merged = standing.unionByName(fresh).groupBy("source", "period").agg(w("f", "f_at", F.min_by), F.min("f_at").alias("f_at"), w("l", "l_at", F.max_by), F.max("l_at").alias("l_at"), F.sum("n").alias("n"))
        high = marks.unionByName(b.groupBy("source").agg(F.max("stamp").alias("high"))).groupBy("source").agg(F.max("high").alias("high"))
        high.write.mode("overwrite").parquet(f"{self.folder}/marks/v={nth}")

        now = self._version("marks", nth).withColumn("us", F.unix_micros("high"))
        newest = now.agg(F.max("us").alias("newest"))
        # one row against the sources; then the least watermark of those that are not idle
        low = now.join(F.broadcast(newest), F.lit(True)).filter(F.col("us") >= F.col("newest") - F.lit(self.idle)).agg(F.min("us").alias("low"))
        low.unionByName(frontier).agg(F.max("low").alias("low")).write.mode("overwrite").parquet(f"{self.folder}/frontier/v={nth}")
        low = self._version("frontier", nth)
        both = merged.join(F.broadcast(low), F.lit(True)).withColumn("shut", F.col("low") - F.lit(self.lateness) > ends)
        both.write.mode("overwrite").parquet(f"{self.folder}/merged/v={nth}")
        both = self.spark.read.parquet(f"{self.folder}/merged/v={nth}")
        both.filter("shut").drop("shut").withColumnRenamed("low", "closed_by").write.mode("overwrite").parquet(f"{self.folder}/final/v={nth}")
        both.filter("not shut").drop("shut", "low").write.mode("overwrite").parquet(f"{self.folder}/standing/v={nth}")

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def final(self) -> DataFrame:
        """(source, period, f, l, ...) of closed periods: the first and the last value in time."""
        return self.spark.read.schema(self.schemas["standing"]).parquet(f"{self.folder}/final").drop("v")

    def open(self, nth: int) -> DataFrame:
        return self._version("standing", nth)

    def closed(self, nth: int) -> DataFrame:
        """(period, closed_by, batch): periods with anything in time that closed up to this batch, and the least watermark that closed them."""
        f = self.spark.read.schema(self.schemas["standing"] + ", closed_by long, v long").parquet(f"{self.folder}/final")
        return f.filter(F.col("v") <= nth).groupBy("period").agg(F.timestamp_micros(F.min("closed_by")).alias("closed_by"), F.min("v").alias("batch"))

    def diverted(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/diverted").drop("v")

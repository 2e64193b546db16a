"""Daily records as files: ``<folder>/machine=<machine>/date=<date>/``; exporting a day again replaces it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DAILY, SCHEMA_VERSION


def export(records: DataFrame, folder: str, counter: str | None, generated_by: str = "ledgerline") -> None:
    """Writes records (machine, day, ...) as JSON, one folder per machine and date; other days stay as they are.

    ``counter`` names the version of the counting that made them.
    """
    stamped = records.withColumns({"schema": F.lit(SCHEMA_VERSION), "counter": F.lit(counter).cast("string"), "generated_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"), "generated_by": F.lit(generated_by), "date": F.col("day")})
    ordered = stamped.select("schema", "counter", "machine", "date", "partial", "generated_at", "generated_by", "invocations", "totals", "exact", "estimated", "sketch", "sources", "models")
    # one task per machine and date at most writes one file each, whatever the shuffle gave
    ordered.repartition("machine", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("machine", "date").json(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the schema version, machine and date taken from the folders; unreadable lines and other versions are passed over."""
    raw = spark.read.schema(DAILY).option("mode", "DROPMALFORMED").json(folder)
    return raw.filter(F.col("schema") == SCHEMA_VERSION)


def load_files(spark: SparkSession, pattern: str, version: int | None = SCHEMA_VERSION, trust_field: bool = False) -> DataFrame:
    """Records of one file each, ``<machine>/<date>.json``. The folder names the machine, unless the field is trusted.

    Unreadable files and records that are no object are passed over, and those of another version too;
    with ``version=None`` any version counts, but machine and date have to be there.
    """
    whole = spark.read.text(pattern, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("file_path"))
    r = whole.select(F.from_json("value", DAILY).alias("r"), F.try_parse_json("value").alias("v"), "file_path")
    parent = F.element_at(F.split("file_path", "/"), -2)
    rows = r.filter(F.col("v").isNotNull() & F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))).select("r.*", "file_path")
    if not trust_field:
        rows = rows.withColumn("machine", F.url_decode(parent))
    if version is not None:
        return rows.filter(F.col("schema") == version)
    return rows.filter((F.coalesce("machine", F.lit("")) != "") & (F.coalesce("date", F.lit("")) != ""))


def known_machines(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the machines that have records in an export, sorted."""
    return load(spark, folder).select("machine").distinct().orderBy("machine")

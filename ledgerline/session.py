"""Session, table access and the shared folder for cut lineages."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(cores: str | int = "*", **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": os.environ.get("LEDGERLINE_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    } | extra
    spark = SparkSession.builder.master(f"local[{cores}]").appName("ledgerline").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors share.

    Taken from the session (``spark.checkpoint.dir``). Only a local session without one gets a
    folder of its own; on a cluster a missing setting is an error, as a folder of one machine
    would not outlive that machine.
    """
    jsc = spark.sparkContext._jsc.sc()
    now = jsc.getCheckpointDir()
    if now.isDefined():
        return now.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerline-")
    spark.sparkContext.setCheckpointDir(folder)
    return jsc.getCheckpointDir().get()


def _own_folder(spark: SparkSession) -> str:
    """The session's folder below the shared one; the JVM removes it when it ends."""
    folder = f"{shared_folder(spark)}/written"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return folder


def fresh_folder(spark: SparkSession, name: str = "table") -> str:
    """A folder in the shared one that no other call gets."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> None:
    """Removes what ``cut`` and others wrote so far; DataFrames that read it can no longer be run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/written")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes a DataFrame as Parquet to the shared folder and reads it from there on, columns pruned."""
    folder = fresh_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def literal(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few rows of the driver as a local relation, whose size the planner knows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema))


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Repartitions an input whose files give fewer splits than there are cores; larger inputs pass unshuffled.

    Told by the planned size and the list of files alone; no job runs for the answer.
    """
    spark = df.sparkSession
    least = least or spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(2 * least) if max(len(df.inputFiles()), size // split) < least else df

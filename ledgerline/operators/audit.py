"""Checks of rows: verdict counts, scores, their log, configurations read as one, and a stamp of the code that counted."""

from __future__ import annotations

import ast
import inspect
import textwrap
from collections.abc import Callable
from hashlib import blake2b

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def verdicts(rows: DataFrame, verdict: str = "verdict") -> DataFrame:
    """(verdict, n): how many rows have each; null is a verdict of its own."""
    return rows.groupBy(verdict).agg(F.count(F.lit(1)).alias("n"))


def scores(rows: DataFrame, by: list[str], checks: dict[str, Column]) -> DataFrame:
    """(by..., n, one count of passes per check, score): ``score`` counts the checks that every row passes. A check that is null is not passed."""
    passed = [F.count(F.when(c, 1)).alias(n) for n, c in checks.items()]
    s = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *passed)
    return s.withColumn("score", sum(((F.col(n) == F.col("n")).cast("int") for n in checks), F.lit(0)))


def log(rows: DataFrame, path: str) -> None:
    """Appends reports as JSON lines."""
    rows.write.mode("append").json(path)


def merged_maps(spark: SparkSession, paths: list[str], field: str) -> DataFrame:
    """(name, value): the maps under ``field`` of several JSON files as one, the entries of a later path replacing those of an earlier one.

    Missing or malformed files, and fields that are no objects, add nothing. ``value`` is JSON text.
    """
    out = spark.createDataFrame([], "place int, name string, value string")
    for k, p in enumerate(paths):
        t = spark.read.text(p, wholetext=True, recursiveFileLookup=True) if _there(spark, p) else spark.createDataFrame([], "value string")
        v = F.try_variant_get(F.try_parse_json("value"), f"$.{field}", "map<string,variant>")
        out = out.unionByName(t.select(F.lit(k).alias("place"), F.explode(v).alias("name", "v")).select("place", "name", F.to_json("v").alias("value")))
    return out.groupBy("name").agg(F.max_by("value", "place").alias("value"))


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def counter_stamp(*functions: Callable, dirty: bool = False) -> str:
    """12 hexadecimal digits of what the counting functions do: their syntax without names of files, comments and docstrings; ``+dirty`` for code that is not committed."""
    digest = blake2b(digest_size=6)
    for f in functions:
        tree = ast.parse(textwrap.dedent(inspect.getsource(f)))
        for node in ast.walk(tree):
            body = getattr(node, "body", None)
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Module)) and body and isinstance(body[0], ast.Expr) and isinstance(getattr(body[0], "value", None), ast.Constant) and isinstance(body[0].value.value, str):
                node.body = body[1:] or [ast.Pass()]
        digest.update(ast.dump(tree).encode())
    return digest.hexdigest() + ("+dirty" if dirty else "")

"""Queries of problems 1, 6, 7 and 8 over the test tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, times
from ..plans.problems import stamp_sql
from ..session import cut, table
from . import encode, overlap, packing, truncation

# ---- 1: overlap sizes


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    i = table(spark, folder, "invocations").select("machine", times.day_text(F.col("timestamp")).alias("date"), "fingerprint")
    return overlap.overlap_counts(i, "date", "machine", "fingerprint")


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("g").alias("date"), F.col("a").alias("machine_a"), F.col("b").alias("machine_b"), "*").drop("g", "a", "b")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    # the counts feed three inputs of the joins: they are few, so they are written once
    return _named(overlap.overlaps(cut(_counts(spark, folder)))).filter("shared * 10 >= union").select("date", "machine_a", "machine_b")


def p1_shared(spark: SparkSession, folder: str) -> DataFrame:
    """How many calls each pair of machines shares on each date, with the sizes of both."""
    return _named(overlap.overlaps(cut(_counts(spark, folder))))


def _newest_sketches(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "dailies").filter("schema = 3")
    d = d.select("record_id", names.slug(F.col("machine")).alias("machine"), times.loose_date(F.col("date")).cast("string").alias("date"), times.instant(F.col("generated_at")).alias("stamp"), "sketch")
    return d.filter("date is not null and stamp is not null").groupBy("machine", "date").agg(F.max_by("sketch", F.struct("stamp", "record_id")).alias("sketch"))


def p1_sketched(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated overlaps, and how many calls are shared, from the sketches of the exports, the newest readable one per machine and date."""
    return _named(overlap.sketch_overlaps(_newest_sketches(spark, folder), "date", "machine", "sketch")).withColumn("jaccard", F.round("jaccard", 6))


def p1_sketch_recall(spark: SparkSession, folder: str) -> DataFrame:
    """One row: of the pairs that share at least a tenth of their calls by the exact counts, how many the sketches find, and how far their estimates of the number shared are off in the middle."""
    exact = overlap.overlaps(cut(_counts(spark, folder))).filter("shared * 10 >= union")
    exact = exact.select(F.col("g").alias("date"), F.least(names.slug(F.col("a")), names.slug(F.col("b"))).alias("x"), F.greatest(names.slug(F.col("a")), names.slug(F.col("b"))).alias("y"), F.col("shared").alias("true_shared"))
    told = overlap.sketch_overlaps(_newest_sketches(spark, folder), "date", "machine", "sketch").select(F.col("g").alias("date"), F.col("a").alias("x"), F.col("b").alias("y"), "shared")
    j = exact.join(told, ["date", "x", "y"], "left")
    off = F.abs(F.col("shared") - F.col("true_shared")) / F.col("true_shared")
    return j.agg(F.count(F.lit(1)).alias("pairs"), F.count("shared").alias("found"), F.round(F.try_divide(F.count("shared").cast("double"), F.count(F.lit(1))), 6).alias("recall"), F.round(F.percentile(off, F.lit(0.5)), 4).alias("middle_error"))


_PAIRS_SQL = """m AS (SELECT DISTINCT strftime("timestamp" AT TIME ZONE 'UTC', '%Y-%m-%d') AS date, machine, fingerprint FROM invocations WHERE machine IS NOT NULL AND fingerprint IS NOT NULL AND "timestamp" IS NOT NULL),
 sizes AS (SELECT date, machine, count(*) AS n FROM m GROUP BY 1, 2),
 shared AS (SELECT a.date, a.machine AS machine_a, b.machine AS machine_b, count(*) AS shared FROM m a JOIN m b ON a.date = b.date AND a.fingerprint = b.fingerprint AND a.machine < b.machine GROUP BY 1, 2, 3),
 pairs AS (SELECT s.*, x.n AS size_a, y.n AS size_b, x.n + y.n - shared AS "union" FROM shared s JOIN sizes x ON x.date = s.date AND x.machine = machine_a JOIN sizes y ON y.date = s.date AND y.machine = machine_b)"""
P1_FOUND_SQL = f'WITH {_PAIRS_SQL} SELECT date, machine_a, machine_b FROM pairs WHERE shared * 10 >= "union"'
P1_SHARED_SQL = f"WITH {_PAIRS_SQL} SELECT * FROM pairs"


# ---- 6: encoding of the corpus


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encoded(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")


# ---- 7: containers

CAPACITY = 2048


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    sized = encode.counted(table(spark, folder, "documents").select("doc_id", "text"))
    return packing.packed(sized, "doc_id", "n_tokens", CAPACITY)


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """A container for each document, or each piece of one over the capacity."""
    return _packed(spark, folder)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How many containers hold how many tokens."""
    c = _packed(spark, folder).groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return c.groupBy("used").agg(F.count(F.lit(1)).alias("containers"))


# ---- 8: texts that lost their end


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(table(spark, folder, "documents")).filter("cut").select("doc_id")


def p8_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Of each source, how many texts there are, how many lost their end, and the share."""
    docs = table(spark, folder, "documents")
    cases = truncation.truncated(docs).groupBy("source").agg(F.count(F.when(F.col("cut"), 1)).alias("truncated"))
    total = docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    t = total.join(cases.withColumnRenamed("source", "s"), total["source"].eqNullSafe(F.col("s")), "left").withColumn("truncated", F.coalesce("truncated", F.lit(0).cast("long")))
    return t.select("source", "documents", "truncated", F.round(F.col("truncated") / F.col("documents"), 6).alias("share"))


_SKETCHED_SQL = rf"""e AS (SELECT record_id, trim(regexp_replace(lower(machine), '[^a-z0-9]+', '-', 'g'), '-') AS machine, strftime(try_strptime(replace(replace(trim(date), '-', ''), '/', ''), '%Y%m%d'), '%Y-%m-%d') AS date, {stamp_sql("generated_at")} AS stamp, sketch
 FROM dailies WHERE schema = 3), w AS (SELECT machine, date, list_sort(list_distinct(sketch)) AS sk FROM (SELECT * FROM e WHERE date IS NOT NULL AND stamp IS NOT NULL QUALIFY row_number() OVER (PARTITION BY machine, date ORDER BY stamp DESC, record_id DESC) = 1) WHERE sketch IS NOT NULL),
 p AS (SELECT a.date, a.machine AS machine_a, b.machine AS machine_b, list_slice(list_sort(list_distinct(list_concat(a.sk, b.sk))), 1, 64) AS u, a.sk AS x, b.sk AS y FROM w a JOIN w b ON a.date = b.date AND a.machine < b.machine),
 n AS (SELECT *, len(list_intersect(list_intersect(x, y), u)) AS k FROM p),
 sketched AS (SELECT date, machine_a, machine_b, CAST(k AS INTEGER) AS in_both, CAST(len(u) AS INTEGER) AS "of", k / len(u) AS jaccard,
  CAST(CASE WHEN len(u) < 64 THEN k ELSE round((k / len(u)) * (63.0::DOUBLE / ((CAST(CAST('0x' || left(u[-1], 13) AS BIGINT) AS DOUBLE) + 1) / 4503599627370496.0::DOUBLE))) END AS BIGINT) AS shared FROM n WHERE k > 0)"""
def p8_rules(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the documents that lost their end each rule told."""
    t = truncation.truncated(table(spark, folder, "documents")).filter("cut")
    return t.groupBy("rule").agg(F.count(F.lit(1)).alias("documents"))


P1_SKETCHED_SQL = f"WITH {_SKETCHED_SQL} SELECT * REPLACE (round(jaccard, 6) AS jaccard) FROM sketched"
_SLUG_SQL = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-')"
P1_SKETCH_RECALL_SQL = f"""WITH {_PAIRS_SQL}, {_SKETCHED_SQL},
 t AS (SELECT date, least({_SLUG_SQL.format(c="machine_a")}, {_SLUG_SQL.format(c="machine_b")}) AS x, greatest({_SLUG_SQL.format(c="machine_a")}, {_SLUG_SQL.format(c="machine_b")}) AS y, shared AS true_shared FROM pairs WHERE shared * 10 >= "union"),
 j AS (SELECT t.*, s.shared AS shared FROM t LEFT JOIN sketched s ON s.date = t.date AND s.machine_a = x AND s.machine_b = y)
SELECT count(*) AS pairs, count(shared) AS found, round(count(shared) / count(*), 6) AS recall, round(quantile_cont(abs(shared - true_shared) / true_shared, 0.5), 4) AS middle_error FROM j"""


QUERIES = {
    "p1_found": p1_found, "p1_shared": p1_shared, "p1_sketched": p1_sketched, "p1_sketch_recall": p1_sketch_recall,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers, "p7_fill": p7_fill,
    "p8_found": p8_found, "p8_sources": p8_sources, "p8_rules": p8_rules,
}
SQL = {"p1_found": P1_FOUND_SQL, "p1_sketched": P1_SKETCHED_SQL, "p1_sketch_recall": P1_SKETCH_RECALL_SQL, "p1_shared": P1_SHARED_SQL}

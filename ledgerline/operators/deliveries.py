"""Messages delivered more than once: one copy of each is kept.

Only identifiers, the delivery order and the place of a row in its file are shuffled. The rows to
drop become deletion vectors, 32,768 row positions to a bitmap. Everything else is read off the
vectors: the payload in one scan with the vectors beside it, never shuffled, and the dropped rows too.

Defined cases. Ids are trimmed (any white space), the second id in any letter case; blank counts as
missing. Two rows belong to one message if they share either id, directly or through others. A row
without any id is its own message. Of a message the row with the least order is kept; rows that tie in the
order are told apart by file and position, so one is kept. A null order comes first. Empty tables stay empty. One id may
hold any share of the rows: every group is reduced by an aggregate that combines on the map side,
never by a window over a group.

Ids are compared by 96 bits of their MD5 and files by 64 bits of their path's hash; over 10^12 ids and 10^6
files the odds that two are taken for one are under 1 in 100,000.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import filled
from ..session import cut
from .components import connected_components

#: Bytes of deletion vectors that one broadcast may hold; files are read in as many groups as needed.
VECTOR_BYTES = 128 << 20
#: Rows of two digests each that a broadcast may hold (about 64 MB).
BESIDE_ROWS = 1_000_000
#: Bits in one bitmap of bitmap_construct_agg, and the bytes that one takes in a broadcast.
BUCKET_BITS = 32_768
BUCKET_BYTES = BUCKET_BITS // 8 + 200


def _digest(id: Column) -> Column:
    """12 bytes for an id of any length; null stays null."""
    return F.substring(F.unhex(F.md5(id)), 1, 12)


def _placed(spark: SparkSession, path: str, *columns: Column) -> DataFrame:
    return spark.read.parquet(path).select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("position"))


def _identified(spark: SparkSession, path: str, first: Column, second: Column, order: str, counted: Column) -> DataFrame:
    """(r, u, o, file, position) of the rows that count and have an id: both ids as text."""
    t = _placed(spark, path, counted.alias("counted"), filled(first).alias("r"), F.lower(filled(second)).alias("u"), F.col(order).alias("o"))
    return t.filter("counted and (r is not null or u is not null)").drop("counted")


def keyed(identified: DataFrame) -> DataFrame:
    """The narrow rows that are shuffled: digests of both ids (r, u), and ``at``, the order with the row's file and position."""
    at = F.struct("o", F.xxhash64("file").alias("f"), F.col("position").alias("p"))
    return identified.select(_digest(F.col("r")).alias("r"), _digest(F.col("u")).alias("u"), at.alias("at"))


def _beside(small: DataFrame) -> DataFrame:
    """A written table as the smaller side of a join: broadcast if its counted rows are few, else left to a shuffled join."""
    return F.broadcast(small) if small.count() <= BESIDE_ROWS else small.hint("merge")


def winners(narrow: DataFrame) -> DataFrame:
    """(o, f, p): the first delivery of each message with an id.

    Two shuffles see all rows: by the second id, which finds the first ids that it links, and by the first
    id. Links and what hangs on them are usually few, and only they go through components.
    """
    by_second = narrow.filter("u is not null").groupBy("u").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min(F.when(F.col("r").isNull(), F.col("at"))).alias("at"))
    seconds = cut(by_second.filter("r0 <> r1 or at is not null"))
    linking = cut(seconds.filter("r0 <> r1").select("u", "r0"))
    links = narrow.filter("r is not null").select("r", "u").join(_beside(linking), "u").filter("r <> r0").select(F.col("r").alias("a"), F.col("r0").alias("b"))
    comps = connected_components(links)
    # rows without a first id stand with the one that their second id is seen with
    hanging = seconds.filter("at is not null and r0 is not null").select(F.col("r0").alias("r"), "at")
    alone = seconds.filter("at is not null and r0 is null").select("at")
    by_first = narrow.filter("r is not null").select("r", "at").unionByName(hanging).groupBy("r").agg(F.min("at").alias("at"))
    placed = by_first.join(_beside(comps), by_first["r"] == comps["node"], "left").select("component", "at")
    # of linked ids only the component's first stays; the others are as they are
    linked = placed.filter("component is not null").groupBy("component").agg(F.min("at").alias("at")).select("at")
    return placed.filter("component is null").select("at").unionByName(linked).unionByName(alone).select("at.*")


def bitmaps(places: DataFrame, file: str) -> DataFrame:
    """(file, bucket, bits) of (file, position): one bitmap per 32,768 positions of a file."""
    number = F.col("position") + 1
    return places.groupBy(file, F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))


def _without(batches: Iterator) -> Iterator:
    """(file, bucket, bits, kept) to (file, bucket, words): the bits that are not kept, as 64-bit words; rows without any are left out."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        all_ = [np.frombuffer(x.as_py(), dtype="<i8") for x in batch.column("bits")]
        kept = [np.frombuffer(x.as_py() or bytes(BUCKET_BITS // 8), dtype="<i8") for x in batch.column("kept")]
        words = [a & ~k for a, k in zip(all_, kept)]
        some = [bool(w.any()) for w in words]
        column = pa.array([w for w, s in zip(words, some) if s], pa.list_(pa.int64()))
        mask = pa.array(some, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("file").filter(mask), batch.column("bucket").filter(mask), column], ["file", "bucket", "words"])


def deletion_vectors(spark: SparkSession, path: str, first: Column, second: Column, order: str, counted: Column | None = None) -> DataFrame:
    """(file, bucket, words): which rows of the Parquet table are no kept copy of their message, written to the shared folder.

    The rows with an id, whose bitmaps come straight from the files' tasks, less the winners. Winners come in the order
    of their ids, so their places are brought together by bucket before any bitmap is made.
    """
    identified = _identified(spark, path, first, second, order, F.lit(True) if counted is None else counted)
    won = winners(keyed(identified)).select("f", F.col("p").alias("position"))
    kept = bitmaps(won.repartition("f", F.bitmap_bucket_number(F.col("position") + 1)), "f").select("f", F.col("bucket").alias("b"), F.col("bits").alias("kept"))
    all_ = bitmaps(identified.select("file", "position"), "file")
    both = all_.join(kept, (F.xxhash64(all_["file"]) == kept["f"]) & (all_["bucket"] == kept["b"]), "left").select("file", "bucket", "bits", "kept")
    return cut(both.mapInArrow(_without, "file string, bucket long, words array<long>"))


def _groups(sizes: list[tuple[str, int]], budget: int) -> list[list[str]]:
    """Files in groups whose vectors stay within the budget; a file with more than that has a group of its own."""
    out: list[list[str]] = []
    left = 0
    for file, size in sorted(sizes):
        if size > left or not out:
            out.append([])
            left = budget
        out[-1].append(file)
        left -= size
    return out


def _marked(spark: SparkSession, path: str, vectors: DataFrame, gone: bool, budget: int) -> DataFrame:
    """The rows of the Parquet table that a vector drops, or those that none does. Nothing is shuffled.

    Vectors of up to ``budget`` bytes are broadcast. Beyond that the files are read in groups packed by the measured size
    of their vectors (one number per file goes to the driver, which lists the files anyway), each file once, and united.
    """
    base = spark.read.parquet(path)
    own = "_"  # begins no name of the table
    while any(c.startswith(own) for c in base.columns):
        own += "_"
    file, position, words = own + "file", own + "position", own + "words"
    placed = base.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(position))
    number = F.col(position) + 1
    bit = F.bitmap_bit_position(number)
    dropped = F.call_function("shiftright", F.get(words, (bit / 64).cast("int")), (bit % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    v = vectors.select(F.col("file").alias(own + "vf"), F.col("bucket").alias(own + "vb"), F.col("words").alias(words))

    def part(rows: DataFrame, vectors: DataFrame) -> DataFrame:
        j = rows.join(F.broadcast(vectors), (F.col(file) == F.col(own + "vf")) & (F.bitmap_bucket_number(number) == F.col(own + "vb")), "inner" if gone else "left")
        return j.filter(dropped if gone else ~F.coalesce(dropped, F.lit(False))).select(*[base[c] for c in base.columns])

    if vectors.count() * BUCKET_BYTES <= budget:
        return part(placed, v)
    sizes = [(r[0], r[1] * BUCKET_BYTES) for r in vectors.groupBy("file").count().collect()]
    out = placed.filter(F.lit(False) if gone else ~F.col(file).isin([f for f, _ in sizes])).select(*[base[c] for c in base.columns])
    for files in _groups(sizes, budget):
        out = out.unionByName(part(placed.filter(F.col(file).isin(files)), v.filter(F.col(own + "vf").isin(files))))
    return out


def read_kept(spark: SparkSession, path: str, vectors: DataFrame, budget: int = VECTOR_BYTES) -> DataFrame:
    """Every row of the Parquet table that no vector drops."""
    return _marked(spark, path, vectors, False, budget)


def read_dropped(spark: SparkSession, path: str, vectors: DataFrame, budget: int = VECTOR_BYTES) -> DataFrame:
    """Every row of the Parquet table that a vector drops."""
    return _marked(spark, path, vectors, True, budget)

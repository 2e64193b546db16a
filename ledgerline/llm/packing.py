"""Items of varying length in containers of fixed capacity, planned over the histogram of lengths.

Best fit, longest first, runs over counts: all items of one length are placed at once, in runs of
containers that look alike, so planning takes time by the number of lengths (the capacity, at most) and
not by the number of items. It yields the very containers that best fit over the items one by one would.
Items then take the planned slots by their rank among the items of their length.

Ranks need no global sort and no window over a length (a third of all items may have the same):
items are numbered within hashed buckets of a length, and bucket offsets are sums of counts.

Defined cases. An item over the capacity becomes pieces of the full capacity and a rest; nothing else
is split. An item of length 0 (empty and null texts) takes no space; such items are spread over the
planned containers in turn, or stand in container 0 if there are none. Repeated rows each get a slot.
An empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, literal

#: Buckets in which items of one length are numbered: at least so many, and so many to each shuffle partition.
BUCKETS, BUCKETS_EACH = 256, 4


def plan(histogram: Iterable[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Segments (length, rank0, n, container0, per_container, offset) and the number of containers.

    The j-th item of a segment, counted from rank0, stands in container0 + j // per_container at
    offset + (j % per_container) * length.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # space left -> runs of containers (first, count)
    spaces: list[int] = []  # its keys, sorted

    def put(space: int, first: int, count: int) -> None:
        if space > 0 and count > 0:
            if space not in room:
                bisect.insort(spaces, space)
                room[space] = []
            room[space].append((first, count))

    segments, containers = [], 0
    for length, n in sorted(histogram, reverse=True):
        if not 0 < length <= capacity or n <= 0:
            continue
        rank = 0
        while n:
            i = bisect.bisect_left(spaces, length)
            if i < len(spaces):
                space = spaces[i]
                first, count = room[space].pop()
                if not room[space]:
                    del room[space], spaces[i]
            else:
                space, first, count = capacity, containers, -(-n // (capacity // length))
                containers += count
            each = space // length
            full = min(count, n // each)
            used = full * each
            part = n - used if full < count else 0  # items in one container that is not filled as the others
            segments.append((length, rank, used + part, first, each, capacity - space))
            put(space - each * length, first, full)
            if part:
                put(space - part * length, first + full, 1)
            put(space, first + full + bool(part), count - full - bool(part))
            rank, n = rank + used + part, n - used - part
    return segments, containers


def pieces(sized: DataFrame, id: str, size: str, capacity: int) -> DataFrame:
    """(id, piece, start, n): an item over the capacity as several rows, any other as one."""
    whole = sized.select(F.col(id).alias("id"), F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("size"))
    last = F.greatest(F.floor((F.col("size") - 1) / capacity), F.lit(0).cast("long"))
    p = whole.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return p.select("id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.col("size") - F.col("piece") * capacity, F.lit(capacity).cast("long")).alias("n"))


def packed(sized: DataFrame, id: str, size: str, capacity: int) -> DataFrame:
    """(id, piece, start, n_tokens, container, position): where each item or piece stands."""
    spark: SparkSession = sized.sparkSession
    # written once: lengths are dear to compute, and numbering reads them several times
    items = cut(pieces(sized, id, size, capacity).withColumn("row", F.monotonically_increasing_id()))
    # as many more buckets as the session has partitions, so that a length that a third of all items have stays in small tasks
    buckets = max(BUCKETS, BUCKETS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    counts = items.groupBy("n", "bucket").agg(F.count(F.lit(1)).alias("c"))
    histogram = [(r[0], r[1]) for r in counts.groupBy("n").agg(F.sum("c")).collect()]  # capacity + 1 rows at most
    segments, containers = plan(histogram, capacity)
    before = Window.partitionBy("n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("n", "bucket").orderBy("row")) - 1
    ranked = items.withColumn("number", number).join(offsets, ["n", "bucket"]).withColumn("rank", F.col("number") + F.col("offset"))
    slots = literal(spark, segments or [(-1, 0, 0, 0, 1, 0)], "len long, rank0 long, amount long, container0 long, per long, at long")
    # a run of the plan is made for each length and kind of container: thousands at most, by the capacity
    at = ranked.join(F.broadcast(slots), (F.col("n") == F.col("len")) & (F.col("rank") >= F.col("rank0")) & (F.col("rank") < F.col("rank0") + F.col("amount")), "left")
    j = F.col("rank") - F.col("rank0")
    empty = F.pmod(F.col("rank"), F.lit(max(containers, 1)))
    return at.select(
        F.col("id").alias(id),
        F.col("piece").cast("int").alias("piece"),
        "start",
        F.col("n").alias("n_tokens"),
        F.coalesce(F.col("container0") + F.floor(j / F.col("per")), empty).alias("container"),
        F.coalesce(F.col("at") + F.pmod(j, F.col("per")) * F.col("n"), F.lit(0)).alias("position"),
    )

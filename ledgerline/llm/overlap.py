"""Overlap sizes between many large sets, without materialising an intersection.

Each identifier's membership (the sets of one group it is in) is gathered once. Identifiers in few
sets are light: their pairs are expanded. Identifiers in many sets are heavy: a partition's heavy
identifiers become a dense 0/1 matrix per group, and its product with itself gives the counts of all
pairs at once. Both kinds of counts are added. A pair of a set with itself is its size, so sizes come
out of the same pass, and with them the union of any pair.

One shuffle moves (group, identifier, set), repeated rows removed on the map side; after it only
counts move, (group, set, set), summed on the map side too. A hot identifier is at most as long as
the number of sets; a hot set or group is spread over the identifiers' hash.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An identifier in more sets than this is heavy.
LIGHT_DEGREE = 8
#: Sets on one side of a block of the dense product, and identifiers that one product takes.
BLOCK, ROWS = 2048, 4096
#: Memberships that a worker holds before it multiplies them (some 40 bytes each while it does).
HELD = 8 << 20


def block_counts(rows: list, n_sets: int):
    """Yields (a, b, n) as arrays: of each pair a <= b of set numbers, how many rows hold both.

    ``rows`` are arrays of set numbers below ``n_sets``. One block of sets is multiplied with another at a time, and one
    accumulator of 64-bit integers per pair of blocks takes all rows before its counts are given out, so memory
    does not grow with the number of sets.
    """
    import numpy as np

    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    # memberships by block of sets, in the order of rows
    order = np.argsort(flat // BLOCK, kind="stable")
    starts = np.searchsorted((flat // BLOCK)[order], np.arange(-(-n_sets // BLOCK) + 1))
    blocks = [(row[order[x:y]], flat[order[x:y]] - i * BLOCK) for i, (x, y) in enumerate(zip(starts, starts[1:]))]

    def dense(block, ids):
        """The 0/1 matrix of these rows (sorted) in one block."""
        lo, hi = np.searchsorted(block[0], [ids[0], ids[-1] + 1])
        r, c = block[0][lo:hi], block[1][lo:hi]
        at = np.searchsorted(ids, r)
        there = ids[np.minimum(at, len(ids) - 1)] == r
        m = np.zeros((len(ids), BLOCK), dtype=np.float32)
        m[at[there], c[there]] = 1
        return m

    for i, x in enumerate(blocks):
        for j in range(i, len(blocks)):
            y = blocks[j]
            ids = np.intersect1d(x[0], y[0])  # only rows that are in both
            total = None
            for k in range(0, len(ids), ROWS):
                some = ids[k : k + ROWS]
                left = dense(x, some)
                # sums of up to 4,096 ones are exact in 32 bits
                p = (left.T @ (left if i == j else dense(y, some))).astype(np.int64)
                total = p if total is None else np.add(total, p, out=total)
            if total is not None:
                if i == j:
                    total = np.triu(total)
                a, b = np.nonzero(total)
                yield (a + i * BLOCK).astype(np.int32), (b + j * BLOCK).astype(np.int32), total[a, b]


def _products(batches: Iterator) -> Iterator:
    """(group, sets) sorted by group to (group, a, b, n), a <= b."""
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("g", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])
    group, rows, numbers, held = None, [], {}, 0

    def counted():
        names = sorted(numbers)
        place = np.empty(len(names), dtype=np.int32)
        for i, s in enumerate(names):
            place[numbers[s]] = i
        texts = pa.array(names, pa.string())
        for a, b, n in block_counts([place[r] for r in rows], len(names)):
            for k in range(0, len(n), 1 << 20):
                x, y, z = (pa.array(v[k : k + (1 << 20)]) for v in (a, b, n))
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(group, pa.string()), len(z)), texts.take(x), texts.take(y), z], schema=schema)

    for batch in batches:
        sets = batch.column(1)
        values, ends = sets.flatten().to_pylist(), np.cumsum([0, *map(len, sets)])
        for i, g in enumerate(batch.column(0).to_pylist()):
            if rows and (g != group or held >= HELD):
                yield from counted()
                rows, numbers, held = [], {}, 0
            group = g
            r = np.fromiter((numbers.setdefault(s, len(numbers)) for s in values[ends[i] : ends[i + 1]]), dtype=np.int32)
            rows.append(r)
            held += len(r)
    if rows:
        yield from counted()


def overlap_counts(members: DataFrame, group: str, set_: str, identifier: str, light: int = LIGHT_DEGREE) -> DataFrame:
    """(g, a, b, n): identifiers that sets a <= b of group g share; a = b gives the size of a set.

    Pairs that share nothing have no row. Rows with a null group, set or identifier belong to no set
    and are left out; repeated rows count once; an empty table gives no rows. Exact, not an estimate.
    """
    m = members.select(F.col(group).cast("string").alias("g"), F.col(set_).cast("string").alias("s"), F.col(identifier).alias("i")).dropna()
    sets = m.groupBy("g", "i").agg(F.array_sort(F.collect_set("s")).alias("s"))
    expanded = F.expr("flatten(transform(s, (x, k) -> transform(slice(s, k + 1, size(s)), y -> struct(x as a, y as b))))")
    few = sets.filter(F.size("s") <= light).select("g", F.inline(expanded)).groupBy("g", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    many = sets.filter(F.size("s") > light).select("g", "s").sortWithinPartitions("g").mapInArrow(_products, "g string, a string, b string, n long")
    return few.unionByName(many).groupBy("g", "a", "b").agg(F.sum("n").alias("n"))


def overlaps(counts: DataFrame) -> DataFrame:
    """(g, a, b, shared, size_a, size_b, union) of each pair a < b that shares anything.

    The counts are a few numbers per group and pair; sizes are joined to them by group and set.
    """
    # as many rows as sets and groups: they are met in a shuffle, not broadcast
    size = counts.filter("a = b").hint("merge")
    pairs = counts.filter("a < b").select("g", "a", "b", F.col("n").alias("shared"))
    full = pairs.join(size.select("g", "a", F.col("n").alias("size_a")), ["g", "a"]).join(size.select("g", F.col("b"), F.col("n").alias("size_b")), ["g", "b"])
    return full.select("g", "a", "b", "shared", "size_a", "size_b", (F.col("size_a") + F.col("size_b") - F.col("shared")).alias("union"))


def _least(h: Column) -> Column:
    """16 hexadecimal digits as a share of the whole range, by the first 13: exact in a double."""
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 1) / F.lit(float(1 << 52))


def sketch_overlaps(sketches: DataFrame, group: str, set_: str, sketch: str, k: int = 64) -> DataFrame:
    """Estimates from bottom-k sketches (sorted arrays of the least k hashes, 16 hex digits each).

    (g, a, b, in_both, of, jaccard, shared) of each pair a < b of one group whose sketches share a hash: of the
    least k of the union, how many are in both; ``shared`` estimates how many identifiers both have: that share of
    the union's size, which is (k - 1) over the k-th least hash as a part of the range. With fewer than k
    hashes in the union nothing is left out of either sketch, and shared is exact. Other pairs have the estimate 0 and no row. Pairs come
    from the shared hashes, through the same counts as above, not from all pairs of sets. A null or
    empty sketch shares nothing; repeated hashes count once; two sketches of one set are united first.
    """
    s = sketches.select(F.col(group).cast("string").alias("g"), F.col(set_).cast("string").alias("s"), F.explode(sketch).alias("h")).dropna()
    one = s.groupBy("g", "s").agg(F.slice(F.array_sort(F.collect_set("h")), 1, k).alias("h"))
    c = overlap_counts(one.select("g", "s", F.explode("h").alias("h")), "g", "s", "h").filter("a < b").select("g", "a", "b")
    both = c.join(one.select("g", F.col("s").alias("a"), F.col("h").alias("ha")), ["g", "a"]).join(one.select("g", F.col("s").alias("b"), F.col("h").alias("hb")), ["g", "b"])
    least = F.slice(F.array_sort(F.array_union("ha", "hb")), 1, k)
    both = both.withColumn("least", least).withColumn("in_both", F.size(F.array_intersect(F.array_intersect("ha", "hb"), "least"))).withColumn("of", F.size("least")).filter("in_both > 0")
    jaccard = F.col("in_both") / F.col("of")
    size = F.lit(float(k - 1)) / _least(F.element_at("least", -1))
    shared = F.when(F.col("of") < k, F.col("in_both")).otherwise(F.round(jaccard * size))
    return both.select("g", "a", "b", "in_both", "of", jaccard.alias("jaccard"), shared.cast("long").alias("shared"))

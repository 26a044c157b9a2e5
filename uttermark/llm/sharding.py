"""Reproducible shards by a Feistel permutation with cycle walking over global row numbers.

Rows get global numbers 0..N-1 that depend on their values alone, not on files or partitions. A
Feistel permutation of a rectangle a x b, a*b >= N, maps a number to another; while the result
lies beyond N it is mapped again, so that in the end 0..N-1 is permuted onto itself. Position p
belongs to shard p mod n, slot p div n: shard sizes differ by one at most, and anyone who knows a
row's number, N, the seed and n can compute its place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_ROWS = 20_000
BLOCK = 5_000


def rectangle(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square that holds ``n`` numbers."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def feistel(x: Column, a: int, b: int, seed: int, rounds: int = 4) -> Column:
    """One application of the permutation of 0..a*b-1."""
    state = F.struct((x % a).alias("l"), F.floor(x / F.lit(a)).cast("long").alias("r"))

    def step(s: Column, k: Column) -> Column:
        left = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], k, F.lit(seed)), F.lit(a)), F.lit(a))
        right = F.pmod(s["r"] + F.pmod(F.xxhash64(left, k, F.lit(seed + 1)), F.lit(b)), F.lit(b))
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, step, lambda s: s["l"] + s["r"] * a)


def permute(x: Column, n: int, seed: int) -> Column:
    """Position of number ``x`` (0..n-1) in a permutation of 0..n-1, by cycle walking.

    A walk leaves 0..n-1 at most a*b-n < a times; where a is large, 64 steps fail with a chance
    below n**-32, and then an error is raised.
    """
    a, b = rectangle(n)
    steps = min(a, 64)

    def walk(s: Column, _: Column) -> Column:
        return F.when((s >= 0) & (s < n), s).otherwise(feistel(F.when(s < 0, -s - 1).otherwise(s), a, b, seed))

    # a negative state -x-1 has not been permuted yet
    out = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), -x - 1, walk)
    return F.when((out >= 0) & (out < n), out).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def number_rows(rows: DataFrame, name: str = "row_number") -> tuple[DataFrame, int]:
    """Add global row numbers 0..N-1 that depend on the rows' values alone; return also N.

    Equal rows are counted before any shuffle by value and spread out again afterwards, so a row
    that occurs very often is no hot key. Distinct rows go to hashed buckets of bounded size; each
    bucket is sorted, and buckets are put end to end.
    """
    total = rows.count()
    buckets = max(16, -(-total // BUCKET_ROWS))
    cols = rows.columns
    count, bucket, at = "__count", "__bucket", "__at"
    distinct = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias(count))
    distinct = distinct.withColumn(bucket, F.pmod(F.xxhash64(*cols), F.lit(buckets)))
    within = W.partitionBy(bucket).orderBy(*cols).rowsBetween(W.unboundedPreceding, -1)
    placed = distinct.withColumn(at, F.coalesce(F.sum(count).over(within), F.lit(0)))
    sizes = distinct.groupBy(bucket).agg(F.sum(count).alias("__size"))
    # sums of the buckets before, inside groups of buckets and over the groups, so that neither window is long
    preceding = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    side = max(1, math.isqrt(buckets))
    sizes = sizes.withColumn("__group", F.floor(F.col(bucket) / F.lit(side)))
    groups = sizes.groupBy("__group").agg(F.sum("__size").alias("__of"))
    groups = groups.select("__group", F.coalesce(F.sum("__of").over(preceding(W.orderBy("__group"))), F.lit(0)).alias("__from"))
    inner = F.coalesce(F.sum("__size").over(preceding(W.partitionBy("__group").orderBy(bucket))), F.lit(0))
    starts = sizes.withColumn("__inner", inner).join(groups, "__group").select(bucket, (F.col("__from") + F.col("__inner")).alias("__start"))
    placed = placed.join(starts, bucket)
    blocks = placed.withColumn("__block", F.explode(F.sequence(F.lit(0), F.floor((F.col(count) - 1) / BLOCK))))
    last = F.least(F.lit(BLOCK), F.col(count) - F.col("__block") * BLOCK) - 1
    one = blocks.withColumn("__in", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    number = F.col("__start") + F.col(at) + F.col("__block") * BLOCK + F.col("__in")
    return one.select(*cols, number.alias(name)), total


def shard(rows: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """Deal all rows into ``shards`` shards whose sizes differ by one at most.

    Adds ``row_number``, ``position``, ``shard`` and ``slot`` (gapless from 0 in each shard).
    Columns of ``rows`` with these names raise an error. Nulls in any column are values like any
    other. Repeated rows are numbered one by one. An empty table stays empty. Columns must be
    groupable (no maps).
    """
    clash = {"row_number", "position", "shard", "slot"} & {c.lower() for c in rows.columns}
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    if shards < 1:
        raise ValueError("shards must be at least 1")
    numbered, total = number_rows(rows)
    placed = numbered.withColumn("position", permute(F.col("row_number"), total, seed))
    return placed.withColumns(
        {
            "shard": (F.col("position") % shards).cast("int"),
            "slot": F.floor(F.col("position") / F.lit(shards)).cast("long"),
        }
    )

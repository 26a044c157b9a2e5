"""Sums over all rows that stand before a row in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from uttermark.llm.work import written


def sums_before(rows: DataFrame, order: list[Column], values: dict[str, Column], path: str) -> DataFrame:
    """Add, under the names of ``values``, the sum of each value (a long) over the rows that come before in ``order``.

    Rows are dealt out by ranges of the order and written with the number of their range, so that a lost task cannot move a
    row to another range afterwards. A sum is what lies in the ranges before (a row for each range) and before the row in its
    own. Rows that are equal in ``order`` follow one another in the order of the files, so that many equal rows still fall
    into many ranges. ``rows`` are read more than once and should be cheap to make, and their names should not start with ``__``.
    """
    marked = rows.withColumns({f"__o{i}": c for i, c in enumerate(order)} | {"__row": F.monotonically_increasing_id()})
    by = [F.col(f"__o{i}") for i in range(len(order))] + [F.col("__row")]
    marked = marked.withColumns({f"__v{i}": v.cast("long") for i, v in enumerate(values.values())})
    placed = written(marked.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()), path)
    names = [f"__v{i}" for i in range(len(values))]
    ranges = placed.groupBy("__range").agg(*(F.sum(v).alias(v) for v in names))
    earlier = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")
    ranges = ranges.select("__range", *(F.coalesce(F.sum(v).over(earlier), nothing).alias(f"{v}from") for v in names))
    inside = W.partitionBy("__range").orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    summed = placed.select("*", *(F.coalesce(F.sum(v).over(inside), nothing).alias(f"{v}in") for v in names))
    out = summed.join(F.broadcast(ranges), "__range")  # as many rows as the shuffle has partitions
    return out.select(*rows.columns, *((F.col(f"{v}from") + F.col(f"{v}in")).alias(name) for name, v in zip(values, names, strict=True)))

"""Connected components of an edge table, by contraction, with nothing gathered on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttermark.llm.work import small, written


def components(edges: DataFrame, path: str) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) of every node in ``edges`` (``a``, ``b``).

    Every round gives the nodes a new random order, by a hash of round and node. It hooks each node to the first of its
    neighbours and itself in that order, follows the pointer once more, and replaces the edges' ends by their pointers. Only nodes
    that something points to are left: a node with a neighbour is the first of its surroundings with a chance of one half at most,
    whatever the graph and its numbers, so the nodes that still have edges fall by a constant factor in every round, and the
    rounds grow with the logarithm of the nodes (a path of 10,000 takes about ten). Loops and repeated edges vanish, so the edge
    table shrinks until it is empty. Nodes are counted before they are shuffled, so a node with very many edges costs one
    row for each task. The smallest node of a component is found at the end.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), f"{path}/e0")
    step, roots = 0, None
    while not edges.isEmpty():
        at = lambda c: F.struct(F.xxhash64(c, F.lit(step)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min(at("b")).alias("first")).select(F.col("a").alias("node"), _first(at("a"), F.col("first")).alias("up"))
        upper = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jump = written(hook.join(upper, "up").select("node", "top"), f"{path}/j{step}")
        if roots is None:
            roots = jump.select("node", F.col("top").alias("root"))
        else:
            moved = jump.select(F.col("node").alias("root"), "top")
            roots = roots.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            if step % 8 == 7:
                roots = written(roots, f"{path}/r{step}")  # a plan of a few joins
        a, b = jump.select(F.col("node").alias("a"), F.col("top").alias("ta")), jump.select(F.col("node").alias("b"), F.col("top").alias("tb"))
        left = edges.join(a, "a").join(b, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        edges = written(left.distinct(), f"{path}/e{step + 1}")
        step += 1
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = written(roots, f"{path}/roots") if step > 1 else roots
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return written(roots.join(small(written(least, f"{path}/least")), "root").select("node", "component"), f"{path}/components")


def _first(x: Column, y: Column) -> Column:
    return F.least(x, y)["n"]

"""Mixing sources to target weights, cut at each source's exact budget.

A source of weight w should give w of the weights' sum of all words, but no document is repeated more than ``most`` times:
a target stops at ``most`` times the source's size, and what is left over is shared again by weight among the others.
Every document has a hash-random key. Documents are sorted by (source, key) in ranges over all tasks, and the words before each
are summed over the ranges. The budget is so many whole epochs of the source, and then the documents up to a cut that
falls inside one document at most. A large source is many ranges, so it is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttermark.llm.order import sums_before
from uttermark.llm.work import folder, small, written

SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]++"


def count_words(text: Column) -> Column:
    """Number of runs of characters other than 0x20 and 0x09-0x0D; null has none."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\x20\x09-\x0D]*+{WORD}", "x")
    return F.length(F.rtrim(marks, F.lit(SPACES))).cast("long")


def _by_source() -> list[Column]:
    return [F.col("source").isNull(), F.col("source")]


def cyclic_weights(rows: DataFrame, weights: list[int]) -> DataFrame:
    """``source``, ``weight`` of the sources of ``rows`` in the order of their code points, null last: the weights in turn."""
    sources = written(rows.select("source").distinct(), f"{(path := folder(rows.sparkSession))}/sources")
    at = sums_before(sources, _by_source(), {"place": F.lit(1)}, f"{path}/placed")
    turn = F.array(*(F.lit(w) for w in weights))
    return at.select("source", turn[(F.col("place") % len(weights)).cast("int")].cast("long").alias("weight"))


def targets(sources: DataFrame, most: int) -> DataFrame:
    """Add ``target`` (double) to (``source``, ``weight``, ``source_size``): shares by weight of the sum of all sizes, none above
    ``most`` times its source's size.

    Each round finds the sources that their share would lift to the limit, and shares what they leave among the others; it ends
    when there is no new one. A round is one sum over the table, and only its one row comes to the driver. Where every
    source with a weight is at its limit, the rest is not shared out.
    """
    cap = (F.col("source_size") * most).cast("double")
    of = lambda c, when=None: F.coalesce(F.sum(c if when is None else F.when(when, c)), F.lit(0)).cast("long")
    first = sources.agg(of(F.col("source_size")).alias("total"), of(F.col("weight")).alias("weight"), F.coalesce(F.min("weight"), F.lit(0)).alias("least")).first()
    if first["least"] < 0:
        raise ValueError("weights must not be negative")
    left, weight, full = first["total"], first["weight"], 0
    reached = lambda: cap * weight <= F.col("weight").cast("double") * left
    while weight > 0:
        over = reached()
        one = sources.agg(F.count(F.when(over, 1)).alias("full"), of(F.col("source_size") * most, over).alias("caps"), of(F.col("weight"), ~over).alias("weight")).first()
        if one["full"] == full:
            break
        left, weight, full = first["total"] - one["caps"], one["weight"], one["full"]
    if weight > 0:
        return sources.withColumn("target", F.when(reached(), cap).otherwise(F.col("weight") * F.lit(left) / F.lit(weight)))
    return sources.withColumn("target", F.when(F.col("weight") > 0, cap).otherwise(0.0))


def mix(rows: DataFrame, weights: DataFrame, most: int = 3, seed: int = 17) -> DataFrame:
    """How many words of every document the mix takes.

    ``rows``: ``doc_id``, ``source``, ``size`` (long) and, if wished, other narrow columns, which stay. ``weights``: ``source``,
    ``weight`` (long, 0 or more), each source once; a source without a weight has 0. Adds ``weight``, ``source_size``, ``target``,
    ``epochs`` (times that the document is taken whole) and ``taken`` (words taken in all, repeats counted). The words taken of a
    source are its target to the nearest whole number, and each document's are at most ``most`` times its size.

    A null source is a source like any other. A null size is 0, and documents without words take nothing. The key of a document
    is a hash of ``seed`` and its id (null: an empty one); repeated rows of one id and size stand side by side and are
    mixed one by one, so which of them is cut doesn't show. Empty tables give none.
    """
    clash = {"weight", "source_size", "target", "epochs", "taken", "before", "start", "budget", "key"} & {c.lower() for c in rows.columns}
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    path = folder(rows.sparkSession)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = rows.withColumns({"size": F.coalesce(F.col("size").cast("long"), F.lit(0)), "key": key})
    keyed = written(keyed, f"{path}/keyed")
    sources = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    given = weights.select(F.col("source").alias("__source"), "weight")
    sources = sources.join(given, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    sources = written(sources.withColumn("weight", F.coalesce("weight", F.lit(0)).cast("long")), f"{path}/sized")
    aimed = sums_before(targets(sources, most), _by_source(), {"start": F.col("source_size")}, f"{path}/aimed")
    aimed = small(written(aimed.withColumnRenamed("source", "__source"), f"{path}/targets"))
    placed = sums_before(keyed, [*_by_source(), F.col("key"), F.col("doc_id"), F.col("size")], {"before": F.col("size")}, f"{path}/placed")
    joined = placed.join(aimed, F.col("source").eqNullSafe(F.col("__source")))
    joined = joined.withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
    joined = joined.withColumn("epochs", F.coalesce(F.expr("budget div nullif(source_size, 0)"), F.lit(0)))
    ahead = F.col("budget") - F.col("epochs") * F.col("source_size") - (F.col("before") - F.col("start"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), ahead))
    out = joined.withColumn("taken", F.col("epochs") * F.col("size") + part)
    return out.select(*rows.columns, "weight", "source_size", "target", "epochs", "taken")


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row with ``epoch`` (0, 1, ...) for each time that a document of ``mix`` is taken, where ``text`` was among the
    columns. In the one document of a source where the budget ends, the text is cut after the last word taken."""
    times = F.expr("cast(ceil(taken / size) as int)")
    each = mixed.where("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    words = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")).cast("int")
    found = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*+{WORD}"), F.lit(0))
    return each.withColumn("text", F.when(words < F.col("size"), F.array_join(F.slice(found, F.lit(1), words), "")).otherwise(F.col("text")))

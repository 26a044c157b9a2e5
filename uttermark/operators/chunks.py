"""Tables of error chunks and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttermark.keys import UNDERPOWERED


def exploded(rows: DataFrame) -> DataFrame:
    return rows.select("slurp_id", "degradation", F.explode("error_categories").alias("c"))


def error_subtype_table(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by subtype (substitutions) or type (gaps) and position, with distinct utterances, per level of ``by``."""
    kind = F.when(F.col("c.type") == "substitute", F.coalesce("c.error_subtype", F.lit("substitute"))).otherwise(F.col("c.type"))
    keys = [*(by or []), kind.alias("kind"), F.col("c.slot_position").alias("position")]
    return exploded(rows).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slurp_id").alias("utterances"))


def exploratory_cells(table: DataFrame) -> DataFrame:
    """Occupied cells of a table that are too small for more than exploration."""
    return table.where(F.col("n") < UNDERPOWERED)


def annotation_summary(rows: DataFrame) -> DataFrame:
    """Chunks by subtype or type, by position, and rows with any."""
    kind = F.coalesce("c.error_subtype", F.col("c.type"))
    # one pass: a row's empty outer chunk counts nothing, its first one counts the row
    chunk = rows.select(F.posexplode_outer("error_categories").alias("at", "c"))
    n = chunk.groupBy(kind.alias("kind"), F.col("c.slot_position").alias("position")).agg(F.count("at").alias("n"), F.count(F.when(F.col("at") == 0, 1)).alias("rows"))
    level = lambda by, value, n: F.struct(F.lit(by).alias("by"), value.alias("value"), n.alias("n"))
    three = F.array(level("kind", F.col("kind"), F.col("n")), level("position", F.col("position"), F.col("n")), level("rows", F.lit("with_errors"), F.col("rows")))
    long = n.select(F.explode(three).alias("x"), (F.col("n") > 0).alias("some")).where("some or x.by = 'rows'")
    return long.groupBy("x.by", "x.value").agg(F.sum("x.n").alias("n"))


def failure_tallies(rows: DataFrame) -> DataFrame:
    """Counts of every kind of wrong intent and wrong parameters."""
    long = rows.select(F.explode(F.array(F.struct(F.lit("tsh").alias("of"), F.col("tsh").alias("label")), F.struct(F.lit("tch").alias("of"), F.col("tch").alias("label")))).alias("x"))
    return long.select("x.*").where("label is not null").groupBy("of", "label").agg(F.count(F.lit(1)).alias("n"))

"""Evaluation rows, gold annotations and logs as files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from uttermark.schema import GOLD, evaluation_schema

CORRUPT = "_corrupt"


def read_rows(spark: SparkSession, paths: list[str] | str, partitions: int | None = None) -> DataFrame:
    """Evaluation rows from JSON Lines files, plain or gzipped; unreadable lines are kept in ``_corrupt``. ``file``, ``block``
    (where the part of the file begins) and ``line`` (rising within it) order the rows as they stand in the files.

    A gzipped file is read by one task, so ``partitions`` spreads its rows afterwards.
    """
    rows = spark.read.schema(evaluation_schema(CORRUPT)).option("columnNameOfCorruptRecord", CORRUPT).json(paths)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = rows.withColumn("line", F.monotonically_increasing_id())
    return rows.repartition(partitions) if partitions else rows


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD).json(path).where("slurp_id is not null")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


# Patterns of whole names of result files.
KINDS = [
    ("omni", r"^omni_(qwen|gemma)_sweep_scored\.jsonl$"),
    ("sweep", r"^cascade_whisper_(qwen9b|qwen27b|gemma31b)_[a-z]+(_snr\d+)?_scored\.jsonl$"),
    ("sweep", r"^parakeet_[a-z]+(_snr\d+)?_(qwen9b|qwen27b|gemma31b)_scored\.jsonl$"),
    ("pilot", r"^h2a_pilot_.*_scored\.jsonl$"),
    ("pilot", r"^omni_pilot_.*_scored\.jsonl$"),
    ("baseline", r"^baseline_.*_scored\.jsonl$"),
]


def file_kind(path: Column) -> Column:
    """Kind of a result file by its name, or null."""
    name = F.element_at(F.split(path, "/"), -1)
    return reduce(lambda c, k: F.when(name.rlike(k[1]), k[0]) if c is None else c.when(name.rlike(k[1]), k[0]), KINDS, None)


def select_result_set(rows: DataFrame, kinds: list[str], column: str = "file") -> DataFrame:
    """Rows of files of some kinds; a file without a kind raises."""
    kind = F.coalesce(file_kind(F.col(column)), F.raise_error(F.concat(F.lit("unclassified file "), F.col(column))).cast("string"))
    return rows.where(kind.isin(kinds))


def refuse_in_place(spark: SparkSession, source: str, target: str) -> None:
    """Raise when a job would write where it reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def qualified(p: str) -> str:
        path = jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(conf).makeQualified(path).toString().rstrip("/")

    if qualified(source) == qualified(target):
        raise ValueError(f"output would overwrite its input {source}")


def write_rows(rows: DataFrame, path: str, source: str | None = None, fmt: str = "json") -> None:
    """Write scored rows, one folder for each degradation."""
    if source:
        refuse_in_place(rows.sparkSession, source, path)
    rows.write.mode("overwrite").partitionBy("degradation").format(fmt).save(path)


def write_table(table: DataFrame, path: str) -> bool:
    """Write a small result table to one CSV file; an empty one is not written."""
    if table.isEmpty():
        return False
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return True


def split_failures(rows: DataFrame, failed: Column, path: str, sidecar: str, run: str = "0") -> None:
    """Write usable rows to ``path`` and failed ones to ``sidecar``, each into a folder of this ``run``, which a repeated
    run replaces; a null mark counts as usable."""
    bad = F.coalesce(failed, F.lit(False))
    kept = rows.persist()
    try:
        kept.where(~bad).write.mode("overwrite").parquet(f"{path}/run={run}")
        kept.where(bad).write.mode("overwrite").parquet(f"{sidecar}/run={run}")
    finally:
        kept.unpersist()

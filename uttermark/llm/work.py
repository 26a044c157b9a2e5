"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: dict[str, list[str]] = {}  #: folders of each Spark application
BROADCAST_ROWS = 500_000  #: most narrow rows that are sent to all executors


def folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode, else an
    error, since executors would not share it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='uttermark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Remove all intermediate tables of this application, and return how many folders went.

    For when the results have been written: rows that a query has returned are still read from these tables.
    """
    found = _MADE.pop(spark.sparkContext.applicationId, [])
    conf, gone = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for folder_name in found:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder_name)
        gone += path.getFileSystem(conf).delete(path, True)
    return gone


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it again, which cuts its lineage."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drawn(rows: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows of a narrow table, by a hash of ``key``; the same rows whatever the partitions."""
    return rows.orderBy(F.xxhash64(key), key).limit(n)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``rows`` rows, else as it is, to be shuffled."""
    return F.broadcast(df) if df.count() <= rows else df

"""Newly arrived row files are scored once each and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from uttermark.functions import params as P
from uttermark.keys import RESUME
from uttermark.operators.pairs import skip_done


KEY_PARTS = 64


def score(rows: DataFrame) -> DataFrame:
    """Parameter recall and success of rows with intents and parameters; row-local, for batch and stream."""
    pf, n, matched = P.param_recall(F.col("gold_parameters"), F.col("predicted_parameters"))
    rows = rows.withColumns({"tsa": (F.col("predicted_intent") == F.col("gold_intent")).cast("int"), "pf": pf, "pf_n_gold": n, "pf_n_matched": matched})
    return rows.withColumns({"ees": P.ees(F.col("tsa"), F.col("pf")), "ees_strict": P.ees(F.col("tsa"), F.col("pf"), 1.0)})


def incremental_scoring(spark: SparkSession, schema: StructType, source: str, sink: str, failures: str, checkpoint: str) -> StreamingQuery:
    """Score the files that have come since the last run and stop. Rows without an answer go to ``failures`` and
    may come again; a key that already has a result in ``sink`` is skipped.

    Each batch writes into folders of its own, which it replaces when it is repeated. The keys of finished rows stand
    apart from the results (``sink`` + ``_keys``), dealt by a hash, and a batch reads those with its own hashes only.
    """
    arrived = spark.readStream.schema(schema).json(source)
    keys = f"{sink.rstrip('/')}_keys"
    dealt = F.pmod(F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in RESUME)), F.lit(KEY_PARTS)).cast("int")

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            failed = F.col("predicted_intent").isNull()
            batch.where(failed).write.mode("overwrite").parquet(f"{failures}/batch={number}")
            usable = score(batch.where(~failed)).dropDuplicates(RESUME).withColumn("part", dealt)
            known = StructType([*(usable.schema[k] for k in RESUME), StructField("batch", IntegerType()), StructField("part", IntegerType())])
            try:
                done = spark.read.schema(known).parquet(keys)
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                done = usable.withColumn("batch", F.lit(-1)).limit(0)
            parts = [r["part"] for r in usable.select("part").distinct().collect()]  # KEY_PARTS at most
            new = skip_done(usable, done.where(F.col("part").isin(parts) & (F.col("batch") != number)), RESUME)
            new.drop("part").write.mode("overwrite").parquet(f"{sink}/batch={number}")
            written = spark.read.schema(usable.drop("part").schema).parquet(f"{sink}/batch={number}")
            written.select(*RESUME, dealt.alias("part")).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{keys}/batch={number}")
        finally:
            batch.unpersist()

    return arrived.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_scoring(spark: SparkSession, schema: StructType, source: str, sink: str, failures: str, checkpoint: str, remember: str = "30 days") -> tuple[StreamingQuery, StreamingQuery]:
    """Score the files that have come since the last run and stop, with the keys of finished rows in the stream's own state.

    A row with an answer is scored if its key has not been scored within ``remember``; its key is then held in the state store, on
    disk, and checkpointed, so a restart goes on with it. Rows without an answer go to ``failures`` and hold no key: they may come
    again. Time is that of the batch in which a row arrives, so no row is late and none is dropped for its age. A key is
    forgotten when the stream has run for at least ``remember``, and at most twice that, after it came: the state holds the keys of
    that time and no more, whatever the length of the stream, dealt by key over the shuffle partitions of the first run. A key that
    comes back later is scored again; ``incremental_scoring`` asks the results themselves and never forgets.

    Both sinks are written exactly once, by the commit logs of their folders. Returns the query of results and that of failures.
    """
    arrived = spark.readStream.schema(schema).json(source)
    failed = F.col("predicted_intent").isNull()
    answered = score(arrived.where(~failed)).withColumn("scored_at", F.current_timestamp())
    once = answered.withWatermark("scored_at", remember).dropDuplicatesWithinWatermark(RESUME)

    def start(rows: DataFrame, path: str, name: str) -> StreamingQuery:
        out = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{checkpoint.rstrip('/')}/{name}")
        return out.outputMode("append").trigger(availableNow=True).start()

    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)  # a query takes its settings when it starts
    try:
        results = start(once, sink, "results")
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
    return results, start(arrived.where(failed), failures, "failures")


def state_size(query: StreamingQuery) -> dict[str, int]:
    """Keys that the query's state held after its last batch, the bytes of memory they took, and rows that it dropped as late."""
    found = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    last = found[-1] if found else {"numRowsTotal": 0, "memoryUsedBytes": 0}
    late = sum(p["numRowsDroppedByWatermark"] for p in found)
    return {"keys": last["numRowsTotal"], "bytes": last["memoryUsedBytes"], "late": late}

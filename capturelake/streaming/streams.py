"""Structured Streaming forms of the polling jobs.

Sinks are written once per micro-batch under the batch id, so a replayed
batch overwrites its own output and nothing is stored twice.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from capturelake.operators.merge import top_per_key
from capturelake.operators.structure import route_captures, to_notes, to_tasks


def stream_table(spark: SparkSession, directory: str, name: str, schema: StructType | None = None) -> DataFrame:
    """A stored table as a stream: one file, or a folder of files.

    Without a schema that of the stored table is read once.  The braces make
    the path a pattern, which a stream accepts for a single file as well.
    """
    path = f"{directory}/{name}.parquet"
    known = schema or spark.read.parquet(path).schema
    return spark.readStream.schema(known).option("recursiveFileLookup", "true").parquet(f"{directory}/{{{name}.parquet}}")


def first_seen(rows: DataFrame, key: list[str], event_time: str | None = None, watermark: str | None = None) -> DataFrame:
    """Rows whose key no earlier row of the stream had.

    The state store holds the keys alone.  With an event time and a watermark,
    keys are forgotten that long after their event, which bounds the state; a
    copy that comes later than that counts as new.  Of rows that share a key
    within one batch one stays, so they should be copies.
    """
    if watermark is None:
        return rows.dropDuplicates(key)
    return rows.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(key)


def stream_structure(
    captures: DataFrame, sink: str, checkpoint: str, as_of: datetime, trigger: dict | None = None, watermark: str | None = None
):
    """Routes new captures into notes, tasks and blocked rows below ``sink``.

    A capture that comes again is dropped by the state of seen ids (see
    ``first_seen``), which commits with the batch; a batch reads only its own
    rows, and a replayed one starts from the same state and writes over its
    own output.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        routed_path = f"{sink}/routed/batch={batch_id}"
        route_captures(batch).write.mode("overwrite").parquet(routed_path)
        routed = spark.read.parquet(routed_path)
        to_notes(routed, as_of, stored=True).write.mode("overwrite").parquet(f"{sink}/notes/batch={batch_id}")
        to_tasks(routed, as_of, stored=True).write.mode("overwrite").parquet(f"{sink}/tasks/batch={batch_id}")

    return _start(first_seen(captures, ["capture_id"], "created_at", watermark), write, checkpoint, trigger)


def stream_cost(requests: DataFrame, sink: str, checkpoint: str, watermark: str = "1 day", trigger: dict | None = None):
    """Daily cost buckets, written once the watermark has closed a day."""
    timed = requests.withColumn("created_at", F.col("created_at").cast("timestamp"))
    buckets = (
        timed.withWatermark("created_at", watermark)
        .groupBy(F.window("created_at", "1 day").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("request_count"),
            F.count_if(F.col("status") == "ok").alias("ok_count"),
            F.sum("total_tokens").alias("total_tokens"),
            F.sum("request_cost_usd").alias("total_cost_usd"),
        )
        .select(F.col("w.start").alias("period_start"), "request_count", "ok_count", "total_tokens", "total_cost_usd")
    )
    return (
        buckets.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_latest(
    rows: DataFrame, sink: str, checkpoint: str, key: list[str], updated: str, tie: str, trigger: dict | None = None
):
    """Stores the newest row per key of every batch; ``read_latest`` merges.

    A batch costs what it holds and not what was stored before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = top_per_key(batch, key, [F.desc(updated), F.desc(tie)])
        newest.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return _start(rows, write, checkpoint, trigger)


def read_latest(spark: SparkSession, sink: str, key: list[str], updated: str, tie: str) -> DataFrame:
    """Last write per key over all batches; on a tie the later batch wins."""
    rows = spark.read.parquet(sink)
    return top_per_key(rows, key, [F.desc(updated), F.desc("batch"), F.desc(tie)]).drop("batch")


def _start(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None):
    return (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

"""Structured Streaming shells around the folds: event windows with watermarks, and state merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft.operators.state import fold_source_health
from newsweft.plans.catalog import query
from newsweft.plans.relations import Relations


def event_windows(events: DataFrame, length: str = "1 day", late: str | None = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total): tumbling event-time counts, on a stream or a table."""
    if late is not None:
        events = events.withWatermark("ts", late)
    g = events.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query("event_windows", "select date_trunc('day', ts) as window_start, event_type, cast(count(*) as bigint) as n, round(sum(value), 4) as total from events group by all")
def _q_windows(r: Relations) -> DataFrame:
    rows = event_windows(r.events.withColumn("ts", F.col("ts").cast("timestamp")), late=None)
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A file stream of the append-only event log."""
    return spark.readStream.schema(schema).parquet(folder)


def run_health_stream(runs: DataFrame, state_path: str, checkpoint: str):
    """Merge a stream of crawl runs into versioned state tables under ``state_path`` and stop when there is no more.

    Each batch reads the version before it and writes its own, named by the batch id: a batch that is run again after
    a lost executor writes the same version from the same input.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        prior = spark.read.parquet(f"{state_path}/v{batch_id - 1}") if batch_id else None
        fold_source_health(batch, prior).write.mode("overwrite").parquet(f"{state_path}/v{batch_id}")

    return runs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Incremental jobs with Structured Streaming: resume, latest rows, stall detection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def process_new(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Run ``work`` on the files that arrived since the last call, then stop.

    The checkpoint remembers the files done; a call after a failure repeats its batch whole, so
    the result equals one full run.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    running = work(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()


def upsert_new(spark: SparkSession, source: str, schema: str, key: str, version: str, read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], checkpoint: str) -> None:
    """Merge arriving rows into a keyed table; the row with the highest version of a key stays."""

    def merge(batch: DataFrame, _: int) -> None:
        old = read()
        rows = batch if old is None else old.unionByName(batch)
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), version).alias("r")).select("r.*")
        write(newest)

    running = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()


def growth(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows by kind and time window; state older than the watermark is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def stalled(counts: list[int], polls: int = 6) -> bool:
    """Whether the last ``polls`` polls brought no growth."""
    return len(counts) > polls and counts[-1] <= counts[-1 - polls]


def first_stall(polls: DataFrame, kind: str, order: list[str], count: str, patience: int = 6) -> DataFrame:
    """``(kind, polls, stalled_at)``: the first poll that ends ``patience`` polls without a new maximum; null if none does."""
    place = Window.partitionBy(kind).orderBy(*order)
    before = F.max(count).over(place.rowsBetween(Window.unboundedPreceding, -1))
    grown = polls.withColumn("__n", F.row_number().over(place)).withColumn("__grew", (F.col(count) > F.coalesce(before, F.lit(float("-inf")))).cast("int"))
    last = F.max(F.when(F.col("__grew") == 1, F.col("__n"))).over(place.rowsBetween(Window.unboundedPreceding, 0))
    idle = grown.withColumn("__idle", F.col("__n") - last)
    return idle.groupBy(kind).agg(F.count(F.lit(1)).alias("polls"), F.min(F.when(F.col("__idle") >= patience, F.col("__n"))).alias("stalled_at"))

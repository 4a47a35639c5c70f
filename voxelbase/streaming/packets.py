"""Ordered projection packets with Structured Streaming.

A stream of frames (view, data) becomes partial volumes, one partition of a
table for each micro-batch, so a batch that is run again replaces its own part
and nothing is counted twice. The volume is the sum of the parts. Packets may
hold any number of views; filtering depends on the scan, not on the packet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelbase.operators.geometry import Scan
from voxelbase.operators.projector import Grid
from voxelbase.plans import fdk


def check_packets(packets: DataFrame) -> DataFrame:
    """(first_view, view_count) in order of arrival: each must start where the last ended; else the query stops."""
    w = Window.orderBy("first_view")
    expected = F.coalesce(F.sum("view_count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fault = F.when(F.col("first_view") != expected, F.raise_error(F.concat(F.lit("packet starts at "), F.col("first_view").cast("string"))).cast("boolean")).otherwise(True)
    return packets.withColumn("received", expected + F.col("view_count")).withColumn("ok", fault).where("ok").drop("ok")


def start(frames: DataFrame, geometry: DataFrame, scan: Scan, grid: Grid, parts: str, checkpoint: str, window: str = "ram_lak"):
    """Run a stream of weighted frames to its present end; returns the finished query."""

    def one(batch: DataFrame, number: int) -> None:
        filtered = fdk.filter_frames(batch, scan, window)
        fdk.back_project(filtered, geometry, scan, grid).write.mode("overwrite").parquet(f"{parts}/batch={number}")

    query = frames.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def volume(spark: SparkSession, parts: str) -> DataFrame:
    return spark.read.schema("voxel_id long, value double, batch long").parquet(parts).groupBy("voxel_id").agg(F.sum("value").alias("value"))


def complete(spark: SparkSession, received: DataFrame, scan: Scan) -> bool:
    """Whether every view has come."""
    return received.select("view").distinct().count() == scan.views


def rolling(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of a stream of (ts, event_type, value) per window, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")

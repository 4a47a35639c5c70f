"""Scan tables drawn from the driver's tables: frames, volumes, air, events as packets.

A projection frame is one row of ``embeddings`` (view = vec_id, one detector
row of 64 pixels); a volume's attenuation comes from ``part`` by voxel number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AIR = 1.5


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(view, label, data array<double>): one frame a row, as energies below air."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("view"), "label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("data"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(view, label, u, value) of every pixel."""
    return frames(spark, sf_dir).select("view", "label", F.posexplode("data").alias("u", "value"))


def volume(spark: SparkSession, sf_dir: str, nx: int, ny: int, nz: int) -> DataFrame:
    """(voxel_id, value): attenuation of the grid's voxels, each the mean over the parts that number falls to (the whole table)."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.groupBy((F.col("p_partkey") % (nx * ny * nz)).alias("voxel_id")).agg((F.avg("p_size") / 1000.0).alias("value"))

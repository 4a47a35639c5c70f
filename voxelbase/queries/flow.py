"""Streams, sources and sinks, each read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelbase.functions.scalar import tidy
from voxelbase.functions.scratch import scratch_path
from voxelbase.operators import geometry as G
from voxelbase.operators import projector as J
from voxelbase.plans import fdk
from voxelbase.sources.raw import RawFloat32
from voxelbase.sources.tables import frames
from voxelbase.sources.text import read_frames, read_spectrum, write_frames
from voxelbase.streaming import packets

from .pointwise import PX
from .recon import FDK_SQL, GRID, SCAN, data, geo_sql

R = lambda e, n=6: f"(round({e}, {n}) + 0.0)"
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("stream_fdk_packets", FDK_SQL)
def _(spark, d):
    geometry = G.flat_geometry(spark, SCAN)
    _, b = data(spark, d)
    px = J.rays(geometry, SCAN).join(b, "ray_id", "left").select("view", "v", "u", F.coalesce("value", F.lit(0.0)).alias("value"))
    ready = fdk.to_frames(fdk.preweight(px, SCAN), SCAN)
    path = scratch_path(spark, "packets")
    ready.repartition(3, "view").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(ready.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    packets.start(stream, geometry, SCAN, GRID, f"{path}/parts", f"{path}/checkpoint")
    return packets.volume(spark, f"{path}/parts").select("voxel_id", tidy(F.col("value")).alias("value"))


@query("packet_order", "SELECT first_view, view_count, first_view + view_count AS received FROM (VALUES (0::bigint, 1::bigint), (1, 7), (8, 5)) t(first_view, view_count)")
def _(spark, d):
    return packets.check_packets(spark.createDataFrame([(0, 1), (1, 7), (8, 5)], "first_view long, view_count long"))


@query("stream_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY ALL")
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("ts", "event_type", "value")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events*.parquet")
    path = scratch_path(spark, "windows")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/parts/batch={number}")

    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    q = packets.rolling(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{path}/parts")
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == last).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", tidy(F.col("total"), 4).alias("total"))


@query("raw_round_trip", f"WITH {PX} SELECT view, u, {R('value')} AS value FROM px")
def _(spark, d):
    spark.dataSource.register(RawFloat32)
    path = scratch_path(spark, "raw")
    rows = frames(spark, d).select("view", F.transform("data", lambda x: x.cast("float")).alias("data"))
    rows.repartitionByRange(4, "view").sortWithinPartitions("view").write.format("raw_float32").mode("append").save(path)
    back = spark.read.format("raw_float32").option("frame", 64).option("views_per_partition", 100).load(path)
    return back.select("view", F.posexplode("data").alias("u", "v")).select("view", "u", tidy(F.col("v").cast("double")).alias("value"))


@query("frame_table_round_trip", f"WITH {geo_sql(SCAN)} SELECT view::int AS view, {R('sx')} AS x, {R('sy')} AS y, {R('60 * cos(a)')} AS cy FROM geo")
def _(spark, d):
    path = scratch_path(spark, "frames")
    write_frames(G.scanner_frames(spark, SCAN).select("view", "src", "centre", "u", "v"), path)
    rows = G.check_frames(read_frames(spark, path))
    return rows.select("view", tidy(F.col("src.x")).alias("x"), tidy(F.col("src.y")).alias("y"), tidy(F.col("centre.y")).alias("cy"))


@query("spectrum_round_trip", "SELECT p_size::double AS energy, round(sum(p_retailprice), 4) + 0.0 AS fluence FROM part GROUP BY p_size")
def _(spark, d):
    path = scratch_path(spark, "spectrum")
    s = spark.read.parquet(f"{d}/part.parquet").groupBy("p_size").agg(F.sum("p_retailprice").alias("f"))
    s.select(F.concat_ws(" ", F.col("p_size").cast("string"), F.format_string("%.17g", "f"), F.lit("1.0"))).write.text(path)
    return read_spectrum(spark, path).select("energy", tidy(F.col("fluence"), 4).alias("fluence"))

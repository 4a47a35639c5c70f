"""What SQL does not state: exact relations, faults, round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelbase import catalog
from voxelbase.functions import scalar as S
from voxelbase.operators import geometry as G
from voxelbase.operators import lookup as L
from voxelbase.operators import projector as J
from voxelbase.operators.geometry import Scan
from voxelbase.operators.projector import Grid
from voxelbase.plans import fdk
from voxelbase.sources.raw import RawFloat32
from voxelbase.streaming import packets

SF = "/root/testdata/sf0.001"


def _hash32(x):
    m = 0xFFFFFFFF
    x ^= x >> 16
    x = x * 0x7FEB352D & m
    x ^= x >> 15
    x = x * 0x846CA68B & m
    return x ^ x >> 16


def test_hash_is_the_32_bit_mix(spark):
    rows = spark.range(1000).select((F.col("id") * 4294967 % 4294967296).alias("x")).select("x", S.hash32(F.col("x")).alias("h")).collect()
    assert all(r.h == _hash32(r.x) for r in rows)


def test_bessel_and_kaiser(spark):
    xs = np.linspace(0, 20, 60)
    rows = spark.createDataFrame([(float(x),) for x in xs], "x double").select(S.bessel_i0(F.col("x")).alias("y")).collect()
    assert np.allclose([r.y for r in rows], np.i0(xs), rtol=1e-6)


def test_pchip_is_monotone_and_meets_its_knots(spark):
    knots = [(0.0, 0.0), (1.0, 0.1), (2.0, 2.0), (3.0, 2.1)]
    xs = [i / 50 for i in range(151)]
    y = [r.y for r in spark.createDataFrame([(x,) for x in xs], "x double").select(L.pchip(F.col("x"), knots).alias("y")).collect()]
    assert all(b >= a - 1e-12 for a, b in zip(y, y[1:]))
    assert np.allclose([y[0], y[50], y[100], y[150]], [0.0, 0.1, 2.0, 2.1])


def test_required_join_stops_on_missing_label(spark):
    rows, table = spark.createDataFrame([(1,), (2,)], "label int"), spark.createDataFrame([(1, "a")], "label int, name string")
    with pytest.raises(Exception, match="no entry for label 2"):
        L.join_required(rows, table, "label").collect()


def test_packet_out_of_order_stops(spark):
    with pytest.raises(Exception, match="packet starts at 9"):
        packets.check_packets(spark.createDataFrame([(0, 8), (9, 1)], "first_view long, view_count long")).collect()


def test_axis_parallel_rays_cross_the_grid(spark):
    ray = "struct<x:double,y:double,z:double>"
    rows = spark.createDataFrame([(0, (-10.0, 0.5, 0.5), (10.0, 0.5, 0.5)), (1, (-10.0, 9.0, 0.5), (10.0, 9.0, 0.5))], f"ray_id long, src {ray}, dst {ray}")
    got = J.siddon(rows, Grid(4, 4, 4)).collect()
    assert {r.ray_id for r in got} == {0} and len(got) == 4 and all(abs(r.weight - 1) < 1e-12 for r in got)


def test_fdk_of_a_ball_has_its_attenuation(spark):
    scan, grid = Scan(views=60, nu=32, nv=16, du=1.6, dv=1.6, sid=200.0, sdd=400.0), Grid(16, 16, 4)
    geometry = G.flat_geometry(spark, scan)
    inside = grid.voxels(spark).where((F.col("ix") - 7.5) ** 2 + (F.col("iy") - 7.5) ** 2 <= 36).select("voxel_id", F.lit(0.02).alias("value"))
    b = J.forward(J.siddon(J.rays(geometry, scan), grid), inside)
    px = J.rays(geometry, scan).join(b, "ray_id", "left").select("view", "v", "u", F.coalesce("value", F.lit(0.0)).alias("value"))
    out = fdk.reconstruct(px, geometry, scan, grid).join(grid.voxels(spark), "voxel_id").where("ix between 6 and 9 and iy between 6 and 9 and iz between 1 and 2")
    assert abs(out.agg(F.avg("value")).first()[0] - 0.02) < 0.0012


def test_raw_source_rejects_partial_frames(spark, tmp_path):
    spark.dataSource.register(RawFloat32)
    (tmp_path / "a.raw").write_bytes(np.zeros(10, "<f4").tobytes())
    with pytest.raises(Exception, match="not whole frames"):
        spark.read.format("raw_float32").option("frame", 4).load(str(tmp_path)).collect()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_queries_without_sql_run(spark, name):
    rows = catalog.QUERIES[name](spark, SF)
    assert rows.count() > 0 and len(set(rows.columns)) == len(rows.columns)


def test_formulas_with_nested_groups():
    from voxelbase.operators.relate import atom_counts

    assert atom_counts("Ca10(PO4)6(OH)2") == {"Ca": 10, "P": 6, "O": 26, "H": 2}
    assert atom_counts("Fe2(C(H2O)3)2") == {"Fe": 2, "C": 2, "H": 12, "O": 6}
    for wrong in ("H2O)", "(H2", "h2o"):
        with pytest.raises(ValueError):
            atom_counts(wrong)


def test_nearest_sorts_places_and_makes_no_pairs(spark):
    from voxelbase.operators import select as O

    rng = np.random.default_rng(1)
    x, b = np.round(rng.uniform(-60, 60, 400), 1), np.round(np.concatenate([rng.uniform(-60, -40, 30), rng.uniform(40, 60, 30)]), 1)
    points = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(400, None), (401, float("nan")), (402, 1e9), (3, 59.0)], "k long, x double")
    targets = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)] + [(60, None), (61, float("nan"))], "bead long, bx double")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many ranges as partitions, some without targets
    try:
        out = O.nearest(points, targets, 35.0)
        got = {r.k: r.bead for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = {}
    for k, v in [*enumerate(x), (3, 59.0)]:
        d, bead = min((abs(v - c), i) for i, c in enumerate(b))
        if d <= 35:
            want[k] = min(want.get(k, (d, bead)), (d, bead))
    assert got == {k: bead for k, (_, bead) in want.items()} and len(got) < 400
    # A target for each point at the same two places would be 4 million pairs of a cell.
    many = spark.range(20000).select(F.col("id").alias("k"), (F.col("id") % 2 * 0.5).alias("x"))
    crowd = spark.range(20000).select((20000 - F.col("id")).alias("bead"), (F.col("id") % 2 * 0.5).alias("bx"))
    out = O.nearest(many, crowd, 35.0)
    assert sorted(map(tuple, out.groupBy("bead").count().collect())) == [(1, 10000), (2, 10000)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Explode" not in plan and "explode" not in plan


def test_median_is_exact_and_bounded(spark):
    from voxelbase.operators import measure as M

    rng = np.random.default_rng(2)
    for n, held in ((1, 4), (2, 4), (999, 10), (20000, 7), (20001, 1 << 16)):
        values = rng.normal(size=n) ** 2
        values[: n // 3] = values[0]
        rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        assert M.median(rows, F.col("x"), held) == np.median(values)
    rows = spark.range(3000).select((F.col("id") * 1.0).alias("x"))
    assert M.median(rows, F.col("x"), 5, near=1e-9) == 1499.5 and M.median(rows, F.lit(2.0), 1) == 2.0

"""Helical and footprint reconstruction beyond what SQL states: phantoms, both bed directions, halos, transposes, spacing."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelbase.functions.scratch import settle
from voxelbase.operators import footprint
from voxelbase.operators import geometry as G
from voxelbase.operators import projector as J
from voxelbase.operators.geometry import Scan
from voxelbase.operators.projector import Grid
from voxelbase.plans import fdk, halo, helical, orbit, shares, xfdk
from voxelbase.streaming import halo as stream_halo
from voxelbase.streaming import protocol


def frames_of(spark, scan, grid, volume):
    geometry = G.flat_geometry(spark, scan)
    rays = J.rays(geometry, scan)
    px = rays.join(J.forward(J.siddon(rays, grid), volume), "ray_id", "left").select("view", "v", "u", F.coalesce("value", F.lit(0.0)).alias("value"))
    return fdk.to_frames(px, scan)


@pytest.mark.parametrize("pitch", [-6.0, 6.0])
def test_helical_cylinder_has_its_attenuation(spark, pitch):
    """A cylinder along the axis, either way of the bed, from a start off zero and a shifted detector."""
    scan = Scan(views=160, nu=48, nv=12, du=1.0, dv=1.0, sid=200.0, sdd=400.0, per_turn=64, start=0.37, pitch=pitch, start_z=7.0 + pitch, offset=(0.5, 0.0, 0.5))
    grid = Grid(20, 20, 6, (1.0, 1.0, 1.0), (0.0, 0.0, 7.0 + pitch - pitch * 80 / 64))
    tall = Grid(20, 20, 40, (1.0, 1.0, 1.0), grid.centre)
    disc = tall.voxels(spark).where("(ix - 9.5) * (ix - 9.5) + (iy - 9.5) * (iy - 9.5) <= 49").select("voxel_id", F.lit(0.02).alias("value"))
    out = helical.reconstruct(frames_of(spark, scan, tall, disc), scan, grid).join(grid.voxels(spark), "voxel_id")
    rows = out.toPandas()
    inside = rows[(rows.ix - 9.5) ** 2 + (rows.iy - 9.5) ** 2 <= 16]
    outside = rows[(rows.ix - 9.5) ** 2 + (rows.iy - 9.5) ** 2 >= 81]
    assert len(rows) == 20 * 20 * 6
    assert abs(inside.value.mean() - 0.02) < 0.0008 and inside.value.std() < 0.0015 and abs(outside.value.mean()) < 0.002


def test_no_readings_give_zeros_either_way(spark):
    for pitch in (24.0, -24.0):
        scan = Scan(views=192, nu=16, nv=8, du=1.0, dv=1.0, sid=500.0, sdd=1000.0, per_turn=64, start=0.37, start_z=11.0, pitch=pitch)
        frames = spark.range(192).select(F.col("id").alias("view"), F.array_repeat(F.lit(0.0), 128).alias("data"))
        assert [r.value for r in helical.reconstruct(frames, scan, Grid(8, 8, 8)).select("value").distinct().collect()] == [0.0]


def test_blocks_of_views_do_not_show(spark, monkeypatch):
    scan = Scan(views=200, nu=24, nv=3, du=2.0, dv=1.0, sid=60.0, sdd=120.0, per_turn=40, pitch=-3.0)
    rng = np.random.default_rng(5)
    frames = spark.createDataFrame([(i, rng.random(72).tolist()) for i in range(200)], "view long, data array<double>")

    def rows():
        return {r.view: r.data for r in helical.parallel_rebin(frames, scan).collect()}

    one = rows()
    monkeypatch.setattr(halo, "BLOCK", 1)
    other = rows()
    p = helical.parallel_scan(scan)
    assert sorted(one) == sorted(other) == list(range(p.views)) and p.views % p.half == 0
    assert all(np.allclose(one[v], other[v], atol=1e-12) for v in one)


def test_scans_that_are_no_helix_are_refused():
    good = Scan(views=200, nu=24, nv=3, du=2.0, dv=1.0, sid=60.0, sdd=120.0, per_turn=40, pitch=-3.0)
    for change in ({"pitch": 0.0}, {"direction": -1}, {"views": 30}, {"per_turn": 41}, {"offset": (100.0, 0.0, 0.0)}):
        with pytest.raises(ValueError):
            helical.parallel_scan(replace(good, **change))


def test_shares_of_many_slabs_and_parts(spark, monkeypatch):
    monkeypatch.setattr(shares, "SLAB", 6)
    monkeypatch.setattr(shares, "SALTS", 3)
    grid = Grid(2, 3, 4)
    assert shares.slab_depth(grid) == 1
    rows = [(s, p, [float(s + p)] * 6) for s in range(4) for p in range(10)]
    out = {r.voxel_id: r.value for r in shares.add_shares(spark.createDataFrame(rows, shares.SCHEMA).unionByName(shares.zero_shares(spark, grid, 1)), 6).collect()}
    assert out == {s * 6 + i: s * 10 + 45.0 for s in range(4) for i in range(6)}


SCAN = Scan(views=5, nu=20, nv=12, du=1.1, dv=0.9, sid=60.0, sdd=120.0, start=0.2, tilt=(0.05, -0.1, 0.2), offset=(0.7, 0.3, -0.4))


def dense(spark, scan, grid):
    """The matrix entry by entry, from boxes and pixels as they are defined."""
    out = np.zeros((scan.views * scan.nv * scan.nu, grid.nx * grid.ny * grid.nz))
    for view, p in footprint.view_matrices(G.flat_geometry(spark, scan)).items():
        for i in range(out.shape[1]):
            c = np.array([e + (k + 0.5) * s for k, e, s in zip((i % grid.nx, i // grid.nx % grid.ny, i // grid.nx // grid.ny), grid.edge, grid.voxel)])
            at = lambda x: (q := p @ np.append(x, 1.0))[:2] / q[2]
            slope = np.array([(at(c + d) - at(c - d)) / 2e-5 for d in np.eye(3) * 1e-5]).T  # (2, 3) by differences
            middle, half = at(c), np.abs(slope) @ np.array(grid.voxel) / 2
            weight = np.prod(grid.voxel) * np.linalg.norm(np.cross(slope[0], slope[1])) / (4 * half[0] * half[1])
            over = [np.clip(np.minimum(middle[k] + half[k], np.arange(n) + 0.5) - np.maximum(middle[k] - half[k], np.arange(n) - 0.5), 0, None) for k, n in ((0, scan.nu), (1, scan.nv))]
            out[view * scan.nv * scan.nu : (view + 1) * scan.nv * scan.nu, i] = weight * np.outer(over[1], over[0]).ravel()
    return out


def test_footprints_are_one_matrix_and_its_transpose(spark, monkeypatch):
    monkeypatch.setattr(footprint, "BLOCK", 16)
    monkeypatch.setattr(footprint, "VIEWS", 2)
    grid, rng = Grid(4, 3, 5, (1.5, 1.0, 0.7), (0.4, -0.3, 0.2)), np.random.default_rng(1)
    a, geometry = dense(spark, SCAN, grid), G.flat_geometry(spark, SCAN)
    x, y = rng.random(60), rng.random(a.shape[0])
    x[7:20] = 0
    fw = footprint.forward(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "voxel_id long, value double"), geometry, SCAN, grid).collect()
    assert np.allclose(np.concatenate([r.data for r in sorted(fw, key=lambda r: r.view)]), a @ x, atol=1e-7)
    frames = spark.createDataFrame([(v, y.reshape(5, -1)[v].tolist()) for v in range(5)], "view long, data array<double>")
    bk = footprint.back(frames, geometry, SCAN, grid).collect()
    assert np.allclose([r.value for r in sorted(bk, key=lambda r: r.voxel_id)], a.T @ y, atol=1e-7)


def test_footprints_agree_with_ray_lengths(spark):
    """Away from edges, footprint sums come close to exact ray lengths through a block."""
    scan, grid = Scan(views=6, nu=32, nv=16, du=1.0, dv=1.0, sid=200.0, sdd=400.0, start=0.3), Grid(12, 12, 6)
    ones = grid.voxels(spark).select("voxel_id", F.lit(1.0).alias("value"))
    fw = {r.view: np.array(r.data).reshape(16, 32) for r in footprint.forward(ones, G.flat_geometry(spark, scan), scan, grid).collect()}
    rays = {r.view: np.array(r.data).reshape(16, 32) for r in frames_of(spark, scan, grid, ones).collect()}
    for view, frame in fw.items():
        assert np.allclose(frame[6:10, 10:22], rays[view][6:10, 10:22], rtol=0.06)


def test_nothing_in_gives_zero_frames(spark):
    grid = Grid(4, 4, 4)
    out = footprint.forward(spark.createDataFrame([], "voxel_id long, value double"), G.flat_geometry(spark, SCAN), SCAN, grid).collect()
    assert len(out) == SCAN.views and not any(any(r.data) for r in out)


CIRCLE = Scan(views=24, nu=16, nv=6, du=1.6, dv=1.6, sid=60.0, sdd=120.0, start=0.2)


def test_extended_fdk_of_a_ball_and_of_the_cone_s_edge(spark):
    scan, grid = Scan(views=90, nu=40, nv=24, du=1.2, dv=1.2, sid=100.0, sdd=200.0, start=0.2), Grid(18, 18, 14)
    inside = grid.voxels(spark).where("(ix - 8.5) * (ix - 8.5) + (iy - 8.5) * (iy - 8.5) <= 36").select("voxel_id", F.lit(0.02).alias("value"))
    out = xfdk.reconstruct(frames_of(spark, scan, grid, inside), scan, grid).join(grid.voxels(spark), "voxel_id").toPandas()
    near = out[((out.ix - 8.5) ** 2 + (out.iy - 8.5) ** 2 <= 12) & out.iz.between(3, 10)]
    assert len(out) == 18 * 18 * 14 and abs(near.value.mean() - 0.02) < 0.001


def test_partial_scan_weights_of_opposite_rays_add_up():
    f = xfdk.fan_of(Scan(views=90, nu=40, nv=12, du=1.2, dv=1.2, sid=100.0, sdd=200.0))
    r, z = np.array([5.0, 20.0, 40.0, 45.0, 45.0]), np.array([1.0, 1.0, 2.2, 2.2, 2.9])
    room, turned = xfdk.coverage(f, r, z), np.linspace(-np.pi, np.pi, 721)[:-1, None]
    a, b = xfdk.ray_weight(f, r, z, turned), xfdk.ray_weight(f, r, z, turned + np.pi)
    assert (room[:2] == np.pi / 2).all() and (room[2:4] < 1.5).all() and room[4] < 0 and (a >= -1e-12).all()
    assert np.allclose((a + b)[:, room > 0], 2.0) and (a[:, room < 0] == 0).all()


def test_circles_with_offsets_are_refused():
    for change in ({"offset": (1.0, 0.0, 0.0)}, {"per_turn": 48}, {"pitch": 1.0}, {"tilt": (0.1, 0.0, 0.0)}, {"nv": 1}):
        with pytest.raises(ValueError):
            xfdk.fan_of(replace(CIRCLE, **change))


def test_stream_of_packets_equals_the_whole(spark, tmp_path, monkeypatch):
    """Packets of 1, 7 and 5 views, one sent twice, the last first; a restart between; blocks of four views round the circle."""
    monkeypatch.setattr(halo, "BLOCK", 4)
    rng, grid = np.random.default_rng(2), Grid(6, 6, 4)
    rows = [(i, rng.random(96).tolist()) for i in range(24)]
    schema = "view long, data array<double>"
    whole = {r.voxel_id: r.value for r in xfdk.reconstruct(spark.createDataFrame(rows, schema), CIRCLE, grid).collect()}
    path = str(tmp_path)
    for packet in ([rows[0]], rows[19:24], rows[1:8], rows[4:6], rows[8:13], rows[13:19]):
        spark.createDataFrame(packet, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        if packet[0][0] in (1, 4):
            continue  # two packets for one run
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        targets = stream_halo.gathered(xfdk.resampled(stream, CIRCLE), xfdk.gather_of(CIRCLE))
        stream_halo.reconstruct(targets, lambda b: xfdk.back_project(xfdk.filtered(b, CIRCLE), CIRCLE, grid), f"{path}/parts", f"{path}/checkpoint")
        got = {r.voxel_id: r.value for r in stream_halo.volume(spark, f"{path}/parts").collect()}
        if packet[0][0] != 13:
            assert max(abs(got.get(k, 0.0) - v) for k, v in whole.items()) > 1e-6  # not all views have come
    assert max(abs(got.get(k, 0.0) - v) for k, v in whole.items()) < 1e-12


STILL = Scan(views=20, nu=24, nv=24, du=1.0, dv=1.0, sid=60.0, sdd=100.0, start=0.4)


def still(spark):
    return settle(G.source_orbit(spark, STILL, 12.0, 45.0).withColumns({"origin_u": F.lit(5.0), "origin_v": F.lit(6.0)}))


@pytest.mark.parametrize("mode", ["rotated", "radial"])
def test_windows_see_what_their_own_frames_see(spark, mode):
    """A window's pixel and the detector's pixel that its map names lie on one ray from the source; steps fit the detector's in the middle."""
    centre = (0.5, -0.4, 0.3)
    geo = {r.view: r for r in still(spark).collect()}
    for r in orbit.windows(still(spark), 9, 7, mode, centre).collect():
        raw, h = geo[r.view], np.array(r.h).reshape(3, 3)
        v = lambda x: np.array([x.x, x.y, x.z])
        for u, w in ((0, 0), (8, 0), (3, 6), (4, 3)):
            x, y, q = h @ [u, w, 1]
            own, its = v(r.det_s) + u * v(r.det_u) + w * v(r.det_v) - v(r.src), v(raw.det_s) + x / q * v(raw.det_u) + y / q * v(raw.det_v) - v(raw.src)
            assert np.allclose(np.cross(own, its), 0, atol=1e-8) and own @ its > 0
        if mode == "radial":
            middle = v(r.det_s) + 4 * v(r.det_u) + 3 * v(r.det_v)
            assert np.allclose(np.cross(middle - v(r.src), np.array(centre) - v(r.src)), 0, atol=1e-8) and abs(v(r.det_u) @ v(r.det_v)) < 1e-9
            assert abs(np.linalg.norm((h @ [4.5, 3, 1])[:2] / (h @ [4.5, 3, 1])[2] - (h @ [3.5, 3, 1])[:2] / (h @ [3.5, 3, 1])[2]) - 1) < 1e-3


def test_window_off_the_detector_stops(spark):
    maps = orbit.windows(still(spark).withColumn("origin_u", F.lit(17.0)), 9, 7)
    with pytest.raises(Exception, match="window leaves the detector"):
        orbit.check_windows(maps, 9, 7, 24, 24).collect()
    assert orbit.check_windows(orbit.windows(still(spark), 9, 7), 9, 7, 24, 24).count() == 20


def test_plain_circle_is_the_same_either_way(spark):
    scan, grid, rng = Scan(views=16, nu=14, nv=6, du=1.6, dv=1.6, sid=60.0, sdd=120.0, start=0.2), Grid(6, 6, 4), np.random.default_rng(4)
    frames = spark.createDataFrame([(i, rng.random(84).tolist()) for i in range(16)], "view long, data array<double>")
    geometry = G.flat_geometry(spark, scan)
    px = frames.select("view", F.posexplode("data").alias("i", "value")).select("view", F.floor(F.col("i") / 14).alias("v"), (F.col("i") % 14).alias("u"), "value")
    a = {r.voxel_id: r.value for r in fdk.reconstruct(px, geometry, scan, grid).collect()}
    b = {r.voxel_id: r.value for r in orbit.reconstruct(frames, geometry, scan, grid).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_scan_protocol_fails_resets_and_goes_on(spark, tmp_path):
    """Two scans at once over five runs from one checkpoint."""
    path, frame = str(tmp_path), lambda first, n, size=4, value=1.0: [(first + i, [value * (first + i)] * size) for i in range(n)]
    runs = [
        [("a", 0, "packet", 0, frame(0, 1)), ("a", 1, "begin", None, None), ("a", 2, "packet", 0, frame(0, 2)), ("b", 0, "begin", None, None), ("b", 1, "packet", 0, frame(0, 3))],
        [("a", 2, "packet", 2, frame(2, 1)), ("a", 3, "begin", None, None), ("a", 5, "packet", 2, frame(2, 3)), ("a", 4, "complete", None, None), ("b", 2, "packet", 4, frame(4, 1)), ("b", 3, "packet", 3, frame(3, 2))],
        [("a", 6, "complete", None, None), ("b", 4, "complete", None, None), ("b", 5, "cancel", None, None), ("b", 6, "begin", None, None), ("b", 7, "packet", 0, frame(0, 4, value=2.0))],
        [("b", 8, "packet", 4, frame(4, 2)), ("b", 9, "cancel", None, None), ("b", 10, "begin", None, None), ("b", 11, "packet", 0, frame(0, 1, 3)), ("b", 12, "cancel", None, None), ("b", 13, "begin", None, None), ("b", 14, "packet", 0, frame(0, 5, value=10.0))],
        [("b", 15, "complete", None, None), ("b", 16, "stop", None, None)],
    ]
    for rows in runs:
        spark.createDataFrame(rows, protocol.COMMANDS).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(protocol.COMMANDS).parquet(f"{path}/in")
        protocol.run(stream, 5, 4, lambda f: f.select(F.col("view").alias("voxel_id"), F.col("data")[0].alias("value")), path)
    log = {(r.scan, r.batch, r.seq): r for r in protocol.log(spark, path).collect()}
    taken = {s: [k[2] for k in sorted(log) if k[0] == s and log[k].accepted] for s in "ab"}
    assert taken == {"a": [1, 2, 5, 6], "b": [0, 1, 5, 6, 7, 9, 10, 12, 13, 14, 15]}
    assert len(log) == sum(map(len, runs)) and not log["a", 1, 2].accepted and log["a", 1, 4].received == 2
    assert log["b", 1, 2].failed and log["b", 1, 3].failed and log["b", 2, 4].failed and not log["b", 2, 6].failed and log["b", 3, 8].failed and log["b", 3, 11].failed
    assert log["b", 4, 15].attempt == 4 and not log["b", 4, 15].active
    out = {(r.scan, r.voxel_id): r.value for r in protocol.volumes(spark, path).collect()}
    assert out == {("a", i): float(i) for i in range(5)} | {("b", i): 10.0 * i for i in range(5)}


def test_states_of_scans_hold_no_frames():
    """The state of commands is asked about sizes alone, in the order of micro-batches, then of seq."""
    assert "frames" not in protocol.ASKED and "frames" not in protocol.ANSWERS


def test_whole_packets_are_told_before_the_state(spark):
    frame = lambda view, *data: (view, list(data))
    nan, inf = float("nan"), float("inf")
    cases = [([frame(3, 1.0, 2.0), frame(4, 0.0, -1.0)], 2, True), ([frame(4, 1.0, 2.0)], 1, False), ([frame(3, 1.0)], 1, False), ([frame(3, 1.0, nan)], 1, False), ([frame(3, -inf, 1.0)], 1, False), ([frame(3, None, 1.0)], 1, False), (None, 0, True)]
    rows = spark.createDataFrame([("s", i, "packet", 3, f) for i, (f, _, _) in enumerate(cases)], protocol.COMMANDS)
    got = {r.seq: (r.n, r.whole) for r in protocol.asked(rows, 2).collect()}
    assert got == {i: (n, whole) for i, (_, n, whole) in enumerate(cases)}


def test_blocks_are_made_by_chunks_as_whole():
    """Targets from chunks of packed views, a few at a time, are those made from all frames of the block; the state is called by chunk."""
    from voxelbase.functions.packs import Packs
    from voxelbase.plans import xfdk as X
    from voxelbase.streaming.halo import _Blocks

    from .test_traps import _Store

    rng = np.random.default_rng(3)
    gather = X.gather_of(Scan(views=3000, nu=16, nv=4, du=1.6, dv=1.6, sid=60.0, sdd=120.0, start=0.3))
    frames = rng.random((3000, 64))
    blocks, stores, count = _Blocks(gather), _Store(), _Store()
    block = gather.blocks - 1
    needed = np.unique(gather.sources(block))
    assert all(gather.needed(k) == len(np.unique(gather.sources(k))) for k in range(gather.blocks))
    blocks.pending, blocks.packs, blocks.count = stores, Packs(stores, 64), count
    stores.clear = stores.held.clear
    out = []
    for views in (needed[::2], [*needed[1:-1:2], *needed[:9]], needed[-2:]):
        part = pd.DataFrame({"view": views, "data": [frames[v] for v in views]})
        out += list(blocks.handleInputRows((block,), iter([part]), None))
    want = gather.made(block, {int(v): frames[v] for v in needed})
    got = pd.concat(out)
    assert got["view"].tolist() == [v for v, _ in want] and (np.stack(got["data"]) == np.stack([d for _, d in want])).all()
    assert max(map(len, out)) <= 64 and not stores.held and stores.calls < 2 * len(needed)

"""Total variation: gradients against differences of the value, spacing, stops, a start from FDK, readings added back."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelbase.functions.scratch import settle
from voxelbase.operators import geometry as G
from voxelbase.operators import projector as J
from voxelbase.operators.geometry import Scan
from voxelbase.operators.projector import Grid
from voxelbase.plans import pocs, solve

GRID = Grid(5, 4, 3, (0.5, 1.0, 2.0))
VALUES = np.random.default_rng(6).random((3, 4, 5))


def table(spark, x):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x.ravel())], "voxel_id long, value double")


def array(df):
    return np.array([r.value for r in sorted(df.collect(), key=lambda r: r.voxel_id)]).reshape(3, 4, 5)


def numeric(value, x, step=1e-6):
    out = np.zeros_like(x)
    for i in np.ndindex(x.shape):
        up, down = x.copy(), x.copy()
        up[i] += step
        down[i] -= step
        out[i] = (value(up) - value(down)) / (2 * step)
    return out


def forward_slopes(x, flat=False):
    g = [np.zeros_like(x) for _ in range(3)]
    for k, (axis, h) in enumerate(((2, 0.5), (1, 1.0), (0, 2.0))):
        if not (flat and k == 2):
            g[k][tuple(slice(None, -1) if a == axis else slice(None) for a in range(3))] = np.diff(x, axis=axis) / h
    return np.sqrt(sum(s * s for s in g))


@pytest.mark.parametrize("flat", [False, True])
def test_penalties_and_gradients_know_the_spacing(spark, flat):
    x = table(spark, VALUES)
    tv = lambda v: (np.sqrt(forward_slopes(v, flat) ** 2 + 0.04) - 0.2).sum()
    huber = lambda v: np.where((n := forward_slopes(v, flat)) <= 0.3, n * n / 0.6, n - 0.15).sum()
    assert abs(solve.penalty_value(x, GRID, "smoothed_tv", 0.2, flat) - tv(VALUES)) < 1e-9
    assert abs(solve.penalty_value(x, GRID, "huber", 0.3, flat) - huber(VALUES)) < 1e-9
    assert np.allclose(array(solve.smoothed_tv_gradient(0.2, flat)(x, GRID)), numeric(tv, VALUES), atol=1e-6)
    assert np.allclose(array(solve.huber_gradient(0.3, flat)(x, GRID)), numeric(huber, VALUES), atol=1e-5)


def test_denoising_with_spacing_lowers_its_objective(spark):
    z = table(spark, VALUES)
    cost = lambda v: 0.5 * ((v - VALUES) ** 2).sum() + 0.1 * forward_slopes(v).sum()
    got = [cost(array(solve.tv_denoise(z, GRID, 0.1, n))) for n in (2, 10)]
    assert got[1] < got[0] < cost(VALUES)


def test_variation_gradient_is_the_slope_of_its_sum(spark):
    def value(x):
        g = [np.zeros_like(x) for _ in range(3)]
        for axis in range(3):
            g[axis][tuple(slice(1, None) if a == axis else slice(None) for a in range(3))] = np.diff(x, axis=axis)
        return np.sqrt(sum(s * s for s in g)).sum()

    assert np.allclose(array(pocs.variation_gradient(table(spark, VALUES), GRID)), numeric(value, VALUES), atol=1e-4)


def test_descent_is_of_the_length_asked_and_stops_on_flat_volumes(spark):
    x = table(spark, VALUES)
    assert abs(np.linalg.norm(array(pocs.descended(x, GRID, 0.01, 1, edge=0.2)) - VALUES) - 0.01) < 1e-9
    flat = np.full_like(VALUES, 0.5)
    assert np.array_equal(array(pocs.descended(table(spark, flat), GRID, 0.1, 3)), flat)


@pytest.fixture(scope="module")
def scene(spark):
    scan, grid = Scan(views=10, nu=12, nv=4, du=1.6, dv=1.6, sid=60.0, sdd=120.0, start=0.1), Grid(6, 6, 3)
    geometry = settle(G.flat_geometry(spark, scan))
    rays = J.rays(geometry, scan)
    m = settle(J.siddon(rays, grid))
    truth = grid.voxels(spark).select("voxel_id", F.when(F.col("ix").between(2, 4) & F.col("iy").between(1, 3), 0.03).otherwise(0.01).alias("value"))
    b = settle(rays.select("ray_id", "view", "v", "u").join(J.forward(m, truth), "ray_id", "left").select("ray_id", "view", "v", "u", F.coalesce("value", F.lit(0.0)).alias("value")))
    return scan, grid, geometry, m, b, truth


def test_starting_from_fdk_and_stopping_on_readings(spark, scene):
    scan, grid, geometry, m, b, truth = scene
    start = pocs.fdk_start(b.select("view", "v", "u", "value"), geometry, scan, grid)
    assert start.agg(F.min("value")).first()[0] >= 0
    enough = pocs.good_enough(m, b, start)
    p = pocs.Pocs(iterations=2, relax=1.0, descents=1, length=0.1, most_error=enough)
    x, report = pocs.reconstruct(m, b, grid, p, x0=start)
    far = lambda v: np.linalg.norm([r.value - r.truth for r in v.join(truth.withColumnRenamed("value", "truth"), "voxel_id").collect()])
    assert far(x) < far(start) and report.steps[-1]["error"] < report.steps[0]["error"] * 1.01 and report.iterations == len(report.steps)


def test_stops_on_relaxation_and_refuses_other_kinds(spark, scene):
    _, grid, _, m, b, _ = scene
    _, report = pocs.reconstruct(m, b, grid, pocs.Pocs(iterations=5, relax=0.5, relax_decay=0.01, least_relax=0.1, descents=1))
    assert (report.iterations, report.stopped) == (1, "relaxation")
    with pytest.raises(ValueError):
        pocs.reconstruct(m, b, grid, pocs.Pocs(kind="other"))


def test_readings_added_back_pull_the_volume_to_them(spark, scene):
    _, grid, _, m, b, _ = scene
    plain = pocs.Pocs(iterations=3, descents=2, length=0.5)
    _, one = pocs.reconstruct(m, b, grid, plain)
    _, two = pocs.reconstruct(m, b, grid, replace(plain, bregman=0.5, bregman_every=1))
    assert one.steps[0] == two.steps[0] and one.steps[2]["error"] != two.steps[2]["error"]

"""Scatter by kernel mixtures against a direct sum, and the adaptive solver's ways to end."""

import math
from dataclasses import replace

import numpy as np
import pytest

from voxelbase.plans import scatter as S
from voxelbase.queries.corrections import MODEL

RNG = np.random.default_rng(5)


def direct(model, primary, air, edge):
    """Every source onto every pixel, without spectra, blocks or water correction."""
    basis = model.basis()
    rv, ru = model.reach()
    out = np.zeros_like(primary)
    for (y, x), p in np.ndenumerate(primary):
        t = min(max(p / air[y, x], 1e-300), 1.0)
        if t >= 1 or not edge[y, x]:
            continue
        a = -math.log(t)
        (x0, a0), *_ = model.amplitude
        strength = model.t_max * a0 * a / x0 / t if a < x0 else np.interp(a, *zip(*model.amplitude, strict=True))
        for k in range(len(basis)):
            share = np.interp(np.clip(a, basis[0], basis[-1]), basis, np.eye(len(basis))[k])
            kernel = model.kernel(float(basis[k]))
            for dy in range(-rv, rv + 1):
                for dx in range(-ru, ru + 1):
                    if share and 0 <= y + dy < model.ny and 0 <= x + dx < model.nx:
                        out[y + dy, x + dx] += p * strength * edge[y, x] * share * kernel[dy + rv, dx + ru]
    return out


@pytest.mark.parametrize("block", [3, 5, 512])
@pytest.mark.parametrize("segments", [0, 7])
@pytest.mark.parametrize("kept", [0, 1 << 20])
def test_blocks_equal_direct_sum(monkeypatch, block, segments, kept):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "KEPT", kept)
    model = replace(MODEL, ny=11, nx=9, gamma=0.0, segments=segments)
    air = RNG.uniform(1.0, 2.0, (11, 9))
    air[3, 4] = 0.0  # no air: no source
    primary = RNG.uniform(0.05, 2.0, (11, 9))
    edge = RNG.uniform(0.0, 1.0, (11, 9)) * (RNG.random((11, 9)) < 0.8)
    got = S.predictor(model)(primary, air, edge)
    air[3, 4] = primary[3, 4]
    np.testing.assert_allclose(got, direct(model, primary, air, edge), atol=1e-12)


@pytest.mark.parametrize("ramp", [0.3, 3.0, 40.0])
def test_edge_window_equals_all_pairs(ramp):
    model = replace(MODEL, ny=9, nx=13, edge_ramp=ramp)
    for density in (0.0, 0.5, 0.9, 1.0):
        mask = RNG.random((9, 13)) < density
        out = np.array([(y * model.dv, x * model.du) for (y, x), m in np.ndenumerate(mask) if not m]).reshape(-1, 2)
        want = np.zeros(mask.shape)
        for (y, x), m in np.ndenumerate(mask):
            if m:
                near = ((out - (y * model.dv, x * model.du)) ** 2).sum(axis=1).min() if len(out) else np.inf
                want[y, x] = 0.4 + 0.6 * min(near / ramp, 1)
        np.testing.assert_allclose(S.edge_window(mask, model), want)


def test_kernel_keeps_its_calibrated_mass():
    wide = replace(MODEL, ny=64, nx=64, support_u=100.0, support_v=100.0)
    near = replace(wide, support_u=2.0, support_v=2.0)
    assert wide.kernel(0.5).sum() > near.kernel(0.5).sum()
    assert near.kernel(0.5).shape == (5, 5) and near.kernel(0.5)[2, 2] == pytest.approx(0.04 * 1.25)


@pytest.mark.parametrize(
    "change",
    [{"nodes": (0.1, 0.1, 1.0, 2.0)}, {"density": ((1.0, 1.0),)}, {"amplitude": ((0.0, 1.0),)}, {"du": 0.0}, {"radii": (0.0, 2.0, 1.0, 3.0)}],
)
def test_faulty_models_are_refused(change):
    with pytest.raises(ValueError):
        replace(MODEL, **change)


def solve(predict, how=S.Damping(), data=None):
    data = np.full((2, 2), 1.0) if data is None else data
    return S._solve(data, np.full(data.shape, 2.0), lambda p, air, edge: predict(p), np.ones(data.shape), how, 1.0)


def test_solver_finds_the_fixed_point():
    primary, report = solve(lambda p: 0.25 * p, S.Damping(iterations=60))
    np.testing.assert_allclose(primary, 0.8, rtol=1e-9)
    assert report["status"] == "completed" and report["iterations"] == 60 and not report["rejected"]


def test_solver_stalls_after_halving_to_the_least_step():
    # Scatter that grows against the step: no step lowers the residual.
    primary, report = solve(lambda p: 0.3 + 40 * (1.0 - p), S.Damping(first=0.8, least=0.1))
    assert report == report | {"status": "stalled", "iterations": 0, "rejected": 4, "predictions": 5, "damping": 0.1}
    np.testing.assert_array_equal(primary, 1.0)


def test_solver_halves_then_goes_on():
    primary, report = solve(lambda p: 0.3 + 40 * np.maximum(0.0, 0.8 - p), S.Damping(iterations=1, first=0.8, least=0.1))
    assert report == report | {"status": "completed", "iterations": 1, "rejected": 1, "predictions": 3, "damping": 0.4}
    np.testing.assert_allclose(primary, 0.88)


def test_positivity_bounds_and_stalls():
    data = np.full((1, 2), 1.0)
    primary, report = solve(lambda p: np.full(p.shape, 5.0), S.Damping(iterations=3, first=1.0, margin=0.5), data)
    assert (primary >= 2e-8).all() and report["limited"] == 3
    _, report = solve(lambda p: np.full(p.shape, 5.0), S.Damping(iterations=3), np.full((1, 1), 2e-8))
    assert report["status"] == "positivity_stalled" and report["predictions"] == 1


def test_frames_of_any_column_and_no_rows(spark):
    frame = spark.createDataFrame([(1, [1.0] * 64, [1.5] * 64, "x")], "view int, data array<double>, air array<double>, `a.b` string")
    rows = S.adaptive_scatter(frame, MODEL, 0.8).collect()
    assert len(rows) == 1 and rows[0].status == "completed" and rows[0].risk is False
    for plan in (S.scatter, S.adaptive_scatter):
        assert plan(frame.limit(0), MODEL, 0.8).count() == 0
    assert S.fixed_scatter(frame.limit(0), MODEL, 0.8, 2, 0.5).count() == 0


@pytest.mark.parametrize("data", [None, [], [1.0] * 63, [1.0] * 63 + [None], [1.0] * 63 + [math.inf]])
def test_faulty_frames_stop_the_query(spark, data):
    frame = spark.createDataFrame([(1, data, [1.5] * 64)], "view int, data array<double>, air array<double>")
    with pytest.raises(Exception, match="64 finite values"):
        S.scatter(frame, MODEL, 0.8).collect()

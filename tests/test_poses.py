"""Cameras, their parts, the joint fit and ellipses against dense solutions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelbase.plans import poses as P
from voxelbase.queries import poses as Q

RNG = np.random.default_rng(3)
SF = "/root/testdata/sf0.001"


def made(views=4, n=30, noise=0.3):
    rows, truth = [], []
    for v in range(views):
        r, t = P.rotation(RNG.normal(0, 0.4, 3)), np.array([*RNG.normal(0, 5, 2), 300 + 10 * v])
        x = RNG.uniform(-40, 40, (n, 3))
        c = x @ r.T + t
        q = c[:, :2] / c[:, 2:] * 900 + (500, 400) + RNG.normal(0, noise, (n, 2)) if noise else c[:, :2] / c[:, 2:] * 900 + (500, 400)
        rows += [(v, *map(float, p), *map(float, i)) for p, i in zip(x, q, strict=True)]
        truth.append((r, t))
    return rows, truth


def frame(spark, rows):
    return spark.createDataFrame(rows, "view long, x double, y double, z double, u double, v double")


def dense(rows, shared, poses, rounds=60):
    """Gauss-Newton on all unknowns in one matrix, derivatives by central differences, a turn vector for each rotation."""
    data = np.array(rows)
    n = len(poses)

    def residual(q, base):
        e = []
        for k in range(n):
            d = data[data[:, 0] == k]
            r = P.rotation(q[3 + 6 * k : 6 + 6 * k]) @ base[k]
            c = d[:, 1:4] @ r.T + q[6 + 6 * k : 9 + 6 * k]
            e.append((c[:, :2] / c[:, 2:] * q[0] + q[1:3] - d[:, 4:6]).ravel())
        return np.concatenate(e)

    base = [r for r, _ in poses]
    q = np.concatenate([shared, *(np.r_[np.zeros(3), t] for _, t in poses)])
    for _ in range(rounds):
        h = np.where(np.abs(q) > 1, 1e-4, 1e-6)
        jac = np.stack([(residual(q + h * e, base) - residual(q - h * e, base)) / (2 * h[k]) for k, e in enumerate(np.eye(len(q)))], axis=1)
        q = q - np.linalg.lstsq(jac, residual(q, base), rcond=None)[0]
        base = [P.rotation(q[3 + 6 * k : 6 + 6 * k]) @ base[k] for k in range(n)]
        for k in range(n):
            q[3 + 6 * k : 6 + 6 * k] = 0
    return q[:3], [(base[k], q[6 + 6 * k : 9 + 6 * k]) for k in range(n)], 0.5 * float((residual(q, base) ** 2).sum())


@pytest.mark.parametrize("chunk,sent", [(4096, 32 << 20), (7, 0)])
def test_joint_fit_equals_a_dense_fit(spark, monkeypatch, chunk, sent):
    monkeypatch.setattr(P, "CHUNK", chunk)
    monkeypatch.setattr(P, "SENT", sent)
    rows, truth = made()
    rows += rows[:5] + [(0, None, 0.0, 0.0, 0.0, 0.0), (None, 0.0, 0.0, 0.0, 0.0, 0.0), (0, float("nan"), 0.0, 0.0, 0.0, 0.0), (9, 1.0, 1.0, 1.0, 1.0, 1.0)]
    result, figures = P.joint_poses(frame(spark, rows))
    shared, poses, cost = dense([r for r in rows if None not in r and r[0] < 4 and r[1] == r[1]], [900.0, 500.0, 400.0], truth, 12)
    got = {r.view: r for r in result.collect()}
    assert sorted(got) == [0, 1, 2, 3] and got[0].n == 35 and figures["iterations"] > 1
    np.testing.assert_allclose(figures["shared"], shared, atol=2e-3)
    assert figures["cost"] == pytest.approx(cost, rel=1e-7) and sum(r.cost for r in got.values()) == pytest.approx(cost, rel=1e-7)
    for k, (r, t) in enumerate(poses):
        np.testing.assert_allclose(np.reshape(got[k].rotation, (3, 3)), r, atol=1e-5)
        np.testing.assert_allclose(got[k].translation, t, atol=2e-3)


def test_joint_fit_of_exact_points_and_of_none(spark):
    rows, truth = made(noise=0)
    result, figures = P.joint_poses(frame(spark, rows))
    np.testing.assert_allclose(figures["shared"], [900, 500, 400], atol=1e-5)
    assert figures["cost"] < 1e-12
    for r in result.collect():
        np.testing.assert_allclose(np.reshape(r.rotation, (3, 3)), truth[r.view][0], atol=1e-8)
    for few in (rows[:0], rows[:5], [rows[0]] * 20):
        result, figures = P.joint_poses(frame(spark, few))
        assert result.count() == 0 and figures["shared"] is None
        assert P.cameras(frame(spark, few)).count() == 0


def test_points_in_a_plane_stop(spark):
    rows, _ = made(1, noise=0)
    for flat in ([(v, x, y, 2.0, a, b) for v, x, y, _, a, b in rows], [(v, x, y, z, 1.0, 1.0) for v, x, y, z, _, _ in rows]):
        with pytest.raises(Exception, match="lie in a plane"):
            P.cameras(frame(spark, flat)).collect()


@pytest.mark.parametrize("scale", [1.0, -3.7, 1e-5])
def test_split_gives_back_the_parts(scale):
    k = np.array([[800.0, 3.0, 320.0], [0, 750, 240], [0, 0, 1]])
    r, t = P.rotation(np.array([0.3, -1.1, 2.0])), np.array([1.0, -2.0, 50.0])
    got = P.split_camera(scale * k @ np.c_[r, t])
    for a, b in zip(got, (k, r, t), strict=True):
        np.testing.assert_allclose(a, b, atol=1e-8)


def test_rotation_is_the_exponential_of_its_vector():
    for w in (np.zeros(3), np.array([1e-9, 0, 0]), RNG.normal(size=3), np.array([0, np.pi, 0])):
        k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
        series, term = np.eye(3), np.eye(3)
        for i in range(1, 40):
            term = term @ k / i
            series = series + term
        np.testing.assert_allclose(P.rotation(w), series, atol=1e-12)


def test_known_poses_come_back_from_the_table(spark):
    """Whole query: poses that differ from the truth by the noise's share only; better than each view on its own."""
    rows = Q.QUERIES["joint_poses"](spark, SF).collect()
    assert len(rows) == 10 and max(r.turn for r in rows) < 0.15 and max(r.shift for r in rows) < 1.0
    # Half the squared errors of 2 n coordinates within a tenth of a pixel.
    assert all(r.cost < r.n * 0.01 for r in rows)


def test_ellipses_of_noisy_points_minimise_the_algebraic_distance(spark):
    rows = []
    for g in range(4):
        a = RNG.uniform(0, 2 * np.pi, 50)
        x, y = 5 * np.cos(a) + RNG.normal(0, 0.05, 50), 2 * np.sin(a) + RNG.normal(0, 0.05, 50)
        rows += [(g, float(100 + p * np.cos(g) - q * np.sin(g)), float(-50 + p * np.sin(g) + q * np.cos(g)), "z") for p, q in zip(x, y, strict=True)]
    got = {r.g: r for r in P.ellipses(spark.createDataFrame(rows, "g int, x double, y double, n string"), "g").collect()}
    for g, r in got.items():
        assert r.n == 50 and (r.cx, r.cy) == (pytest.approx(100, abs=0.1), pytest.approx(-50, abs=0.1))
        assert (r.major, r.minor) == (pytest.approx(5, abs=0.1), pytest.approx(2, abs=0.1))
        assert abs((r.angle - g + np.pi / 2) % np.pi - np.pi / 2) < 0.03
        # Conic of the answer, normed to 4ac - b^2 = 1 in moved and scaled points: no neighbour has a smaller sum of squares.
        d = np.array([(p, q) for k, p, q, _ in rows if k == g])
        mean, s = d.mean(axis=0), np.sqrt(d.var(axis=0).sum())
        d = (d - mean) / s

        def loss(cx, cy, major, minor, angle, d=d, mean=mean, s=s):
            e = d - (np.array([cx, cy]) - mean) / s
            c, n = np.cos(angle), np.sin(angle)
            u, v = e @ [c, n] / (major / s), e @ [-n, c] / (minor / s)
            return float((((u * u + v * v - 1) * (major * minor / s**2) / 2) ** 2).sum())

        best = np.array([r.cx, r.cy, r.major, r.minor, r.angle])
        for k in range(5):
            for h in (-1e-3, 1e-3):
                near = best.copy()
                near[k] += h
                assert loss(*best) <= loss(*near)


def test_ellipse_edges(spark):
    rows = [(1, 0.0, 0.0)] * 9 + [(2, float(k), 2.0 * k) for k in range(9)] + [(3, 1.0, 2.0)] + [(4, None, 1.0)] + [(5, np.cos(k).item(), np.sin(k).item()) for k in range(8)]
    got = {r.g: r for r in P.ellipses(spark.createDataFrame(rows, "g int, x double, y double"), "g").collect()}
    assert all(got[g].major is None for g in (1, 2, 3)) and 4 not in got
    assert got[5].angle == 0.0 and got[5].major == pytest.approx(1)
    assert P.ellipses(spark.createDataFrame([], "g int, x double, y double"), "g").count() == 0


def test_tasks_of_chunks_grow_with_the_points(spark):
    """Partitions keep their size: a session's number of shuffle partitions doesn't set how much a task reads at once."""
    sizes = lambda n: spark.createDataFrame([(0, n), (1, 7)], "view long, distinct long")
    assert P._tasks(sizes(10)) == spark.sparkContext.defaultParallelism and P._tasks(sizes(216_000_000)) == -(-216_000_007 // P.TASK)
    rows = spark.range(2000).select((F.col("id") % 3).alias("view"), *(F.hash(F.lit(k), "id").cast("double").alias(k) for k in P.POINT), F.lit(1.0).alias("w"))
    views = rows.groupBy("view").agg(F.count(F.lit(1)).alias("distinct"))
    chunks = P._chunks(rows, views, 37)
    assert chunks.rdd.getNumPartitions() == 37 and chunks.agg(F.sum(F.size("w"))).first()[0] == 2000

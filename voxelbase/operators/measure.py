"""Aggregates: quality metrics, region statistics, spectra, moments and least-squares fits from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quality(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """NRMSE, MAE, cosine, bias and largest error of (truth, value) pairs, one pass of mergeable sums."""
    t, v = F.col("truth"), F.col("value")
    e = v - t
    return pairs.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e).alias("bias"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sqrt(F.sum(e * e) / F.sum(t * t)).alias("nrmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.sum(t * v) / F.sqrt(F.sum(t * t) * F.sum(v * v))).alias("cosine"),
        F.max(F.abs(e)).alias("worst"),
    )


def error_moments(rows: DataFrame, region: str, error: Column, level: Column, above: Column, place: Column) -> DataFrame:
    """Mean and root mean squares per region from sums that merge, and where the largest error lies (ties: the smallest place)."""
    low, gap = F.least(above, F.lit(0.0)), error - level
    mean = lambda e: F.sqrt(F.avg(e * e))
    return rows.groupBy(region).agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mean"), mean(error).alias("rmse"), mean(level).alias("level"), mean(low).alias("clipped"), mean(gap).alias("difference"), F.max_by(place, F.struct(F.abs(error), -place)).alias("worst_at"))


def polynomial_fit(rows: DataFrame, x: str, y: str, order: int, ridge: float = 0.0, weight: str | None = None) -> list[float]:
    """Ascending coefficients of a least-squares polynomial; only moments (a few sums) reach the driver."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = [F.sum(w * F.pow(F.col(x), F.lit(float(k)))) for k in range(2 * order + 1)] + [F.sum(w * F.col(y) * F.pow(F.col(x), F.lit(float(k)))) for k in range(order + 1)]
    m = [v or 0.0 for v in rows.agg(*sums).first()]
    a = np.array([[m[i + j] for j in range(order + 1)] for i in range(order + 1)]) + ridge * np.eye(order + 1)
    return np.linalg.solve(a, np.array(m[2 * order + 1 :])).tolist()


def linear_fit(rows: DataFrame, terms: list[Column], y: Column, weight: Column | None = None, ridge: float = 0.0) -> list[float]:
    """Least squares on any terms, from their product sums."""
    w = weight if weight is not None else F.lit(1.0)
    n = len(terms)
    sums = [F.sum(w * terms[i] * terms[j]) for i in range(n) for j in range(n)] + [F.sum(w * terms[i] * y) for i in range(n)]
    m = np.array([v or 0.0 for v in rows.agg(*sums).first()])
    return np.linalg.solve(m[: n * n].reshape(n, n) + ridge * np.eye(n), m[n * n :]).tolist()


#: Distinct values that ``median`` holds at the driver, at most.
HELD = 1 << 16


def median(rows: DataFrame, value: Column, held: int = HELD, near: float = 2e-4) -> float:
    """The exact median, as ``percentile`` has it, of any number of values; neither a task nor the driver holds all of them.

    A sketch of bounded size brackets it, and the distinct values in the bracket are counted. A bracket
    with more than ``held`` is bracketed again.
    """
    scope, n, below, q = rows.select(value.cast("double").alias("e")).where("e IS NOT NULL"), None, 0, 0.5
    while True:
        size, cuts = scope.agg(F.count(F.lit(1)), F.percentile_approx("e", F.array(F.lit(max(0.0, q - near)), F.lit(min(1.0, q + near))), F.lit(10000))).first()
        if not size:
            raise ValueError("no values")
        n = size if n is None else n
        low, high = map(F.lit, cuts)
        counts = dict(scope.where(F.col("e") <= high).groupBy(F.when(F.col("e") >= low, F.col("e"))).count().limit(held + 2).collect())
        if len(counts) > held + 1 and cuts[0] < cuts[1]:
            under, inside = (scope.where(c).count() for c in (F.col("e") < low, F.col("e").between(low, high)))
            if below + under <= (n - 1) // 2 and n // 2 < below + under + inside < below + size:
                scope, below, q = scope.where(F.col("e").between(low, high)), below + under, ((n - 1) / 2 - below - under) / inside
                continue
        else:
            at, found = below + counts.pop(None, 0), {}
            if at <= (n - 1) // 2:
                for e in sorted(counts):
                    found |= {k: e for k in ((n - 1) // 2, n // 2) if at <= k < at + counts[e]}
                    at += counts[e]
            if len(found) == len({(n - 1) // 2, n // 2}):
                return sum(found.values()) / len(found)
        near *= 10  # the sketch missed
        if near > 10:
            raise ValueError("held is too small for these values")


def robust_fit(rows: DataFrame, terms: list[Column], y: Column, rounds: int = 30, ridge: float = 1e-5, tuning: float = 1.345) -> list[float]:
    """Huber's iteratively reweighted least squares; the scale is 1.4826 times the median absolute residual."""
    beta = linear_fit(rows, terms, y, ridge=ridge)
    for _ in range(rounds):
        e = y - sum((t * b for t, b in zip(terms, beta, strict=True)), F.lit(0.0))
        scale = max(1.4826 * median(rows, F.abs(e)), 1e-12)
        new = linear_fit(rows, terms, y, F.least(F.lit(1.0), F.lit(tuning * scale) / F.greatest(F.abs(e), F.lit(1e-12))), ridge)
        done = max(abs(a - b) for a, b in zip(new, beta, strict=True)) < 1e-10
        beta = new
        if done:
            break
    return beta


def air_water_calibration(air: DataFrame, water: DataFrame, least_gap: float = 1e-6) -> tuple[float, float]:
    """Scale and offset that map the mean of ``air`` to -1000 and of ``water`` to 0."""
    a, w = (t.agg(F.avg("value")).first()[0] for t in (air, water))
    if abs(w - a) < least_gap:
        raise ValueError("air and water regions have the same mean")
    scale = 1000.0 / (w - a)
    return scale, -scale * w


def homogeneous_fit(points: DataFrame) -> list[float]:
    """Direct linear transform: the 3 x 4 matrix (12 numbers, unit norm) that takes (x, y, z) to (u, v).

    Points are first moved to their mean and scaled to mean distances sqrt(2) and sqrt(3),
    which keeps the system well conditioned. The 12 x 12 matrix of products is one
    aggregate; its smallest eigenvector is the answer, taken back to the points' own units.
    """
    m = dict(zip("xyzuv", points.agg(*(F.avg(c) for c in "xyzuv")).first(), strict=True))
    far = lambda names: F.avg(F.sqrt(sum(((F.col(c) - m[c]) * (F.col(c) - m[c]) for c in names), F.lit(0.0))))
    far3, far2 = points.agg(far("xyz"), far("uv")).first()
    s3, s2 = 3**0.5 / max(far3, 1e-300), 2**0.5 / max(far2, 1e-300)
    moved = {c: (F.col(c) - m[c]) * (s3 if c in "xyz" else s2) for c in "xyzuv"}
    c = [moved[k] for k in "xyz"] + [F.lit(1.0)]
    zero = [F.lit(0.0)] * 4
    rows = [[*c, *zero, *(-moved["u"] * k for k in c)], [*zero, *c, *(-moved["v"] * k for k in c)]]
    sums = [F.sum(sum((r[i] * r[j] for r in rows[1:]), rows[0][i] * rows[0][j])) for i in range(12) for j in range(i, 12)]
    flat = iter(points.agg(*sums).first())
    a = np.zeros((12, 12))
    for i in range(12):
        for j in range(i, 12):
            a[i, j] = a[j, i] = next(flat)
    p = np.linalg.eigh(a)[1][:, 0].reshape(3, 4)
    world = np.diag([s3, s3, s3, 1.0])
    world[:3, 3] = [-s3 * m[k] for k in "xyz"]
    image = np.array([[1 / s2, 0, m["u"]], [0, 1 / s2, m["v"]], [0, 0, 1]])
    p = (image @ p @ world).ravel()
    p /= np.linalg.norm(p)
    return (p * np.sign(p[np.abs(p).argmax()])).tolist()


def circle_fit_3d(points: DataFrame) -> tuple[list[float], list[float], float]:
    """Centre, unit normal and radius of a circle through (x, y, z): the plane by the moments' least axis, the circle in the plane.

    The normal's largest part is positive.
    """
    mean = np.array(points.agg(*(F.avg(c) for c in "xyz")).first())
    q = [F.col(c) - float(m) for c, m in zip("xyz", mean, strict=True)]
    flat = iter(points.agg(*(F.avg(q[i] * q[j]) for i in range(3) for j in range(i, 3))).first())
    moments = np.zeros((3, 3))
    for i in range(3):
        for j in range(i, 3):
            moments[i, j] = moments[j, i] = next(flat)
    axes = np.linalg.eigh(moments)[1]
    normal = axes[:, 0] * np.sign(axes[np.abs(axes[:, 0]).argmax(), 0])
    along = lambda a: sum((c * float(k) for c, k in zip(q, a, strict=True)), F.lit(0.0))
    x, y, r = circle_fit(points.select(along(axes[:, 1]).alias("x"), along(axes[:, 2]).alias("y")))
    return (mean + x * axes[:, 1] + y * axes[:, 2]).tolist(), normal.tolist(), r


def circle_fit(points: DataFrame) -> tuple[float, float, float]:
    """Centre and radius of (x, y) by least squares on x^2 + y^2."""
    a, b, c = linear_fit(points, [F.col("x"), F.col("y"), F.lit(1.0)], F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return a / 2, b / 2, (c + a * a / 4 + b * b / 4) ** 0.5


def spectrum_figures(spectrum: DataFrame) -> DataFrame:
    """Photon and energy sums, mean energy of (energy, weight)."""
    e, w = F.col("energy"), F.col("weight")
    return spectrum.agg(F.sum(w).alias("photons"), F.sum(w * e).alias("energy_sum"), (F.sum(w * e) / F.sum(w)).alias("mean_energy"))


def mixture(fractions: DataFrame, attenuation: DataFrame) -> DataFrame:
    """(material, energy, mu / rho): fractions normalised by their sum, then weighted sums over elements."""
    total = fractions.groupBy("material").agg(F.sum("fraction").alias("all"))
    share = fractions.join(total, "material").withColumn("share", F.col("fraction") / F.col("all"))
    return share.join(attenuation, "element").groupBy("material", "energy").agg(F.sum(F.col("share") * F.col("mu")).alias("mu"))


def block_average(volume: DataFrame, nx: int, ny: int, s: int) -> DataFrame:
    """(bx, by, bz, value): means of s x s x s blocks."""
    i = F.col("voxel_id")
    at = lambda c: F.floor(c / s).alias
    return volume.groupBy(at(i % nx)("bx"), at(F.floor(i / nx) % ny)("by"), at(F.floor(i / (nx * ny)))("bz")).agg(F.avg("value").alias("value"))

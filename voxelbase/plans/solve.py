"""Iterative reconstruction over a sparse projector.

Each solver keeps its volume as a (voxel_id, value) table, computes a step from
joins and combining sums, and checkpoints the volume so that lineage doesn't
grow. Scalars of a step (norms, step lengths) are the only numbers the driver
sees.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelbase.functions.scratch import settle
from voxelbase.operators.projector import Grid, back, column_sums, forward, row_sums

EPS = 1e-8


def zeros(matrix: DataFrame) -> DataFrame:
    return matrix.select("voxel_id").distinct().withColumn("value", F.lit(0.0))


def residual(matrix: DataFrame, b: DataFrame, x: DataFrame) -> DataFrame:
    """(ray_id, value): b - A x."""
    return b.join(forward(matrix, x).withColumnRenamed("value", "ax"), "ray_id", "left").select("ray_id", (F.col("value") - F.coalesce("ax", F.lit(0.0))).alias("value"))


def norm2(t: DataFrame) -> float:
    return t.agg(F.coalesce(F.sum(F.col("value") * F.col("value")), F.lit(0.0))).first()[0]


def inner(a: DataFrame, b: DataFrame, key: str) -> float:
    return a.join(b.withColumnRenamed("value", "other"), key).agg(F.coalesce(F.sum(F.col("value") * F.col("other")), F.lit(0.0))).first()[0]


def axpy(x: DataFrame, k: float, y: DataFrame, key: str) -> DataFrame:
    """x + k y, over the keys of x."""
    return x.join(y.withColumnRenamed("value", "step"), key, "left").select(key, (F.col("value") + F.lit(k) * F.coalesce("step", F.lit(0.0))).alias("value"))


def bounded(x: DataFrame, low: float | None, high: float | None) -> DataFrame:
    v = F.col("value")
    v = F.greatest(v, F.lit(low)) if low is not None else v
    return x.withColumn("value", F.least(v, F.lit(high)) if high is not None else v)


def golden_order(n: int) -> list[int]:
    """Subsets visited by a step of about n / 1.618, raised until it shares no factor with n."""
    step = max(1, round(n / 1.6180339887498949))
    while math.gcd(step, n) > 1:
        step += 1
    return [i * step % n for i in range(n)]


def algebraic(matrix: DataFrame, b: DataFrame, iterations: int, relax: float = 1.0, decay: float = 1.0, subsets: Callable[[Column], Column] | None = None, n_subsets: int = 1, golden: bool = False, low: float | None = 0.0, high: float | None = None, x0: DataFrame | None = None) -> DataFrame:
    """SIRT (one subset), OS-SART or SART: x += relax * C^-1 A' R^-1 (b - A x) per subset, then bounds."""
    subsets = subsets or (lambda ray: F.lit(0))
    order = golden_order(n_subsets) if golden else range(n_subsets)
    parts = {}
    for s in order:
        own = matrix.where(subsets(F.col("ray_id")) == s) if n_subsets > 1 else matrix
        parts[s] = own, settle(row_sums(own)), settle(column_sums(own))
    x = settle(x0 or zeros(matrix))
    for _ in range(iterations):
        for s in order:
            own, rows, columns = parts[s]
            r = residual(own, b.join(rows.select("ray_id"), "ray_id"), x).join(rows, "ray_id").select("ray_id", (F.col("value") / (F.col("total") + EPS)).alias("value"))
            step = back(own, r).join(columns, "voxel_id").select("voxel_id", (F.col("value") / (F.col("total") + EPS)).alias("value"))
            x = settle(bounded(axpy(x, relax, step, "voxel_id"), low, high))
            relax *= decay
    return x


def cgls(matrix: DataFrame, b: DataFrame, iterations: int) -> DataFrame:
    """Conjugate gradients on the normal equations.

    A step that raises the residual is undone, and the directions start afresh from
    the residual of the volume kept; a second such step in a row ends the run.
    """
    x, r = settle(zeros(matrix)), settle(b.select("ray_id", "value"))
    p = settle(back(matrix, r))
    gamma, size, fresh = norm2(p), norm2(r), False
    for _ in range(iterations):
        q = settle(forward(matrix, p))
        qq = norm2(q)
        if qq < EPS * EPS:
            break
        alpha = gamma / qq
        x_new, r_new = settle(axpy(x, alpha, p, "voxel_id")), settle(axpy(r, -alpha, q, "ray_id"))
        size_new = norm2(r_new)
        if size_new > size:
            if fresh:
                break
            r = settle(residual(matrix, b, x))
            p = settle(back(matrix, r))
            gamma, size, fresh = norm2(p), norm2(r), True
            continue
        x, r, size, fresh = x_new, r_new, size_new, False
        s = settle(back(matrix, r))
        gamma, before = norm2(s), gamma
        p = settle(axpy(s, gamma / (before + EPS * EPS), p, "voxel_id"))
    return x


# Penalties: gradients over the six neighbours of a voxel.
def neighbours(x: DataFrame, grid: Grid) -> DataFrame:
    """(voxel_id, value, other) for each of a voxel's up to six neighbours in the table."""
    i = F.col("voxel_id")
    ix, iy, iz = i % grid.nx, F.floor(i / grid.nx) % grid.ny, F.floor(i / (grid.nx * grid.ny))
    steps = [(ix > 0, -1), (ix < grid.nx - 1, 1), (iy > 0, -grid.nx), (iy < grid.ny - 1, grid.nx), (iz > 0, -grid.nx * grid.ny), (iz < grid.nz - 1, grid.nx * grid.ny)]
    sent = x.select("voxel_id", F.explode(F.filter(F.array(*(F.when(ok, i + k) for ok, k in steps)), lambda t: t.isNotNull())).alias("to"), F.col("value").alias("other"))
    return x.join(sent.select(F.col("to").alias("voxel_id"), "other"), "voxel_id")


def tikhonov_gradient(x: DataFrame, grid: Grid) -> DataFrame:
    return x


def quadratic_gradient(x: DataFrame, grid: Grid) -> DataFrame:
    return neighbours(x, grid).groupBy("voxel_id").agg(F.sum(F.col("value") - F.col("other")).alias("value"))


def slopes(x: DataFrame, grid: Grid, flat: bool = False) -> DataFrame:
    """(voxel_id, gx, gy, gz): differences to the next voxel of each axis over the voxel's size; 0 at the grid's end and next to voxels outside the table. ``flat``: none along z."""
    i = F.col("voxel_id")
    places = {"gx": (i % grid.nx, 1), "gy": (F.floor(i / grid.nx) % grid.ny, grid.nx), "gz": (F.floor(i / (grid.nx * grid.ny)), grid.nx * grid.ny)}
    size = dict(zip(places, grid.voxel, strict=True))
    sent = [F.when(place > 0, F.struct((i - k).alias("to"), F.lit(name).alias("axis"))) for name, (place, k) in places.items() if not (flat and name == "gz")]
    after = x.select(F.explode(F.filter(F.array(*sent), lambda t: t.isNotNull())).alias("s"), F.col("value").alias("next"))
    after = after.groupBy(F.col("s.to").alias("voxel_id")).agg(*(F.max(F.when(F.col("s.axis") == name, F.col("next"))).alias(name) for name in places))
    return x.join(after, "voxel_id", "left").select("voxel_id", *(F.coalesce((F.col(name) - F.col("value")) / size[name], F.lit(0.0)).alias(name) for name in places))


def _pull(rows: DataFrame, grid: Grid) -> DataFrame:
    """(voxel_id, pull): minus the divergence of the flux (voxel_id, gx, gy, gz)."""
    i, over = F.col("voxel_id"), [F.col(c) / h for c, h in zip(("gx", "gy", "gz"), grid.voxel, strict=True)]
    flux = [F.struct((i + k).alias("to"), c.alias("f")) for c, k in zip(over, (1, grid.nx, grid.nx * grid.ny), strict=True)] + [F.struct(i.alias("to"), (-over[0] - over[1] - over[2]).alias("f"))]
    return rows.select(F.explode(F.array(*flux)).alias("s")).groupBy(F.col("s.to").alias("voxel_id")).agg(F.sum("s.f").alias("pull"))


def _divergence(x: DataFrame, grid: Grid, weight: Callable[[Column], Column], flat: bool = False) -> DataFrame:
    """Minus the divergence of ``weight(norm of the slopes)`` times the slopes: a gradient over (voxel_id, value)."""
    g = [F.col(c) for c in ("gx", "gy", "gz")]
    w = weight(F.sqrt(g[0] * g[0] + g[1] * g[1] + g[2] * g[2]))
    flux = slopes(x, grid, flat).select("voxel_id", *((w * c).alias(n) for c, n in zip(g, ("gx", "gy", "gz"), strict=True)))
    return _pull(flux, grid).withColumnRenamed("pull", "value").join(x.select("voxel_id"), "voxel_id", "left_semi")


def huber_gradient(delta: float, flat: bool = False) -> Callable[[DataFrame, Grid], DataFrame]:
    """Of the Huber function of the slopes' norm."""
    return lambda x, grid: _divergence(x, grid, lambda n: 1 / F.greatest(F.lit(delta), n), flat)


def smoothed_tv_gradient(eps: float, flat: bool = False) -> Callable[[DataFrame, Grid], DataFrame]:
    """Of sqrt(|slopes|^2 + eps^2) - eps."""
    return lambda x, grid: _divergence(x, grid, lambda n: 1 / F.sqrt(n * n + eps * eps), flat)


def penalty_value(x: DataFrame, grid: Grid, kind: str, parameter: float = 1.0, flat: bool = False) -> float:
    """The penalty's value: ``tikhonov``; ``quadratic`` over neighbour pairs; ``huber``, ``smoothed_tv`` or ``tv`` of the slopes' norm."""
    if kind == "tikhonov":
        return 0.5 * norm2(x)
    if kind == "quadratic":
        d = F.col("value") - F.col("other")
        return neighbours(x, grid).agg(F.coalesce(F.sum(0.5 * d * d), F.lit(0.0)) / 2).first()[0]
    n = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + F.col("gz") * F.col("gz"))
    each = {"huber": F.when(n <= parameter, n * n / (2 * parameter)).otherwise(n - parameter / 2), "smoothed_tv": F.sqrt(n * n + parameter * parameter) - parameter, "tv": n}[kind]
    return slopes(x, grid, flat).agg(F.coalesce(F.sum(each), F.lit(0.0))).first()[0]


def smooth_by_tv(x: DataFrame, grid: Grid, rounds: int, step: float, eps: float) -> DataFrame:
    """Steps down the smoothed total variation, as taken after an outer iteration."""
    gradient = smoothed_tv_gradient(eps)
    for _ in range(rounds):
        x = settle(axpy(x, -step, gradient(x, grid), "voxel_id"))
    return x


def weighted_squares(matrix: DataFrame, b: DataFrame, weights: DataFrame, x: DataFrame, scale: float = 1.0) -> float:
    """scale / 2 times the weighted squares of b - A x; a weight that is negative or not finite stops the query."""
    w = F.col("weight")
    bad = F.isnan(w) | (w < 0) | (w == float("inf"))
    rows = residual(matrix, b, x).join(weights, "ray_id").withColumn("weight", F.when(bad, F.raise_error(F.lit("odd weight")).cast("double")).otherwise(w))
    return rows.agg(F.coalesce(F.sum(w * F.col("value") * F.col("value")), F.lit(0.0))).first()[0] * scale / 2


def lipschitz(matrix: DataFrame, weights: DataFrame) -> float:
    """The largest entry of A' W A 1."""
    one = row_sums(matrix).join(weights, "ray_id").select("ray_id", (F.col("total") * F.col("weight")).alias("value"))
    return back(matrix, one).agg(F.coalesce(F.max(F.abs("value")), F.lit(0.0))).first()[0]


def descend(matrix: DataFrame, b: DataFrame, grid: Grid, weights: DataFrame, iterations: int, strength: float, penalty: tuple[str, float], gradient, low: float | None = 0.0) -> DataFrame:
    """Gradient descent that never rises: a step is halved until objective <= before + 1e-12 max(1, |before|)."""
    x = settle(zeros(matrix))
    cost = lambda t: weighted_squares(matrix, b, weights, t) + strength * penalty_value(t, grid, *penalty)
    value, step = cost(x), 1.0 / max(lipschitz(matrix, weights), EPS)
    for _ in range(iterations):
        r = residual(matrix, b, x).join(weights, "ray_id").select("ray_id", (F.col("value") * F.col("weight")).alias("value"))
        down = settle(axpy(back(matrix, r), -strength, gradient(x, grid), "voxel_id"))
        for _ in range(30):
            new = settle(bounded(axpy(x, step, down, "voxel_id"), low, None))
            got = cost(new)
            if got <= value + 1e-12 * max(1.0, abs(value)):
                x, value = new, got
                break
            step /= 2
        else:
            break
    return x


def regularised(matrix: DataFrame, b: DataFrame, grid: Grid, iterations: int, relax: float, strength: float, gradient, low: float | None = 0.0) -> DataFrame:
    """An algebraic update, then a step down the penalty, one after the other."""
    x = zeros(matrix)
    for _ in range(iterations):
        x = algebraic(matrix, b, 1, relax, low=low, x0=x)
        x = settle(bounded(axpy(x, -strength, gradient(x, grid), "voxel_id"), low, None))
    return x


def tv_denoise(z: DataFrame, grid: Grid, strength: float, rounds: int) -> DataFrame:
    """The proximal map of total variation by the primal-dual iteration of Chambolle and Pock: min 1/2 |u - z|^2 + strength * TV(u)."""
    tau = sigma = 1 / sum(4 / h**2 for h in grid.voxel) ** 0.5  # of the difference operator's norm, at most this root
    u = bar = settle(z)
    axes = ("gx", "gy", "gz")
    p = settle(z.select("voxel_id", *(F.lit(0.0).alias(c) for c in axes)))
    for _ in range(rounds):
        g = slopes(bar, grid).select("voxel_id", *(F.col(c).alias(f"d{c}") for c in axes))
        moved = p.join(g, "voxel_id").select("voxel_id", *((F.col(c) + sigma * F.col(f"d{c}")).alias(c) for c in axes))
        size = F.greatest(F.lit(1.0), F.sqrt(sum((F.col(c) * F.col(c) for c in axes), F.lit(0.0))) / strength)
        p = settle(moved.select("voxel_id", *((F.col(c) / size).alias(c) for c in axes)))
        adjoint = _pull(p, grid)
        rows = u.join(adjoint, "voxel_id", "left").join(z.withColumnRenamed("value", "z"), "voxel_id")
        new = (F.col("value") - tau * F.coalesce("pull", F.lit(0.0)) + tau * F.col("z")) / (1 + tau)
        both = settle(rows.select("voxel_id", new.alias("value"), (2 * new - F.col("value")).alias("bar")))
        u, bar = both.select("voxel_id", "value"), both.select("voxel_id", F.col("bar").alias("value"))
    return u


def penalised(matrix: DataFrame, b: DataFrame, grid: Grid, iterations: int, step: float, strength: float, gradient=tikhonov_gradient, weights: DataFrame | None = None, low: float | None = 0.0, nesterov: bool = False) -> DataFrame:
    """Gradient steps on the weighted squares of b - A x plus a penalty; Nesterov's momentum on request."""
    x = settle(zeros(matrix))
    before, t = x, 1.0
    for _ in range(iterations):
        r = residual(matrix, b, x)
        if weights is not None:
            r = r.join(weights, "ray_id").select("ray_id", (F.col("value") * F.col("weight")).alias("value"))
        down = axpy(back(matrix, r), -strength, gradient(x, grid), "voxel_id")
        new = settle(bounded(axpy(x, step, down, "voxel_id"), low, None))
        if nesterov:
            nxt = (1 + (1 + 4 * t * t) ** 0.5) / 2
            gamma = (1 - t) / nxt
            x, before, t = settle(axpy(new.withColumn("value", F.col("value") * (1 - gamma)), gamma, before, "voxel_id")), new, nxt
        else:
            x = new
    return before if nesterov else x


def pwls(matrix: DataFrame, b: DataFrame, grid: Grid, weights: DataFrame, iterations: int, strength: float, relax: float = 1.0) -> DataFrame:
    """Penalised weighted least squares with separable curvature: A' W A 1 plus the penalty's 2 * neighbours."""
    one = row_sums(matrix).join(weights, "ray_id").select("ray_id", (F.col("total") * F.col("weight")).alias("value"))
    curve = back(matrix, one).withColumnRenamed("value", "curve")
    x = settle(zeros(matrix))
    count = neighbours(x, grid).groupBy("voxel_id").agg(F.count(F.lit(1)).alias("k"))
    curve = settle(curve.join(count, "voxel_id", "left").select("voxel_id", (F.col("curve") + strength * 2 * F.coalesce("k", F.lit(0)) + EPS).alias("curve")))
    for _ in range(iterations):
        r = residual(matrix, b, x).join(weights, "ray_id").select("ray_id", (F.col("value") * F.col("weight")).alias("value"))
        down = axpy(back(matrix, r), -strength, quadratic_gradient(x, grid), "voxel_id")
        step = down.join(curve, "voxel_id").select("voxel_id", (F.col("value") / F.col("curve")).alias("value"))
        x = settle(bounded(axpy(x, relax, step, "voxel_id"), 0.0, None))
    return x


def convergence(matrix: DataFrame, b: DataFrame, x: DataFrame, before: DataFrame) -> dict[str, float]:
    """Relative residual and relative update of one iteration."""
    change = norm2(axpy(x, -1.0, before, "voxel_id")) ** 0.5
    return {"residual": (norm2(residual(matrix, b, x)) / max(norm2(b), EPS)) ** 0.5, "update": change / max(norm2(x) ** 0.5, EPS)}

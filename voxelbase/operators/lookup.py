"""Joins and table look-ups: required joins, as-of interpolation, inversion, soft assignment.

Look-up tables here are calibration curves of a few hundred nodes at most, so
they are literals in the plan; a row finds its interval without a join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_required(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """An inner join in which a row without a partner stops the query."""
    found = rows.join(table.withColumn("__found", F.lit(True)), key, "left")
    fault = F.when(F.col("__found").isNull(), F.raise_error(F.concat(F.lit(f"no entry for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return found.where(fault.cast("string").isNull()).drop("__found")


def unmatched(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return rows.join(table.select(key), key, "left_anti")


def _intervals(x: Column, nodes: list[float], piece, below: Column, above: Column) -> Column:
    out = F.when(x < nodes[0], below)
    for i in range(len(nodes) - 1):
        out = out.when(x < nodes[i + 1], piece(i))
    return out.otherwise(above)


def piecewise_linear(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between knots, constant beyond the ends."""
    xs = [k[0] for k in knots]

    def piece(i: int) -> Column:
        (a, p), (b, q) = knots[i], knots[i + 1]
        return F.lit(p) + (x - a) * F.lit((q - p) / (b - a))

    return _intervals(x, xs, piece, F.lit(knots[0][1]), F.lit(knots[-1][1]))


def log_linear(x: Column, knots: list[tuple[float, float]]) -> Column:
    """The logarithm linear between knots of positive values, constant beyond the ends."""
    return F.exp(piecewise_linear(x, [(a, math.log(p)) for a, p in knots]))


def trilinear(points: DataFrame, volume: DataFrame, grid) -> DataFrame:
    """Points (k, a, b, c: places in voxels) with the volume's value there, 0 outside: each point meets its eight voxels."""
    low = {c: F.floor(c) for c in "abc"}
    corners = F.array(*(F.struct((low["a"] + i).alias("i"), (low["b"] + j).alias("j"), (low["c"] + m).alias("m")) for i in (0, 1) for j in (0, 1) for m in (0, 1)))
    rows = points.select("k", "a", "b", "c", F.explode(corners).alias("q")).select("k", "a", "b", "c", "q.*")
    inside = F.col("i").between(0, grid.nx - 1) & F.col("j").between(0, grid.ny - 1) & F.col("m").between(0, grid.nz - 1)
    rows = rows.withColumn("voxel_id", F.when(inside, (F.col("m") * grid.ny + F.col("j")) * grid.nx + F.col("i")))
    share = (1 - F.abs(F.col("a") - F.col("i"))) * (1 - F.abs(F.col("b") - F.col("j"))) * (1 - F.abs(F.col("c") - F.col("m")))
    return rows.join(volume, "voxel_id", "left").groupBy("k").agg(F.sum(share * F.coalesce("value", F.lit(0.0))).alias("value"))


def inverse_linear(y: Column, knots: list[tuple[float, float]]) -> Column:
    """The abscissa of y on a rising curve."""
    return piecewise_linear(y, [(b, a) for a, b in knots])


def pchip_slopes(knots: list[tuple[float, float]]) -> list[float]:
    """Monotone slopes: weighted harmonic means inside, limited one-sided slopes at the ends."""
    h = [b[0] - a[0] for a, b in zip(knots, knots[1:], strict=False)]
    d = [(b[1] - a[1]) / w for a, b, w in zip(knots, knots[1:], h, strict=False)]

    def end(h0: float, h1: float, d0: float, d1: float) -> float:
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if s * d0 <= 0:
            return 0.0
        return 3 * d0 if d0 * d1 < 0 and abs(s) > 3 * abs(d0) else s

    if len(d) == 1:
        return [d[0], d[0]]
    inner = []
    for i in range(1, len(d)):
        if d[i - 1] * d[i] <= 0:
            inner.append(0.0)
        else:
            w1, w2 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            inner.append((w1 + w2) / (w1 / d[i - 1] + w2 / d[i]))
    return [end(h[0], h[1], d[0], d[1]), *inner, end(h[-1], h[-2], d[-1], d[-2])]


def pchip(x: Column, knots: list[tuple[float, float]]) -> Column:
    slopes = pchip_slopes(knots)

    def piece(i: int) -> Column:
        (a, p), (b, q) = knots[i], knots[i + 1]
        h, t = b - a, (x - a) / (b - a)
        return p * (1 + 2 * t) * (1 - t) * (1 - t) + h * slopes[i] * t * (1 - t) * (1 - t) + q * t * t * (3 - 2 * t) + h * slopes[i + 1] * t * t * (t - 1)

    return _intervals(x, [k[0] for k in knots], piece, F.lit(knots[0][1]), F.lit(knots[-1][1]))


def bilinear(x: Column, y: Column, table: list[list[float]]) -> Column:
    """table[row][column] at (x: column, y: row); null outside."""
    rows = F.array(*(F.array(*map(F.lit, r)) for r in table))
    i, j = F.floor(x).cast("int"), F.floor(y).cast("int")
    fx, fy = x - i, y - j
    at = lambda r, c: F.get(F.get(rows, r), c)
    blend = (1 - fy) * ((1 - fx) * at(j, i) + fx * at(j, i + 1)) + fy * ((1 - fx) * at(j + 1, i) + fx * at(j + 1, i + 1))
    return F.when((x >= 0) & (y >= 0) & (x < len(table[0]) - 1) & (y < len(table) - 1), blend)


def soft_assign(rows: DataFrame, x: str) -> DataFrame:
    """Each row split between its lower and upper basis node by linear weights."""
    low, part = F.floor(x).cast("int"), F.col(x) - F.floor(x)
    both = F.array(F.struct(low.alias("node"), (1 - part).alias("weight")), F.struct((low + 1).alias("node"), part.alias("weight")))
    return rows.select("*", F.explode(both).alias("__n")).select(*rows.columns, "__n.node", "__n.weight")

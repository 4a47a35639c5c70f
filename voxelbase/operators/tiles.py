"""Filters of images and volumes in Arrow tiles with halos.

A plane is one row (z, data: ny * nx values). A tile is a run of planes with the
planes next to it that a filter reaches into, so only those halos are sent twice;
tiles are independent and of bounded size. Borders are replicated.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Planes in a tile, halos apart.
DEPTH = 32
PLANES = "z long, data array<double>"


def map_tiles(planes: DataFrame, ny: int, nx: int, halo: int, step: Callable, depth: int = DEPTH) -> DataFrame:
    """(z, data) under ``step``, which takes (n + 2 halo, ny, nx) values to (n, ny, nx). Planes are numbered without gaps.

    Its second argument gives, for a result with a halo of h planes, the rows that replicate the volume's own ends.
    """
    ends = planes.agg(F.min("z"), F.max("z")).first()
    if ends[0] is None:
        return planes.select("z", "data")
    low, high = ends

    def run(key, table):
        table = table.sort_by("z")
        z = table.column("z").to_numpy()
        data = table.column("data").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, ny, nx)
        first, last = key[0].as_py() * depth + low, min(key[0].as_py() * depth + low + depth, high + 1)
        rows = np.clip(np.arange(first - halo, last + halo), low, high) - z[0]
        out = step(data[rows], lambda h: np.clip(np.arange(first - h, last + h), low, high) - (first - h))
        flat = pa.array(out.reshape(-1))
        return pa.table({"z": pa.array(np.arange(first, last)), "data": pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, ny * nx, dtype=np.int32), flat)})

    tile = lambda z: F.floor((z - low) / depth)
    ids = F.sequence(F.greatest(tile(F.col("z") - halo), F.lit(0)), F.least(tile(F.col("z") + halo), F.lit((high - low) // depth)))
    return planes.select(F.explode(ids).alias("tile"), F.col("z").cast("long").alias("z"), "data").groupBy("tile").applyInArrow(run, PLANES)


def along(x: np.ndarray, kernel: list[float], axis: int) -> np.ndarray:
    """A centred kernel along one axis, border replicated; along axis 0 the halo is used up instead."""
    r = len(kernel) // 2
    if axis:
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        x = np.pad(x, pad, mode="edge")
    n = x.shape[axis] - 2 * r
    at = lambda k: tuple(slice(k, k + n) if a == axis else slice(None) for a in range(3))
    out = kernel[0] * x[at(0)]
    for k in range(1, len(kernel)):
        out += kernel[k] * x[at(k)]
    return out


def separable(kernel: list[float], flat: bool) -> Callable:
    """One kernel along every axis (``flat``: of each plane only)."""
    return lambda x, ends=None: along(along(x if flat else along(x, kernel, 0), kernel, 1), kernel, 2)


def bilateral(radius: int, sigma: float, sigma_value: float, flat: bool) -> Callable:
    reach = range(-radius, radius + 1)

    def step(x: np.ndarray, ends: Callable) -> np.ndarray:
        h = 0 if flat else radius
        n = len(x) - 2 * h
        centre = x[h : h + n]
        wide = np.pad(x, [(0, 0), (radius, radius), (radius, radius)], mode="edge")
        total, weight = np.zeros_like(centre), np.zeros_like(centre)
        for c in (0,) if flat else reach:
            for b in reach:
                for a in reach:
                    v = wide[h + c : h + c + n, radius + b : radius + b + centre.shape[1], radius + a : radius + a + centre.shape[2]]
                    w = math.exp(-(a * a + b * b + c * c) / (2 * sigma * sigma)) * np.exp(-((v - centre) ** 2) / (2 * sigma_value * sigma_value))
                    total += w * v
                    weight += w
        return total / weight

    return step


def guided(radius: int, eps: float, flat: bool) -> Callable:
    """Self-guided: local linear models, averaged over the windows that hold a voxel. The halo is twice the radius."""
    mean = separable([1 / (2 * radius + 1)] * (2 * radius + 1), flat)

    def step(x: np.ndarray, ends: Callable) -> np.ndarray:
        h = 0 if flat else radius
        m = mean(x)
        var = np.maximum(mean(x * x) - m * m, 0.0)
        a = var / (var + eps)
        m, a = m[ends(h)], a[ends(h)]
        return x[2 * h : len(x) - 2 * h] * mean(a) + mean((1 - a) * m)

    return step


def local_maxima(planes: DataFrame, ny: int, nx: int, least: float) -> DataFrame:
    """(z, y, x) of values of at least ``least`` that none of the eight neighbours in the plane exceeds."""

    def step(batches):
        for batch in batches:
            data = batch.column("data").flatten().to_numpy(zero_copy_only=False).reshape(-1, ny, nx)
            wide = np.pad(data, [(0, 0), (1, 1), (1, 1)], mode="edge")
            top = np.max([wide[:, b : b + ny, a : a + nx] for b in range(3) for a in range(3)], axis=0)
            i, y, x = np.nonzero((data >= least) & (data >= top))
            yield pa.RecordBatch.from_arrays([batch.column("z").take(pa.array(i)), pa.array(y), pa.array(x)], names=["z", "y", "x"])

    return planes.select(F.col("z").cast("long").alias("z"), "data").mapInArrow(step, "z long, y long, x long")


def squared_distance(planes: DataFrame, ny: int, nx: int, threshold: float) -> DataFrame:
    """(z, data): squared distance of every pixel to the nearest one above ``threshold`` in its plane; infinite where there is none.

    Two passes of minima: along rows, then along columns.
    """

    def step(batches):
        dx, dy = (np.arange(n)[:, None] - np.arange(n) for n in (nx, ny))
        for batch in batches:
            hit = batch.column("data").flatten().to_numpy(zero_copy_only=False).reshape(-1, ny, nx) > threshold
            rows = np.where(hit[:, :, None, :], (dx * dx)[None, None], np.inf).min(axis=3)
            both = (rows[:, None, :, :] + (dy * dy)[None, :, :, None]).min(axis=2)
            flat = pa.array(both.reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column("z"), pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, ny * nx, dtype=np.int32), flat)], names=["z", "data"])

    return planes.select(F.col("z").cast("long").alias("z"), "data").mapInArrow(step, PLANES)


def labels(hit: np.ndarray) -> np.ndarray:
    """8-connected components of each plane (n, ny, nx), named by their first pixel in row-major order; ny * nx elsewhere.

    Labels spread to neighbours until they rest.
    """
    _, ny, nx = hit.shape
    far = ny * nx
    label = np.where(hit, np.arange(far).reshape(ny, nx), far)
    while True:
        wide = np.pad(label, [(0, 0), (1, 1), (1, 1)], constant_values=far)
        new = np.where(hit, np.min([wide[:, b : b + ny, a : a + nx] for b in range(3) for a in range(3)], axis=0), far)
        if (new == label).all():
            return label
        label = new


def components(planes: DataFrame, ny: int, nx: int, threshold: float, least: int = 1) -> DataFrame:
    """(z, component, area, y, x, weight_y, weight_x): 8-connected components of each plane, named by their first pixel in row-major order.

    y and x are the mean place, the others weighted by max(value - threshold, 1e-6).
    """

    def step(batches):
        for batch in batches:
            data = batch.column("data").flatten().to_numpy(zero_copy_only=False).reshape(-1, ny, nx)
            hit = data > threshold
            far = ny * nx
            label = labels(hit)
            i, y, x = np.nonzero(hit)
            key, where = np.unique(i * far + label[i, y, x], return_inverse=True)
            w = np.maximum(data[i, y, x] - threshold, 1e-6)
            total = lambda v, where=where, n=len(key): np.bincount(where, weights=v, minlength=n)
            area = total(np.ones(len(i)))
            cols = [total(y) / area, total(x) / area, total(w * y) / total(w), total(w * x) / total(w)] if len(key) else [np.zeros(0)] * 4
            big = area >= least
            out = [batch.column("z").take(pa.array(key[big] // far)), pa.array(key[big] % far), pa.array(area[big].astype(np.int64)), *(pa.array(c[big]) for c in cols)]
            yield pa.RecordBatch.from_arrays(out, names=["z", "component", "area", "y", "x", "weight_y", "weight_x"])

    return planes.select(F.col("z").cast("long").alias("z"), "data").mapInArrow(step, "z long, component long, area long, y double, x double, weight_y double, weight_x double")

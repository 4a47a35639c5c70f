"""Neighbourhood operators on frames and volumes: filters, resampling, crosstalk, afterglow, erosion.

A frame row carries its pixels as an array, so stencils along u are array
functions in the row (no shuffle); stencils across views or voxels are windows
or joins on the index.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelbase.operators.projector import Grid


def _at(data: Column, i: Column) -> Column:
    """The element at i with the border replicated."""
    return F.get(data, F.least(F.greatest(i, F.lit(0)), F.size(data) - 1))


def mean_kernel(radius: int) -> list[float]:
    return [1 / (2 * radius + 1)] * (2 * radius + 1)


def gaussian_kernel(sigma: float, radius: int) -> list[float]:
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def frame_map(frames: DataFrame, step) -> DataFrame:
    """``step`` (numpy array to numpy array) over each frame's pixels, for chains of stencils within a frame."""

    def run(batches):
        for b in batches:
            data = pa.array([step(x.values.to_numpy()) for x in b.column("data")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("view"), data], names=["view", "data"])

    return frames.select("view", "data").mapInArrow(run, "view long, data array<double>")


def _stencil(x: np.ndarray, kernel: list[float]) -> np.ndarray:
    r = len(kernel) // 2
    return np.correlate(np.pad(x, r, mode="edge"), kernel, mode="valid")


def convolve(frames: DataFrame, kernel: list[float]) -> DataFrame:
    """A centred correlation of each row with a short kernel of odd length, replicated border."""
    return frame_map(frames, lambda x: _stencil(x, kernel))


def crosstalk(frames: DataFrame, kernel: list[float]) -> DataFrame:
    """An asymmetric kernel, cut at the border and normalised over what is left."""
    r = len(kernel) // 2
    inside = lambda x: np.correlate(np.pad(x, r), kernel, mode="valid")
    return frame_map(frames, lambda x: inside(x) / inside(np.ones_like(x)))


def bilateral(frames: DataFrame, radius: int, sigma: float, sigma_value: float) -> DataFrame:
    def step(x: np.ndarray) -> np.ndarray:
        near = np.lib.stride_tricks.sliding_window_view(np.pad(x, radius, mode="edge"), 2 * radius + 1)
        w = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma)) * np.exp(-((near - x[:, None]) ** 2) / (2 * sigma_value * sigma_value))
        return (w * near).sum(axis=1) / w.sum(axis=1)

    return frame_map(frames, step)


def guided(frames: DataFrame, radius: int, eps: float) -> DataFrame:
    """Self-guided filter of ``data``: local linear models averaged over the window."""
    k = mean_kernel(radius)

    def step(x: np.ndarray) -> np.ndarray:
        m = _stencil(x, k)
        var = _stencil(x * x, k) - m * m
        a = var / (var + eps)
        return x * _stencil(a, k) + _stencil(m * (1 - a), k)

    return frame_map(frames, step)


def scatter_fixed_point(frames: DataFrame, kernel: list[float], rounds: int, damping: float, floor: float) -> DataFrame:
    """Damped fixed point of primary = measured - kernel * primary, kept above ``floor``."""

    def step(measured: np.ndarray) -> np.ndarray:
        p = measured
        for _ in range(rounds):
            p = (1 - damping) * p + damping * np.maximum(measured - _stencil(p, kernel), floor)
        return p

    return frame_map(frames, step)


def resize_linear(data: Column, size: int) -> Column:
    """``size`` samples at (c + 1/2) s - 1/2, linear, clamped at the ends."""
    scale = F.size(data) / F.lit(size)

    def one(c: Column) -> Column:
        u = F.least(F.greatest((c + 0.5) * scale - 0.5, F.lit(0.0)), F.size(data) - 1.0)
        i = F.floor(u).cast("int")
        return (1 - (u - i)) * _at(data, i) + (u - i) * _at(data, i + 1)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), one)


def resize_nearest(data: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda c: _at(data, F.floor((c + 0.5) * (F.size(data) / F.lit(size))).cast("int")))


def resize_area(data: Column, size: int) -> Column:
    """Exact overlap averages, for shrinking."""

    def one(c: Column) -> Column:
        scale = F.size(data) / F.lit(size)
        low, high = c * scale, (c + 1) * scale
        parts = F.transform(data, lambda x, i: x * F.greatest(F.least(i + 1.0, high) - F.greatest(i.cast("double"), low), F.lit(0.0)))
        return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / scale

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), one)


def difference(data: Column) -> Column:
    """Forward differences; 0 at the end."""
    return F.transform(data, lambda x, i: _at(data, i + 1) - x)


def local_maxima(data: Column, least: float) -> Column:
    """Indices of elements of at least ``least`` that no neighbour exceeds."""
    pairs = F.transform(data, lambda x, i: F.struct(i.alias("i"), ((x >= least) & (x >= _at(data, i - 1)) & (x >= _at(data, i + 1))).alias("top")))
    return F.transform(F.filter(pairs, lambda p: p["top"]), lambda p: p["i"])


def afterglow(pixels: DataFrame, keys: list[str], order: str, weight: float, decay: float, length: int) -> DataFrame:
    """One exponential trap along ``order``: out = (1 - weight) s + state, state' = decay (state + weight s).

    The trap forgets: after ``length`` steps less than decay^length of a signal is
    left. A pixel's state is a weighted sum over a window of that length, so a
    task never holds a pixel's whole history.
    """
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(-length, -1)
    past = F.collect_list(F.struct(F.col(order).alias("y"), F.col("value").alias("s"))).over(w)
    rows = pixels.withColumn("__past", past)
    state = F.aggregate("__past", F.lit(0.0), lambda a, p: a + F.pow(F.lit(decay), (F.col(order) - p["y"]).cast("double")) * weight * p["s"])
    return rows.withColumn("out", (1 - weight) * F.col("value") + state).drop("__past")


def predict_tracks(tracks: DataFrame) -> DataFrame:
    """(target, view, predicted): 2 previous - the one before."""
    w = Window.partitionBy("target").orderBy("view")
    return tracks.withColumn("predicted", 2 * F.lag("u", 1).over(w) - F.lag("u", 2).over(w))


def stagnation(runs: DataFrame, least: float) -> DataFrame:
    """(solver, iteration, relative change, number of iterations in a row below ``least``)."""
    w = Window.partitionBy("solver").orderBy("iteration")
    change = F.abs(F.col("residual") - F.lag("residual").over(w)) / F.lag("residual").over(w)
    rows = runs.withColumn("change", change).withColumn("slow", F.coalesce(F.col("change") < least, F.lit(False)))
    rows = rows.withColumn("group", F.sum(F.when(F.col("slow"), 0).otherwise(1)).over(w))
    g = Window.partitionBy("solver", "group").orderBy("iteration")
    return rows.withColumn("patience", F.sum(F.col("slow").cast("int")).over(g)).drop("group", "slow")


def erode(labels: DataFrame, grid: Grid, rounds: int = 1) -> DataFrame:
    """Voxels whose 26 neighbours (inside the grid) all have their label; voxels at the border are eroded."""
    for _ in range(rounds):
        i = F.col("voxel_id")
        ix, iy, iz = i % grid.nx, F.floor(i / grid.nx) % grid.ny, F.floor(i / (grid.nx * grid.ny))
        moves = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
        sent = [F.when((ix + a).between(0, grid.nx - 1) & (iy + b).between(0, grid.ny - 1) & (iz + c).between(0, grid.nz - 1), i + (c * grid.ny + b) * grid.nx + a) for a, b, c in moves]
        spread = labels.select(F.explode(F.filter(F.array(*sent), lambda t: t.isNotNull())).alias("voxel_id"), "label")
        full = spread.groupBy("voxel_id", "label").agg(F.count(F.lit(1)).alias("n")).where("n = 27")
        labels = labels.join(full.select("voxel_id", "label"), ["voxel_id", "label"], "left_semi")
    return labels

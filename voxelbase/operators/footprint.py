"""Separable-footprint projectors without a matrix table.

Around a voxel's centre the projection is linear, so a voxel covers a box of the detector: its
sides are the sums of the slopes times the voxel's sides, its weight the voxel's volume
times the density of rays over the box's area. Forward scatters blocks of voxels into the
views' pixels, back gathers from packets of views into slabs of voxels; both ask the same
function for boxes, weights and overlaps, so one is the transpose of the other.

Geometries are bounded tables (a row a view) and travel inside the tasks; volumes and frames
stay distributed. Boxes that miss the detector add nothing; pixels are squares around their
centres.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelbase.plans.shares import SALTS, SCHEMA, add_shares, share, slab_depth

from .geometry import Scan, projection_matrix
from .projector import Grid

#: Voxels in a block, views in a packet, and the most views whose matrices a task holds (10 MB).
BLOCK, VIEWS, MOST_VIEWS = 1 << 15, 32, 100_000


def view_matrices(geometry: DataFrame) -> dict[int, np.ndarray]:
    """The 3 x 4 matrix of each view; more than ``MOST_VIEWS`` are refused."""
    rows = projection_matrix(geometry).limit(MOST_VIEWS + 1).collect()
    if len(rows) > MOST_VIEWS:
        raise ValueError(f"more than {MOST_VIEWS} views in one geometry")
    return {r.view: np.array(r.p).reshape(3, 4) for r in rows}


def _boxes(p: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, grid: Grid):
    """Lower and upper edges of the voxels' boxes in pixels, (u0, u1, v0, v1), and their weights (0 where there is no box)."""
    a, b, c = (r[0] * x + r[1] * y + r[2] * z + r[3] for r in p)
    seen = np.abs(c) > 1e-12
    c = np.where(seen, c, 1.0)
    u, v = a / c, b / c
    du = [(p[0, i] - u * p[2, i]) / c for i in range(3)]
    dv = [(p[1, i] - v * p[2, i]) / c for i in range(3)]
    half_u, half_v = (sum(np.abs(g) * s for g, s in zip(d, grid.voxel, strict=True)) / 2 for d in (du, dv))
    rays = np.sqrt((du[1] * dv[2] - du[2] * dv[1]) ** 2 + (du[2] * dv[0] - du[0] * dv[2]) ** 2 + (du[0] * dv[1] - du[1] * dv[0]) ** 2)
    seen &= (half_u > 0) & (half_v > 0)
    weight = np.where(seen, np.prod(grid.voxel) * rays / np.where(seen, 4 * half_u * half_v, 1.0), 0.0)
    return u - half_u, u + half_u, v - half_v, v + half_v, weight


def _overlaps(low: np.ndarray, high: np.ndarray, n: int):
    """For each pixel of the widest box, (pixel of every voxel, its overlap with the box), outside the detector left out by overlap 0."""
    first = np.ceil(low - 0.5)
    for k in range(int(np.max(np.floor(high + 0.5) - first, initial=-1)) + 1):
        pixel = first + k
        over = np.maximum(0.0, np.minimum(high, pixel + 0.5) - np.maximum(low, pixel - 0.5))
        inside = (pixel >= 0) & (pixel < n)
        yield np.where(inside, pixel, 0).astype(np.int64), np.where(inside, over, 0.0)


def _centres(ids: np.ndarray, grid: Grid):
    index = (ids % grid.nx, ids // grid.nx % grid.ny, ids // (grid.nx * grid.ny))
    return [e + (i + 0.5) * s for i, e, s in zip(index, grid.edge, grid.voxel, strict=True)]


def _cells(p: np.ndarray, ids: np.ndarray, scan: Scan, grid: Grid):
    """(pixel of every voxel, weight of it): the matrix's entries of one view and these voxels, some at a time."""
    u0, u1, v0, v1, weight = _boxes(p, *_centres(ids, grid), grid)
    columns = list(_overlaps(u0, u1, scan.nu))
    for row, over_v in _overlaps(v0, v1, scan.nv):
        for column, over_u in columns:
            yield row * scan.nu + column, weight * over_v * over_u


def forward(volume: DataFrame, geometry: DataFrame, scan: Scan, grid: Grid) -> DataFrame:
    """(view, data) of (voxel_id, value): frames of nv rows of nu pixels, one for every view."""
    matrices, pixels = view_matrices(geometry), scan.nu * scan.nv

    def run(key, table):
        block, packet = key[0].as_py(), key[1].as_py()
        ids, values = table.column("voxel_id").to_numpy(), table.column("value").to_numpy()
        parts = []
        for view in sorted(matrices)[packet * VIEWS : (packet + 1) * VIEWS]:
            frame = np.zeros(pixels)
            for pixel, weight in _cells(matrices[view], ids, scan, grid):
                frame += np.bincount(pixel, weight * values, pixels)
            if frame.any():
                parts.append(share(view, block, frame))
        return pa.Table.from_batches(parts, schema=share(0, 0, np.zeros(1)).schema)

    packets = -(-len(matrices) // VIEWS)
    rows = volume.where("value <> 0").select("voxel_id", F.col("value").cast("double").alias("value"))
    rows = rows.withColumn("packet", F.explode(F.sequence(F.lit(0), F.lit(packets - 1))))
    shares = rows.groupBy(F.floor(F.col("voxel_id") / BLOCK).alias("block"), "packet").applyInArrow(run, SCHEMA)
    blank = geometry.select(F.col("view").cast("long").alias("slab"), F.lit(0).cast("long").alias("part"), F.array_repeat(F.lit(0.0), pixels).alias("share"))

    def add(key, table):
        total = np.sum([x.values.to_numpy(zero_copy_only=False) for x in table.column("share")], axis=0)
        return pa.Table.from_batches([share(key[0].as_py(), 0, total)])

    fewer = shares.groupBy("slab", F.pmod("part", F.lit(SALTS)).alias("salt")).applyInArrow(add, SCHEMA).unionByName(blank)
    return fewer.groupBy("slab").applyInArrow(add, SCHEMA).select(F.col("slab").alias("view"), F.col("share").alias("data"))


def back(frames: DataFrame, geometry: DataFrame, scan: Scan, grid: Grid) -> DataFrame:
    """(voxel_id, value) of (view, data): the transpose of ``forward``."""
    matrices, plane = view_matrices(geometry), grid.nx * grid.ny
    depth = slab_depth(grid)

    def run(batches):
        part = TaskContext.get().partitionId()
        for batch in batches:
            for s in range(0, batch.num_rows, VIEWS):
                some = batch.slice(s, VIEWS)
                frames = [(matrices[v], d.values.to_numpy(zero_copy_only=False)) for v, d in zip(some.column("view").to_pylist(), some.column("data"), strict=True)]
                for slab, first in enumerate(range(0, grid.nz, depth)):
                    out = np.zeros(plane * min(depth, grid.nz - first))
                    for i in range(0, len(out), BLOCK):
                        ids = first * plane + np.arange(i, min(len(out), i + BLOCK))
                        for p, data in frames:
                            for pixel, weight in _cells(p, ids, scan, grid):
                                out[i : i + BLOCK] += weight * data[pixel]
                    yield share(slab, part, out)
                part += 1

    return add_shares(frames.select("view", "data").mapInArrow(run, SCHEMA), depth * plane)

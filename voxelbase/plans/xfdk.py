"""Extended FDK of full circles (Grimmer, Oelhafen, Elstrom and Kachelriess 2009).

Frames are resampled to parallel views of (cone angle, distance from the axis) with the ray's
cosine, rows are filtered, and voxels near the edge of the cone, which some views miss, get
a partial-scan weight that blends in with the radius. A target view needs its neighbours
within the fan, round the circle; the frame's own resampling is narrow.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from voxelbase.operators.geometry import Scan
from voxelbase.operators.neighbour import frame_map
from voxelbase.operators.projector import Grid
from voxelbase.operators.rebin import sampler

from .fdk import FRAMES, filter_frames
from .halo import Gather
from .shares import SCHEMA, add_shares, share, slab_depth, zero_shares


@dataclass(frozen=True)
class Fan:
    """The grid of parallel views: nu distances from -R sin(beta) on, nv cone angles from -gamma on."""

    scan: Scan
    beta: float
    gamma: float
    first: float
    spacing: float
    rise: float  # between cone angles
    step: float  # between views, signed

    @property
    def radius(self) -> float:
        """Of the cylinder that all views see whole."""
        return min((self.scan.nu - 1) / 2 * self.scan.du, self.scan.sid * math.sin(self.beta))


def fan_of(scan: Scan) -> Fan:
    if scan.views < 3 or (scan.per_turn or scan.views) != scan.views or scan.pitch or scan.start_z or any(scan.offset) or any(scan.tilt):
        raise ValueError("only full circles without offsets or tilts")
    beta, gamma = (math.atan((n - 1) / 2 * d / scan.sdd) for n, d in ((scan.nu, scan.du), (scan.nv, scan.dv)))
    if not (beta > 0 and gamma > 0):
        raise ValueError("the detector needs two rows and two channels at least")
    edge = scan.sid * math.sin(beta)
    return Fan(scan, beta, gamma, -edge, 2 * edge / (scan.nu - 1), 2 * gamma / (scan.nv - 1), scan.direction * 2 * math.pi / scan.views)


def resampled(frames: DataFrame, scan: Scan) -> DataFrame:
    """(view, data): each frame at the places of the parallel grid, times the cosine of the ray."""
    f = fan_of(scan)
    beta = np.arcsin(np.clip(-(f.first + np.arange(scan.nu) * f.spacing) / scan.sid, -1, 1))[None, :]
    gamma = (-f.gamma + np.arange(scan.nv) * f.rise)[:, None]
    u = -scan.sdd * np.tan(beta) / scan.du + (scan.nu - 1) / 2
    v = scan.sdd * np.tan(gamma) / (np.cos(beta) * scan.dv) + (scan.nv - 1) / 2
    sample, cosine = sampler(u, v, scan.nu, scan.nv), (np.cos(beta) * np.cos(gamma)).ravel()
    return frame_map(frames, lambda x: sample(x) * cosine)


def gather_of(scan: Scan) -> Gather:
    """How columns of resampled frames make parallel views: linear between two views."""
    f = fan_of(scan)
    late = np.arcsin(np.clip((f.first + np.arange(scan.nu) * f.spacing) / scan.sid, -1, 1)) / f.step
    first, column = np.floor(late).astype(int), np.arange(scan.nu)
    return Gather(scan.views, scan.nv, scan.nu, [(first + m, column, late - first if m else 1 - late + first) for m in (0, 1)], period=scan.views)


def filtered(views: DataFrame, scan: Scan, window: str = "ram_lak", cutoff: float = 0.5) -> DataFrame:
    return filter_frames(views, replace(scan, du=fan_of(scan).spacing), window, cutoff)


def coverage(f: Fan, r: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Half of the angle range beyond half a turn in which a voxel is seen: pi / 2 where all views see it, below 0 where too few do."""
    sid, lost = f.scan.sid, np.abs(z) / math.tan(f.gamma)
    left = sid - lost
    beyond = np.maximum(r * r - left * left, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        partly = np.arcsin(np.clip(left / r, -1, 1)) - np.arctan(np.sqrt(beyond) / lost)
    out = np.where((r <= left) | (beyond <= 0), np.pi / 2, np.clip(partly, 0, np.pi / 2))
    return np.where((r >= sid) | (lost > (sid * sid - r * r) / sid + 8e-6 * sid), -1.0, out)


def ray_weight(f: Fan, r: np.ndarray, z: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """The weight of a voxel in a view; ``turned``: the view's angle less the voxel's. 1 well inside, blended with a partial scan's outside."""
    room = coverage(f, r, z)
    width = f.radius**2 / (2 * f.scan.sid)
    edge = f.scan.sid - np.abs(z) / math.tan(f.gamma) - width
    blend = np.clip((r - edge) / width, -1, 1)
    blend = (1 + np.sin(np.pi / 2 * blend)) / 2
    turned = np.mod(turned + np.pi, 2 * np.pi) - np.pi
    sharp = np.where((turned >= -np.pi / 2) & (turned < np.pi / 2), 2.0, 0.0)
    wide = np.where(room > 1e-7, room, 1.0)
    ramp = lambda t: np.sin(np.pi / 2 * np.clip(t / wide, -1, 1))
    smooth = ramp(turned + np.pi / 2) - ramp(turned - np.pi / 2)
    return np.where(room < 0, 0.0, 1 - blend + blend * np.where(room > 1e-7, smooth, sharp))


def back_project(views: DataFrame, scan: Scan, grid: Grid) -> DataFrame:
    """(voxel_id, value) of filtered parallel views (view, data), any part of the circle."""
    f, spark = fan_of(scan), views.sparkSession
    depth = slab_depth(grid)
    (vx, vy, vz), (ex, ey, ez) = grid.voxel, grid.edge

    def run(batches):
        x, y = (ex + (np.arange(grid.nx) + 0.5) * vx)[None, None, :], (ey + (np.arange(grid.ny) + 0.5) * vy)[None, :, None]
        r, place, part = np.sqrt(x * x + y * y), np.arctan2(-x, y), TaskContext.get().partitionId()
        for batch in batches:
            for s in range(0, batch.num_rows, FRAMES):
                some = batch.slice(s, FRAMES)
                frames = [(v, np.pad(d.values.to_numpy(zero_copy_only=False).reshape(scan.nv, scan.nu), 1).ravel()) for v, d in zip(some.column("view").to_pylist(), some.column("data"), strict=True)]
                for slab, first in enumerate(range(0, grid.nz, depth)):
                    z = (ez + (np.arange(first, min(first + depth, grid.nz)) + 0.5) * vz)[:, None, None]
                    out = np.zeros((len(z), grid.ny, grid.nx))
                    for view, wide in frames:
                        theta = scan.start + view * f.step
                        across, along = x * np.cos(theta) + y * np.sin(theta), y * np.cos(theta) - x * np.sin(theta)
                        length = np.sqrt(np.maximum(scan.sid**2 - across**2, 0)) + along
                        gamma = np.arctan(z / np.where(length > 1e-6, length, 1.0))
                        weight = np.where((length > 1e-6) & (np.abs(gamma) <= f.gamma), ray_weight(f, r, z, theta - place), 0.0)
                        u, v = np.broadcast_arrays((across - f.first) / f.spacing, (gamma + f.gamma) / f.rise)
                        iu, iv = np.floor(u), np.floor(v)
                        ok = (weight > 0) & (iu >= -1) & (iu < scan.nu) & (iv >= -1) & (iv < scan.nv)
                        # A margin of zeros stands for what lies outside.
                        at, fu, fv = np.where(ok, (iv + 1) * (scan.nu + 2) + iu + 1, 0).astype(np.int64), u - iu, v - iv
                        low = at + scan.nu + 2
                        sample = (1 - fv) * ((1 - fu) * wide[at] + fu * wide[at + 1]) + fv * ((1 - fu) * wide[low] + fu * wide[low + 1])
                        out += np.where(ok, weight * sample, 0.0)
                    yield share(slab, part, out * (abs(f.step) / 2))
                part += 1

    shares = views.select("view", "data").mapInArrow(run, SCHEMA)
    return add_shares(shares.unionByName(zero_shares(spark, grid, depth)), depth * grid.nx * grid.ny)


def reconstruct(frames: DataFrame, scan: Scan, grid: Grid, window: str = "ram_lak", cutoff: float = 0.5) -> DataFrame:
    """(voxel_id, value) of the flat frames (view, data) of a full circle."""
    return back_project(filtered(gather_of(scan).run(resampled(frames, scan)), scan, window, cutoff), scan, grid)

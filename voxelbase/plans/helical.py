"""Weighted filtered back-projection of helical scans (Stierstorfer et al. 2004).

Fan views are resampled to parallel ones: a target channel always lies at the same
distance, in views and channels, from four source pixels, so a block of consecutive views
needs its neighbours within a halo of views alone. Rows are filtered by the ramp. Every
view goes to the slabs of voxels that its cone reaches, a number set by pitch and detector
and not by the scan's length; there, views of one phase (half a turn apart) are
averaged with a weight that falls off towards the detector's first and last row,
and phases are added up. Both ways of the bed are taken.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelbase.operators.geometry import Scan
from voxelbase.operators.neighbour import frame_map
from voxelbase.operators.projector import Grid

from .fdk import filter_frames
from .halo import Gather
from .shares import SCHEMA, add_shares, share, slab_depth, zero_shares

#: Target channels for each detector channel, and views left at either end for interpolation besides the fan's.
OVERSAMPLED, MARGIN = 2, 10
#: Phases in a group.
PHASES = 16
#: |q| up to which a ray counts whole.
FLAT = 0.6


@dataclass(frozen=True)
class Parallel:
    """The parallel scan that a helical one is resampled to."""

    scan: Scan
    centre: float  # principal channel of the detector
    row: float  # principal row
    fan: float  # angle between channels on the arc
    channels: int
    spacing: float
    step: float
    half: int  # views in half a turn
    lead: int  # views of the scan before the first target view
    views: int

    @property
    def rise(self) -> float:
        """What the source climbs in a turn; the pitch is the bed's."""
        return -self.scan.pitch

    @property
    def span(self) -> float:
        """Rows on the shorter side of the principal row."""
        return min(self.row, self.scan.nv - 1 - self.row)

    @property
    def cone(self) -> float:
        """Tangent of the half cone angle that both sides of the principal row cover."""
        return self.span * self.scan.dv / self.scan.sdd


def parallel_scan(scan: Scan) -> Parallel:
    turn = scan.per_turn or scan.views
    if scan.direction != 1 or not scan.pitch or turn < 4 or turn % 2:
        raise ValueError("a helical scan needs rising angles, a pitch and an even number of views a turn")
    centre, row = (scan.nu - 1) / 2 - scan.offset[0] / scan.du, (scan.nv - 1) / 2 - scan.offset[2] / scan.dv
    right = scan.nu - 1 - centre
    if not (0 < centre < scan.nu - 1 and 0 < row < scan.nv - 1):
        raise ValueError("the principal ray misses the detector")
    fan = min(math.atan(centre * scan.du / scan.sdd) / centre, math.atan(right * scan.du / scan.sdd) / right)
    step, half = 2 * math.pi / turn, turn // 2
    edge = int(fan * scan.nu * 0.5 / step) + MARGIN
    left = scan.views - 2 * edge
    views = max(0, left // half * half)
    if not views:
        raise ValueError("the scan has too few views for half a turn between its margins")
    return Parallel(scan, centre, row, fan, OVERSAMPLED * scan.nu, scan.sid * fan / OVERSAMPLED, step, half, edge + (left - views) // 2, views)


def _arc(p: Parallel) -> np.ndarray:
    """(nu, nu): a flat row to a row of equal fan angles, linear between channels, 0 off the detector (by more than 1e-6 of a channel)."""
    s, channel = p.scan, np.arange(p.scan.nu)
    at = p.centre + s.sdd * np.tan((channel - p.centre) * p.fan) / s.du
    at = np.where((at > -1e-6) & (at < 0), 0.0, np.where((at > s.nu - 1) & (at < s.nu - 1 + 1e-6), s.nu - 1, at))
    weight = np.maximum(0.0, 1 - np.abs(at[:, None] - channel[None, :]))
    return np.where(((at >= 0) & (at <= s.nu - 1))[:, None], weight, 0.0)


def _corners(p: Parallel) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Four (views after the target, channel, weight), each by target channel."""
    s, target = p.scan, np.arange(p.channels)
    sine = (target - OVERSAMPLED * p.centre) * p.fan / OVERSAMPLED
    channel = np.arcsin(np.clip(sine, -1, 1)) / p.fan + p.centre
    ok = (np.abs(sine) < 1) & (channel >= 0) & (channel <= s.nu - 1)
    first = np.floor(np.where(ok, channel, 0)).astype(int)
    part, out = np.where(ok, channel - first, 0), []
    for k in (0, 1):
        own = np.minimum(first + k, s.nu - 1)
        late = (own - p.centre) * p.fan / p.step
        before = np.floor(late).astype(int)
        for m in (0, 1):
            weight = (part if k else 1 - part) * (late - before if m else 1 - late + before)
            out.append((before + m, own, np.where(ok, weight, 0.0)))
    return out


def parallel_rebin(frames: DataFrame, scan: Scan) -> DataFrame:
    """(view, data) of flat helical frames to parallel views, numbered from 0, of nv rows and ``2 nu`` channels."""
    p = parallel_scan(scan)
    arc = _arc(p)
    on_arc = frame_map(frames, lambda x: (x.reshape(scan.nv, scan.nu) @ arc.T).ravel())
    return Gather(p.views, scan.nv, scan.nu, _corners(p), p.lead).run(on_arc)


def redundancy(q: np.ndarray, flat: float = FLAT) -> np.ndarray:
    """1 up to ``flat``, then a squared cosine down to 0 at 1."""
    q = np.abs(q)
    return np.where(q < flat, 1.0, np.where(q < 1, np.cos(np.pi / 2 * (np.minimum(q, 1) - flat) / (1 - flat)) ** 2, 0.0))


def _samples(frame: np.ndarray, row: np.ndarray, channel: np.ndarray) -> np.ndarray:
    """Bilinear samples, 0 outside."""
    rows, channels = frame.shape
    ok = (row >= 0) & (row <= rows - 1) & (channel >= 0) & (channel <= channels - 1)
    r, c = np.where(ok, row, 0), np.where(ok, channel, 0)
    r0, c0 = np.minimum(r.astype(int), rows - 2), np.minimum(c.astype(int), channels - 2)
    fr, fc, at = r - r0, c - c0, r0 * channels + c0
    flat = frame.ravel()
    top = flat[at] * (1 - fc) + flat[at + 1] * fc
    return np.where(ok, top * (1 - fr) + (flat[at + channels] * (1 - fc) + flat[at + channels + 1] * fc) * fr, 0.0)


def back_project(filtered: DataFrame, scan: Scan, grid: Grid, flat: float = FLAT) -> DataFrame:
    """(voxel_id, value) of filtered parallel views (view, data)."""
    p, spark = parallel_scan(scan), filtered.sparkSession
    (vx, vy, vz), (ex, ey, ez) = grid.voxel, grid.edge
    depth = slab_depth(grid, max(1, math.ceil(abs(p.rise) / vz)))
    x, y = (ex + (np.arange(grid.nx) + 0.5) * vx)[None, :], (ey + (np.arange(grid.ny) + 0.5) * vy)[:, None]
    radius = min(float(np.sqrt((x * x).max() + (y * y).max())), 0.999999 * scan.sid)
    reach = (scan.sid + radius) * p.cone + abs(p.rise) * math.asin(radius / scan.sid) / (2 * math.pi)
    height = lambda view: scan.start_z + p.rise / (2 * p.half) * (p.lead + view)

    def run(key, table):
        slab, group = key[0].as_py(), key[1].as_py()
        z = (ez + (np.arange(slab * depth, min((slab + 1) * depth, grid.nz)) + 0.5) * vz)[:, None, None]
        out = np.zeros((len(z), grid.ny, grid.nx))
        phases: dict[int, list] = {}
        for view, data in zip(table.column("view").to_pylist(), table.column("data"), strict=True):
            phases.setdefault(view % p.half, []).append((view, data))
        for views in phases.values():
            total, weights = np.zeros_like(out), np.zeros_like(out)
            for view, data in views:
                theta = scan.start + (p.lead + view) * p.step
                across, along = x * np.cos(theta) + y * np.sin(theta), y * np.cos(theta) - x * np.sin(theta)
                seen = np.abs(across) < scan.sid
                across = np.where(seen, across, 0.0)
                length = np.sqrt(scan.sid**2 - across**2) + along
                seen &= length > 1e-6
                q = (z - height(view) - p.rise * np.arcsin(across / scan.sid) / (2 * np.pi)) / (np.where(seen, length, 1.0) * p.cone)
                w = np.where(seen, redundancy(q, flat), 0.0)
                if w.any():
                    frame = data.values.to_numpy(zero_copy_only=False).reshape(scan.nv, p.channels)
                    channel = np.broadcast_to(across / p.spacing + OVERSAMPLED * p.centre, q.shape)
                    total += w * np.where(w > 0, _samples(frame, np.where(w > 0, p.row + q * p.span, 0.0), channel), 0.0)
                    weights += w
            out += np.where(weights > 1e-6, total / np.where(weights > 1e-6, weights, 1.0), 0.0)
        out *= np.where(x * x + y * y < scan.sid**2, p.step, 0.0)
        return pa.Table.from_batches([share(slab, group, out)])

    at = F.lit(scan.start_z) + F.lit(p.rise / (2 * p.half)) * (F.col("view") + p.lead)
    begin = F.greatest(F.lit(0), F.ceil((at - reach - (ez + vz / 2)) / vz).cast("long"))
    end = F.least(F.lit(grid.nz - 1), F.floor((at + reach - (ez + vz / 2)) / vz).cast("long"))
    dealt = filtered.select("view", "data").where(begin <= end).withColumn("slab", F.explode(F.sequence(F.floor(begin / depth), F.floor(end / depth))))
    shares = dealt.groupBy("slab", F.floor(F.col("view") % p.half / PHASES).alias("phases")).applyInArrow(run, SCHEMA)
    return add_shares(shares.unionByName(zero_shares(spark, grid, depth)), depth * grid.nx * grid.ny)


def reconstruct(frames: DataFrame, scan: Scan, grid: Grid, window: str = "ram_lak", cutoff: float = 0.5, flat: float = FLAT) -> DataFrame:
    """(voxel_id, value) of flat helical frames (view, data)."""
    p = parallel_scan(scan)
    rows = filter_frames(parallel_rebin(frames, scan), replace(scan, nu=p.channels, du=p.spacing), window, cutoff)
    return back_project(rows, scan, grid, flat)

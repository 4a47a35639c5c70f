"""Maps between detector shapes: every frame sampled at the same places, bilinear, 0 outside."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from voxelbase.operators.geometry import Scan
from voxelbase.operators.neighbour import frame_map


def _places(scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the pixel centres from the detector's middle, (1, nu) and (nv, 1)."""
    return (np.arange(scan.nu) - (scan.nu - 1) / 2)[None, :] * scan.du, (np.arange(scan.nv) - (scan.nv - 1) / 2)[:, None] * scan.dv


def sampler(u: np.ndarray, v: np.ndarray, nu: int, nv: int):
    """A function from a frame's pixels to its samples at pixel places (u, v)."""
    u, v = np.broadcast_arrays(u, v)
    iu, iv = np.floor(u).astype(int), np.floor(v).astype(int)
    parts = []
    for b in (0, 1):
        for a in (0, 1):
            ok = (iu + a >= 0) & (iu + a < nu) & (iv + b >= 0) & (iv + b < nv)
            weight = (u - iu if a else 1 - u + iu) * (v - iv if b else 1 - v + iv)
            parts.append((np.where(ok, (iv + b) * nu + iu + a, 0).ravel(), np.where(ok, weight, 0.0).ravel()))
    return lambda x: sum(x[i] * w for i, w in parts)


def cylinder_to_flat(frames: DataFrame, scan: Scan, radius: float) -> DataFrame:
    """Frames of a cylinder of equal arc steps as a flat detector at the same distance sees them: each flat ray meets the cylinder."""
    x, y = _places(scan)
    back = scan.sdd - radius  # from the source to the cylinder's axis
    q = x * x + scan.sdd**2
    s = (scan.sdd * back + np.sqrt((scan.sdd * back) ** 2 - q * (back * back - radius * radius))) / q
    u = np.arctan2(s * x, s * scan.sdd - back) * radius / scan.du + (scan.nu - 1) / 2
    v = s * y / scan.dv + (scan.nv - 1) / 2
    return frame_map(frames, sampler(u, v, scan.nu, scan.nv))


def flat_to_arc(frames: DataFrame, scan: Scan) -> DataFrame:
    """Flat frames on an arc around the source, of equal angles du / sdd."""
    x, y = _places(scan)
    angle = x / scan.sdd
    u = np.tan(angle) * scan.sdd / scan.du + (scan.nu - 1) / 2
    v = y / np.cos(angle) / scan.dv + (scan.nv - 1) / 2
    return frame_map(frames, sampler(u, v, scan.nu, scan.nv))

"""Filtered back-projection of flat circular scans.

Frames carry their geometry, so weighting, filtering and back-projection are
narrow: a frame filters its own rows (padded FFT in an Arrow task), then emits
its share of every voxel. Only sums by voxel shuffle, combined in each task
before; packets of views can be reconstructed apart and added.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelbase.operators.geometry import Scan, angle_steps
from voxelbase.operators.pointwise import cosine_weight, parker_weight
from voxelbase.operators.projector import Grid

from .shares import SCHEMA, add_shares, share, slab_depth


def spatial_ramp(n: int) -> np.ndarray:
    """The ramp of unit spacing at offsets 0..n-1."""
    k = np.arange(n)
    h = np.zeros(n)
    h[0] = 0.25
    h[1::2] = -1 / (np.pi * k[1::2]) ** 2
    return h


def window_weights(kind: str, f: np.ndarray) -> np.ndarray:
    x = np.clip(f, 0, 1)
    forms = {
        "ram_lak": np.ones_like(x),
        "shepp_logan": np.sinc(x / 2),
        "cosine": np.cos(np.pi * x / 2),
        "hann": 0.5 * (1 + np.cos(np.pi * x)),
        "hamming": 0.54 + 0.46 * np.cos(np.pi * x),
        "blackman": 0.42 + 0.5 * np.cos(np.pi * x) + 0.08 * np.cos(2 * np.pi * x),
        "butterworth": 1 / (1 + x**4),
        "kaiser": np.i0(5.0 * np.sqrt(np.maximum(1 - (2 * x - 1) ** 2, 0))) / np.i0(5.0),
        "tukey": np.where(x < 0.25, 0.5 * (1 + np.cos(np.pi * (4 * x - 1))), np.where(x > 0.75, 0.5 * (1 + np.cos(np.pi * (4 * x - 3))), 1.0)),
    }
    return np.where(f <= 1, forms[kind], 0.0)


def ramp_gain(nu: int, window: str = "ram_lak", cutoff: float = 0.5) -> tuple[int, np.ndarray]:
    """The padded length of rows of ``nu`` samples and the windowed ramp's gains, for unit spacing."""
    size = 1 << (2 * nu - 1).bit_length()
    kernel = np.zeros(size)
    kernel[:nu] = spatial_ramp(nu)
    kernel[size - nu + 1 :] = kernel[1:nu][::-1]
    return size, np.fft.rfft(kernel).real * window_weights(window, np.fft.rfftfreq(size) / cutoff)


def filter_frames(frames: DataFrame, scan: Scan, window: str = "ram_lak", cutoff: float = 0.5) -> DataFrame:
    """(view, data) with rows of nu values each, one after another: every row filtered by the ramp."""
    nu = scan.nu

    def run(batches):
        size, gain = ramp_gain(nu, window, cutoff)
        gain = gain / scan.du
        for b in batches:
            out = []
            for data in b.column("data"):
                rows = data.values.to_numpy().reshape(-1, nu)
                out.append(np.fft.irfft(np.fft.rfft(rows, size, axis=1) * gain, size, axis=1)[:, :nu].ravel())
            yield pa.RecordBatch.from_arrays([b.column("view"), pa.array(out, pa.list_(pa.float64()))], names=["view", "data"])

    return frames.select("view", "data").mapInArrow(run, "view long, data array<double>")


def preweight(pixels: DataFrame, scan: Scan) -> DataFrame:
    """(view, v, u, value) with the cosine weight and SDD / (2 SOD)."""
    w = cosine_weight(F.col("u"), F.col("v"), scan.nu, scan.nv, scan.du, scan.dv, scan.sid, scan.sdd)
    return pixels.select("view", "v", "u", (F.col("value") * w).alias("value"))


def to_frames(pixels: DataFrame, scan: Scan) -> DataFrame:
    """(view, data): a frame's pixels in row-major order."""
    order = F.array_sort(F.collect_list(F.struct((F.col("v") * scan.nu + F.col("u")).alias("i"), "value")))
    return pixels.groupBy("view").agg(order.alias("p")).select("view", F.col("p.value").alias("data"))


#: Frames that a task sums before it gives off its share of a slab.
FRAMES = 32
#: What a voxel-driven back-projection multiplies its samples by.
WEIGHTS = ("fdk", "radial", "none", "matched")


def back_project(frames: DataFrame, geometry: DataFrame, scan: Scan, grid: Grid, weight: str = "fdk", nearest: bool = False) -> DataFrame:
    """(voxel_id, value): sums over views of weighted samples of (view, data) where each voxel's ray meets the flat detector.

    ``fdk``: SOD^2 * step / depth^2 with the depth along the detector's normal; ``radial``:
    the same along each view's ray to the grid's centre, SOD being its length; ``none``: plain sums; ``matched``: L^3 / (plane distance * l^2) * du * dv with L from source to
    detector point and l from source to voxel, nearly the transpose of ray sums.
    A task projects a slab of voxels for all its frames at once and gives off its share
    of each slab; shares are added slab by slab, in two levels.
    """
    names = ("src", "det_s", "det_u", "det_v")
    flat = [F.col(f"{n}.{a}").alias(f"{n}_{a}") for n in names for a in "xyz"]
    rows = frames.join(geometry.join(angle_steps(geometry), "view"), "view").select("data", "step", *flat)
    depth = slab_depth(grid)
    sid, nu, nv, pixel = scan.sid, scan.nu, scan.nv, scan.du * scan.dv
    (vx, vy, vz), (ex, ey, ez) = grid.voxel, grid.edge

    def one(x, y, z, g, data, step, out):
        src, det_s, det_u, det_v = (np.array(g[3 * i : 3 * i + 3]) for i in range(4))
        n, d = np.cross(det_u, det_v), det_s - src
        det = n @ d
        qx, qy, qz = x - src[0], y - src[1], z - src[2]
        dot = lambda a: (a[0] * qx + a[1] * qy) + a[2] * qz
        w = dot(n) / det  # 1 on the detector's plane
        u, v = dot(np.cross(det_v, d)) / det / w, dot(np.cross(d, det_u)) / det / w
        if nearest:
            u, v = np.floor(u + 0.5), np.floor(v + 0.5)
        iu, iv = np.floor(u), np.floor(v)
        fu, fv = u - iu, v - iv
        ok = (iu >= -1) & (iu < nu) & (iv >= -1) & (iv < nv)
        # A margin of zeros stands for what lies outside.
        wide = np.zeros((nv + 2, nu + 2))
        wide[1 : nv + 1, 1 : nu + 1] = data
        wide = wide.ravel()
        at = np.where(ok, (iv + 1) * (nu + 2) + iu + 1, 0).astype(np.int64)
        if nearest:
            sample = wide[at]
        else:
            top, low = wide[at], wide[np.minimum(at + nu + 2, len(wide) - 1)]
            sample = (1 - fv) * (top + fu * (wide[np.minimum(at + 1, len(wide) - 1)] - top)) + fv * (low + fu * (wide[np.minimum(at + nu + 3, len(wide) - 1)] - low))
        if weight == "fdk":
            sample = sample * (sid * sid * step) / (w * (abs(det) / np.linalg.norm(n))) ** 2
        elif weight == "radial":
            ray = np.array(grid.centre) - src
            sample = sample * (ray @ ray) ** 2 * step / dot(ray) ** 2
        elif weight == "matched":
            near2 = qx * qx + qy * qy + qz * qz
            sample = sample * (np.sqrt(near2) / w) ** 3 / (abs(det) / np.linalg.norm(n) * near2) / pixel * (vx * vy * vz)
        out += np.where(ok, sample, 0.0)

    def run(batches):
        x = (ex + (np.arange(grid.nx) + 0.5) * vx)[None, None, :]
        y = (ey + (np.arange(grid.ny) + 0.5) * vy)[None, :, None]
        packet = TaskContext.get().partitionId()
        for batch in batches:
            for s in range(0, batch.num_rows, FRAMES):
                part = batch.slice(s, FRAMES)
                data = [r.values.to_numpy(zero_copy_only=False).reshape(nv, nu) for r in part.column("data")]
                places = list(zip(*(part.column(f.name).to_pylist() for f in part.schema if f.name not in ("data", "step")), strict=True))
                for slab, first in enumerate(range(0, grid.nz, depth)):
                    z = (ez + (np.arange(first, min(first + depth, grid.nz)) + 0.5) * vz)[:, None, None]
                    out = np.zeros((len(z), grid.ny, grid.nx))
                    for g, p, step in zip(places, data, part.column("step").to_pylist(), strict=True):
                        one(x, y, z, g, p, step, out)
                    yield share(slab, packet, out)
                packet += 1

    return add_shares(rows.mapInArrow(run, SCHEMA), depth * grid.nx * grid.ny)


def short_scan(scan: Scan) -> bool:
    """Whether the views cover less than a turn, within half a view."""
    return scan.views < (scan.per_turn or scan.views) - 0.5


def short_scan_weight(pixels: DataFrame, geometry: DataFrame, scan: Scan) -> DataFrame:
    """(view, v, u, value) times the short scan's redundancy weight, and the turn's share that the back-projection leaves out."""
    gamma = F.atan((F.col("u") - (scan.nu - 1) / 2) * scan.du / scan.sdd) * scan.direction
    fan = math.atan((scan.nu - 1) / 2 * scan.du / scan.sdd)
    covered = scan.views * 2 * math.pi / scan.per_turn
    rows = pixels.join(geometry.select("view", (F.abs(F.col("angle") - F.lit(scan.start))).alias("beta")), "view")
    return rows.select("view", "v", "u", (F.col("value") * parker_weight(F.col("beta"), gamma, fan, covered) * (2 * math.pi / covered)).alias("value"))


def reconstruct(pixels: DataFrame, geometry: DataFrame, scan: Scan, grid: Grid, window: str = "ram_lak") -> DataFrame:
    """FDK of (view, v, u, value): weight, filter, back-project. A full turn counts each ray twice; the weight holds the half, and short scans get theirs."""
    rows = preweight(pixels, scan)
    rows = short_scan_weight(rows, geometry, scan) if short_scan(scan) else rows
    return back_project(filter_frames(to_frames(rows, scan), scan, window), geometry, scan, grid)

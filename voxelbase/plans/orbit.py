"""FDK of scans that are no plain circles: sources on their own orbit over a still detector, tilted axes.

Every view has its own frame. Its reference ray runs from the source to the middle of the
volume; ray cosines and depths are counted along it. Where the detector stands still, a
window of each frame is resampled first, by the homography between the window's pixels
and the detector's, so that its rows run along the source's path: turned in the
detector's plane, or on a plane square to the reference ray.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelbase.functions.scalar import cross, dot, minus, norm, vec
from voxelbase.functions.scratch import settle
from voxelbase.operators.geometry import Scan, projection_matrix
from voxelbase.operators.projector import Grid
from voxelbase.operators.rebin import sampler

from .fdk import back_project, ramp_gain
from .halo import SCHEMA


def _at(centre: tuple[float, float, float]) -> Column:
    return vec(*(F.lit(float(x)) for x in centre))


VECTOR = "struct<x: double, y: double, z: double>"


def _each(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, as a column."""
    return (a * b).sum(axis=1, keepdims=True)


def _unit(a: np.ndarray) -> np.ndarray:
    return a / np.sqrt(_each(a, a))


def _moved(direction: np.ndarray, ray: np.ndarray, normal: np.ndarray, det_u: np.ndarray, det_v: np.ndarray) -> np.ndarray:
    """Detector pixels by which a millimetre of ``direction`` moves the point where ``ray`` meets the detector."""
    along = direction - ray * (_each(direction, normal) / _each(ray, normal))
    uu, vv, uv, x, y = _each(det_u, det_u), _each(det_v, det_v), _each(det_u, det_v), _each(along, det_u), _each(along, det_v)
    return np.hypot(x * vv - y * uv, y * uu - x * uv) / (uu * vv - uv * uv)


def windows(geometry: DataFrame, width: int, height: int, mode: str = "rotated", centre: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(view, angle, src, det_s, det_u, det_v, h) of windows (origin_u, origin_v of each row) of a still flat detector.

    ``rotated``: turned in the detector's plane by the angle since the first view, about the window's middle.
    ``radial``: on the plane square to the ray to ``centre`` that meets the detector where that ray does, with steps
    that cover the detector's pixels one by one in the middle. ``h`` (9 numbers, row by row) takes a window's pixel
    (u, v, 1) to the detector's.
    """
    if mode not in ("rotated", "radial"):
        raise ValueError("windows are rotated or radial")
    first = geometry.select(F.min_by("angle", "view").alias("first"))
    rows = geometry.join(F.broadcast(first)).join(projection_matrix(geometry), "view")  # first: one row
    flat = [F.col(f"{c}.{x}").alias(f"{c}_{x}") for c in ("src", "det_s", "det_u", "det_v") for x in "xyz"]
    names = [f"{c}_{x}" for c in ("src", "det_s", "det_u", "det_v") for x in "xyz"]

    def run(batches):
        for b in batches:
            src, det_s, det_u, det_v = np.moveaxis(np.stack([b.column(c).to_numpy() for c in names], axis=1).reshape(-1, 4, 3), 1, 0)
            turn, left, top = ((b.column(c).to_numpy())[:, None] for c in ("turn", "origin_u", "origin_v"))
            du, dv = np.sqrt(_each(det_u, det_u)), np.sqrt(_each(det_v, det_v))
            u = det_u / du * np.cos(turn) + det_v / dv * np.sin(turn)
            v = det_v / dv * np.cos(turn) - det_u / du * np.sin(turn)
            if mode == "rotated":
                middle = det_s + det_u * (left + (width - 1) / 2) + det_v * (top + (height - 1) / 2)
                step_u, step_v = u * du, v * dv
            else:
                normal, ray = _unit(np.cross(det_u, det_v)), _unit(np.array(centre) - src)
                middle = src + ray * (_each(det_s - src, normal) / _each(ray, normal))
                u = _unit(u - ray * _each(u, ray))
                w = _unit(np.cross(u, ray))
                v = w * np.where(_each(w, v) < 0, -1.0, 1.0)
                step_u, step_v = (x / _moved(x, ray, normal, det_u, det_v) for x in (u, v))
            corner = middle - step_u * ((width - 1) / 2) - step_v * ((height - 1) / 2)
            p = b.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 4)
            h = np.stack([np.einsum("nij,nj->ni", p[:, :, :3], x) for x in (step_u, step_v, corner)], axis=2)
            h[:, :, 2] += p[:, :, 3]
            vectors = [pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x[:, i])) for i in range(3)], names=list("xyz")) for x in (src, corner, step_u, step_v)]
            yield pa.RecordBatch.from_arrays([b.column("view"), b.column("angle"), *vectors, pa.array(list(h.reshape(-1, 9)), pa.list_(pa.float64()))], names=["view", "angle", "src", "det_s", "det_u", "det_v", "h"])

    taken = rows.select(F.col("view").cast("long").alias("view"), "angle", (F.col("angle") - F.col("first")).alias("turn"), F.col("origin_u").cast("double").alias("origin_u"), F.col("origin_v").cast("double").alias("origin_v"), "p", *flat)
    return taken.mapInArrow(run, f"view long, angle double, src {VECTOR}, det_s {VECTOR}, det_u {VECTOR}, det_v {VECTOR}, h array<double>")


def check_windows(rows: DataFrame, width: int, height: int, nu: int, nv: int) -> DataFrame:
    """``rows`` of ``windows``; a window with a corner off the detector stops the query."""
    off = F.lit(False)
    h = F.col("h")
    for u in (0, width - 1):
        for v in (0, height - 1):
            x, y, w = (h[3 * i] * u + h[3 * i + 1] * v + h[3 * i + 2] for i in range(3))
            off = off | ~((x / w).between(-1e-4, nu - 1 + 1e-4) & (y / w).between(-1e-4, nv - 1 + 1e-4))
    fault = F.when(off, F.raise_error(F.concat(F.lit("window leaves the detector in view "), F.col("view").cast("string"))))
    return rows.where(fault.cast("string").isNull())


def resample(frames: DataFrame, maps: DataFrame, nu: int, nv: int, width: int, height: int) -> DataFrame:
    """(view, data): frames of nv rows of nu pixels at the places ``maps`` (view, h) names, bilinear, 0 outside and where the map has no value."""
    u, v = np.meshgrid(np.arange(width), np.arange(height))
    places = np.stack([u.ravel(), v.ravel(), np.ones(u.size)])

    def run(batches):
        for b in batches:
            out = []
            for data, h in zip(b.column("data"), b.column("h"), strict=True):
                x, y, w = h.values.to_numpy(zero_copy_only=False).reshape(3, 3) @ places
                there = np.abs(w) >= 1e-12
                w = np.where(there, w, 1.0)
                sample = sampler(np.where(there, x / w, -9.0), np.where(there, y / w, -9.0), nu, nv)
                out.append(sample(data.values.to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([b.column("view"), pa.array(out, pa.list_(pa.float64()))], names=["view", "data"])

    return frames.join(maps.select("view", "h"), "view").select(F.col("view").cast("long").alias("view"), "data", "h").mapInArrow(run, SCHEMA)


def filtered(frames: DataFrame, geometry: DataFrame, nu: int, nv: int, centre=(0.0, 0.0, 0.0), window: str = "ram_lak", cutoff: float = 0.5) -> DataFrame:
    """(view, data): rays weighted by D / length * D / 2 S with D and S the ways along the reference ray to the detector and ``centre``, rows filtered by each view's own pixel step."""
    normal = cross(F.col("det_u"), F.col("det_v"))
    ray = minus(_at(centre), F.col("src"))
    far = dot(minus(F.col("det_s"), F.col("src")), normal) / dot(ray, normal)  # 1 at the centre
    geo = geometry.select("view", (far * norm(ray)).alias("D"), norm(ray).alias("S"), *(F.col(f"{c}.{a}").alias(f"{c}_{a}") for c in ("src", "det_s", "det_u", "det_v") for a in "xyz"))
    names = [c for c in geo.columns if c not in ("view", "D", "S")]

    def run(batches):
        u, v = np.arange(nu)[None, :, None], np.arange(nv)[:, None, None]
        size, gain = ramp_gain(nu, window, cutoff)
        for b in batches:
            out, vectors = [], np.stack([b.column(c).to_numpy() for c in names], axis=1).reshape(-1, 4, 3)
            for data, far, near, (src, det_s, det_u, det_v) in zip(b.column("data"), b.column("D").to_pylist(), b.column("S").to_pylist(), vectors, strict=True):
                length = np.linalg.norm(det_s + u * det_u + v * det_v - src, axis=2)
                rows = data.values.to_numpy(zero_copy_only=False).reshape(nv, nu) * far / length * far / (2 * near)
                out.append((np.fft.irfft(np.fft.rfft(rows, size, axis=1) * gain, size, axis=1)[:, :nu] / np.linalg.norm(det_u)).ravel())
            yield pa.RecordBatch.from_arrays([b.column("view"), pa.array(out, pa.list_(pa.float64()))], names=["view", "data"])

    return frames.join(geo, "view").select(F.col("view").cast("long").alias("view"), "data", "D", "S", *names).mapInArrow(run, SCHEMA)


def reconstruct(frames: DataFrame, geometry: DataFrame, scan: Scan, grid: Grid, window: str = "ram_lak", covered: float = 2 * math.pi) -> DataFrame:
    """(voxel_id, value) of frames (view, data) whose geometry is ``geometry``, scan.nu by scan.nv pixels; ``covered``: the angle that the views span."""
    ready = filtered(frames, geometry, scan.nu, scan.nv, grid.centre, window)
    rows = back_project(ready, geometry, scan, grid, "radial")
    return rows.select("voxel_id", (F.col("value") * (2 * math.pi / covered)).alias("value"))


def source_orbit(frames: DataFrame, geometry: DataFrame, raw: Scan, window: Scan, grid: Grid, mode: str = "rotated", kind: str = "ram_lak") -> DataFrame:
    """(voxel_id, value) of a still detector's frames; ``geometry`` has origin_u and origin_v, ``window`` the windows' nu and nv."""
    # A row a view, read three times: once computed is enough.
    maps = settle(check_windows(windows(settle(geometry), window.nu, window.nv, mode, grid.centre), window.nu, window.nv, raw.nu, raw.nv))
    return reconstruct(resample(frames, maps, raw.nu, raw.nv, window.nu, window.nv), maps, window, grid, kind)

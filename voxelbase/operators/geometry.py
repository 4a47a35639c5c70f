"""Scan geometries as tables: one row per view with source, detector origin and pixel steps.

At angle 0 the source is at (0, -sid, z), the detector's centre at
(0, sdd - sid, z), u points along +x and v along +z; views turn about z. Pixel
(u, v) of a flat detector lies at det_s + u det_u + v det_v.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelbase.functions.scalar import cross, dot, minus, norm, plus, rodrigues, rotate_z, scaled, vec


@dataclass(frozen=True)
class Scan:
    views: int
    nu: int
    nv: int
    du: float
    dv: float
    sid: float
    sdd: float
    per_turn: int | None = None
    start: float = 0.0
    direction: int = 1
    pitch: float = 0.0
    start_z: float = 0.0
    offset: tuple[float, float, float] = (0.0, 0.0, 0.0)  # u, n, v
    tilt: tuple[float, float, float] = (0.0, 0.0, 0.0)  # about u, then v, then n


def _v(x: float, y: float, z: float) -> Column:
    return vec(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))


def angles(spark: SparkSession, scan: Scan) -> DataFrame:
    """(view, angle): regular angles."""
    step = scan.direction * 2 * math.pi / (scan.per_turn or scan.views)
    return spark.range(scan.views).select(F.col("id").alias("view"), (F.lit(scan.start) + F.col("id") * step).alias("angle"))


def trajectory(spark: SparkSession, scan: Scan) -> DataFrame:
    """(view, angle, src): circular, or helical where the pitch is a bed feed, so the source moves against it."""
    rise = -scan.pitch / (scan.per_turn or scan.views)
    z = F.lit(scan.start_z) + F.col("view") * rise
    src = plus(rotate_z(_v(0, -scan.sid, 0), F.col("angle")), vec(F.lit(0.0), F.lit(0.0), z))
    return angles(spark, scan).select("view", "angle", src.alias("src"))


def scanner_frames(spark: SparkSession, scan: Scan) -> DataFrame:
    """(view, angle, src, centre, u, v, n): the detector's principal point and axes; n looks at the source."""
    turn = lambda x, y: rotate_z(_v(x, y, 0), F.col("angle"))
    rows = trajectory(spark, scan)
    centre = plus(turn(0, scan.sdd - scan.sid), vec(F.lit(0.0), F.lit(0.0), F.col("src.z")))
    return rows.select("view", "angle", "src", centre.alias("centre"), turn(1, 0).alias("u"), _v(0, 0, 1).alias("v"), turn(0, -1).alias("n"))


def _tilted(frames: DataFrame, scan: Scan) -> DataFrame:
    a, b, c = scan.tilt
    if a:
        frames = frames.withColumns({"v": rodrigues(F.col("v"), F.col("u"), F.lit(a)), "n": rodrigues(F.col("n"), F.col("u"), F.lit(a))})
    if b:
        frames = frames.withColumns({"u": rodrigues(F.col("u"), F.col("v"), F.lit(b)), "n": rodrigues(F.col("n"), F.col("v"), F.lit(b))})
    if c:
        frames = frames.withColumns({"u": rodrigues(F.col("u"), F.col("n"), F.lit(c)), "v": rodrigues(F.col("v"), F.col("n"), F.lit(c))})
    return frames


def flat_detector(frames: DataFrame, scan: Scan) -> DataFrame:
    """(view, angle, src, det_s, det_u, det_v) of a flat detector with offsets and tilts."""
    ou, on, ov = scan.offset
    c = plus(plus(plus(F.col("centre"), scaled(F.col("u"), F.lit(ou))), scaled(F.col("n"), F.lit(on))), scaled(F.col("v"), F.lit(ov)))
    frames = _tilted(frames.withColumn("centre", c), scan)
    u, v = scaled(F.col("u"), F.lit(scan.du)), scaled(F.col("v"), F.lit(scan.dv))
    origin = minus(minus(F.col("centre"), scaled(u, F.lit((scan.nu - 1) / 2))), scaled(v, F.lit((scan.nv - 1) / 2)))
    return frames.select("view", "angle", "src", origin.alias("det_s"), u.alias("det_u"), v.alias("det_v"))


def flat_geometry(spark: SparkSession, scan: Scan) -> DataFrame:
    return flat_detector(scanner_frames(spark, scan), scan)


def cylindrical_pixels(frames: DataFrame, scan: Scan, radius: float) -> DataFrame:
    """(view, u, v, src, dst): pixel centres of a cylindrical detector of equal arc steps."""
    u = F.explode(F.sequence(F.lit(0), F.lit(scan.nu - 1)))
    v = F.explode(F.sequence(F.lit(0), F.lit(scan.nv - 1)))
    rows = frames.withColumn("iu", u).withColumn("iv", v)
    phi = (F.col("iu") - (scan.nu - 1) / 2) * scan.du / radius
    axis = minus(F.col("centre"), scaled(F.col("n"), F.lit(-radius)))  # the cylinder's axis lies on the source's side
    arc = plus(scaled(F.col("n"), -radius * F.cos(phi)), scaled(F.col("u"), radius * F.sin(phi)))
    dst = plus(plus(axis, arc), scaled(F.col("v"), (F.col("iv") - (scan.nv - 1) / 2) * scan.dv))
    return rows.select("view", F.col("iu").alias("u"), F.col("iv").alias("v"), "src", dst.alias("dst"))


def source_orbit(spark: SparkSession, scan: Scan, radius: float, height: float) -> DataFrame:
    """A source on a circle of its own above a fixed detector."""
    rows = angles(spark, scan)
    src = vec(radius * F.cos("angle"), radius * F.sin("angle"), F.lit(height))
    fixed = rows.select("view", "angle", src.alias("src"), _v(0, 0, -(scan.sdd - scan.sid)).alias("centre"), _v(1, 0, 0).alias("u"), _v(0, 1, 0).alias("v"), _v(0, 0, 1).alias("n"))
    return flat_detector(fixed, scan)


def tilted_axis(spark: SparkSession, scan: Scan, tilt: float) -> DataFrame:
    """The circular scan turned about x by ``tilt``: an inclined rotation axis."""
    turn = lambda c: rodrigues(F.col(c), _v(1, 0, 0), F.lit(tilt))
    return flat_geometry(spark, scan).select("view", "angle", *(turn(c).alias(c) for c in ("src", "det_s", "det_u", "det_v")))


def rigid(geometry: DataFrame, rows: list[list[float]], shift: tuple[float, float, float]) -> DataFrame:
    """Points get the whole transform, directions its rotation only."""
    r = [_v(*x) for x in rows]
    turn = lambda c: vec(*(dot(x, F.col(c)) for x in r))
    return geometry.select("view", "angle", *((plus(turn(c), _v(*shift)) if c in ("src", "det_s") else turn(c)).alias(c) for c in ("src", "det_s", "det_u", "det_v")))


def angle_steps(geometry: DataFrame) -> DataFrame:
    """(view, step): half the distance of the neighbours' angles, the whole distance at the ends.

    Angles count per scan, a bounded table, so one window over it is fine.
    """
    w = Window.orderBy("view")
    before, after = F.lag("angle").over(w), F.lead("angle").over(w)
    step = F.coalesce((after - before) / 2, after - F.col("angle"), F.col("angle") - before, F.lit(2 * math.pi))
    return geometry.select("view", F.greatest(F.abs(step), F.lit(1e-12)).alias("step"))


def projection_matrix(geometry: DataFrame) -> DataFrame:
    """(view, p: 12 doubles): the 3 x 4 matrix with q ~ P X, q = (u, v, 1), from source and pixel steps."""
    n = cross(F.col("det_u"), F.col("det_v"))
    d = minus(F.col("det_s"), F.col("src"))
    # X = src + w (d + u det_u + v det_v); rows of the inverse of [det_u det_v d].
    det = dot(n, d)
    a, b, c = (scaled(x, 1 / det) for x in (cross(F.col("det_v"), d), cross(d, F.col("det_u")), n))
    row = lambda x: [x["x"], x["y"], x["z"], -dot(x, F.col("src"))]
    return geometry.select("view", F.array(*row(a), *row(b), *row(c)).alias("p"))


def from_projection_matrix(matrices: DataFrame) -> DataFrame:
    """(view, src, det_s, det_u, det_v) of (view, p: 12 doubles): the inverse of p's left 3 x 3 part, in any scale of p."""

    def run(batches):
        for b in batches:
            p = b.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 4)
            inverse = np.linalg.inv(p[:, :, :3])
            src = -(inverse @ p[:, :, 3:])[:, :, 0]
            vectors = [src, src + inverse[:, :, 2], inverse[:, :, 0], inverse[:, :, 1]]
            cols = [pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v[:, i])) for i in range(3)], names=list("xyz")) for v in vectors]
            yield pa.RecordBatch.from_arrays([b.column("view"), *cols], names=["view", "src", "det_s", "det_u", "det_v"])

    vector = "struct<x: double, y: double, z: double>"
    return matrices.select("view", "p").mapInArrow(run, f"view long, src {vector}, det_s {vector}, det_u {vector}, det_v {vector}")


def project(p: Column, x: Column) -> tuple[Column, Column]:
    at = lambda i: p[4 * i] * x["x"] + p[4 * i + 1] * x["y"] + p[4 * i + 2] * x["z"] + p[4 * i + 3]
    return at(0) / at(2), at(1) / at(2)


def unwrap(rows: DataFrame, order: str, angle: str, out: str = "unwrapped") -> DataFrame:
    """Angles without jumps of a turn, along ``order`` (a bounded table of views)."""
    w = Window.orderBy(order)
    jump = F.col(angle) - F.lag(angle).over(w)
    turns = F.coalesce(-F.floor((jump + math.pi) / (2 * math.pi)), F.lit(0))
    return rows.withColumn("__turn", turns).withColumn(out, F.col(angle) + 2 * math.pi * F.sum("__turn").over(w)).drop("__turn")


def check_frames(rows: DataFrame) -> DataFrame:
    """External frames (src, centre, u, v): u orthogonal to v, source off the plane; else the query stops."""
    skew = F.abs(dot(F.col("u"), F.col("v"))) > 1e-5 * norm(F.col("u")) * norm(F.col("v"))
    flat = F.abs(dot(cross(F.col("u"), F.col("v")), minus(F.col("centre"), F.col("src")))) < 1e-9
    fault = F.when(skew, F.raise_error(F.lit("detector axes are not orthogonal"))).when(flat, F.raise_error(F.lit("source lies in the detector's plane")))
    return rows.where(fault.cast("string").isNull())

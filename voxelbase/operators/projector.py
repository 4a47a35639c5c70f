"""Discrete projectors as sparse matrices: (ray_id, voxel_id, weight) tables.

Forward projection joins the matrix with a volume and sums by ray, back
projection joins it with a projection and sums by voxel, so the two are exact
transposes of each other. A ray's weights come from array functions in its own
row: building the matrix needs no shuffle, and either product shuffles once to
join and once for sums that are combined before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelbase.functions.scalar import minus, norm, plus, scaled
from voxelbase.operators.geometry import Scan


@dataclass(frozen=True)
class Grid:
    nx: int
    ny: int
    nz: int
    voxel: tuple[float, float, float] = (1.0, 1.0, 1.0)
    centre: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.nx, self.ny, self.nz

    @property
    def edge(self) -> tuple[float, ...]:
        """The outer corner with the smallest coordinates."""
        return tuple(c - n * s / 2 for c, n, s in zip(self.centre, self.shape, self.voxel, strict=True))

    def voxels(self, spark) -> DataFrame:
        """(voxel_id, x, y, z indices)."""
        i = F.col("id")
        return spark.range(self.nx * self.ny * self.nz).select(i.alias("voxel_id"), (i % self.nx).alias("ix"), (F.floor(i / self.nx) % self.ny).alias("iy"), F.floor(i / (self.nx * self.ny)).alias("iz"))


def rays(geometry: DataFrame, scan: Scan) -> DataFrame:
    """(ray_id, view, v, u, src, dst) of a flat detector; ray_id = (view * nv + v) * nu + u."""
    rows = geometry.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(scan.nv - 1)))).withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(scan.nu - 1))))
    dst = plus(plus(F.col("det_s"), scaled(F.col("det_u"), F.col("u"))), scaled(F.col("det_v"), F.col("v")))
    return rows.select(((F.col("view") * scan.nv + F.col("v")) * scan.nu + F.col("u")).alias("ray_id"), "view", "v", "u", "src", dst.alias("dst"))


def _interval(r: DataFrame, grid: Grid) -> DataFrame:
    """Adds d, len and the part [t0, t1] of source to pixel that lies in the grid."""
    r = r.withColumn("d", minus(F.col("dst"), F.col("src"))).withColumn("len", norm(F.col("d")))
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    for a, n, s, e in zip("xyz", grid.shape, grid.voxel, grid.edge, strict=True):
        d, p = F.col(f"d.{a}"), F.col(f"src.{a}")
        t, w = (e - p) / d, (e + n * s - p) / d
        still = F.abs(d) < 1e-8
        inside = (p >= e) & (p < e + n * s)
        low.append(F.when(still, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(t, w)))
        high.append(F.when(still, 1.0).otherwise(F.greatest(t, w)))
    return r.withColumns({"t0": F.greatest(*low), "t1": F.least(*high)}).where("t1 > t0")


def siddon(r: DataFrame, grid: Grid) -> DataFrame:
    """Exact lengths of each ray in each voxel it crosses, source to pixel."""
    r = _interval(r, grid)
    cuts = [F.array("t0", "t1")]
    for a, n, s, e in zip("xyz", grid.shape, grid.voxel, grid.edge, strict=True):
        planes = _planes(a, n, s, e)
        cuts.append(F.when(F.abs(F.col(f"d.{a}")) < 1e-8, F.array().cast("array<double>")).otherwise(F.filter(planes, lambda t: (t > F.col("t0")) & (t < F.col("t1")))))
    r = r.withColumn("t", F.array_sort(F.array_distinct(F.concat(*cuts))))
    r = r.select("ray_id", "src", "d", "len", F.explode(F.arrays_zip(F.slice("t", F.lit(1), F.size("t") - 1).alias("a"), F.slice("t", F.lit(2), F.size("t") - 1).alias("b"))).alias("s"))
    mid = (F.col("s.a") + F.col("s.b")) / 2
    index = [F.least(F.greatest(F.floor((F.col(f"src.{a}") + mid * F.col(f"d.{a}") - e) / s), F.lit(0)), F.lit(n - 1)) for a, n, s, e in zip("xyz", grid.shape, grid.voxel, grid.edge, strict=True)]
    return r.select("ray_id", ((index[2] * grid.ny + index[1]) * grid.nx + index[0]).cast("long").alias("voxel_id"), ((F.col("s.b") - F.col("s.a")) * F.col("len")).alias("weight"))


def _planes(axis: str, n: int, s: float, e: float) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: (F.lit(e) + k * F.lit(s) - F.col(f"src.{axis}")) / F.col(f"d.{axis}"))


def joseph(r: DataFrame, grid: Grid) -> DataFrame:
    """Steps through slices of the ray's main axis, linear in the two others; voxels outside count as 0."""
    r = r.withColumn("d", minus(F.col("dst"), F.col("src"))).withColumn("len", norm(F.col("d")))
    size = {a: F.abs(F.col(f"d.{a}")) for a in "xyz"}
    main = F.when((size["x"] >= size["y"]) & (size["x"] >= size["z"]), 0).when(size["y"] >= size["z"], 1).otherwise(2)
    r = r.withColumn("main", main)
    out = None
    axes = list(zip("xyz", grid.shape, grid.voxel, grid.edge, strict=True))
    for m, (a, n, s, e) in enumerate(axes):
        part = r.where(F.col("main") == m).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        t = (F.lit(e + s / 2) + F.col("k") * s - F.col(f"src.{a}")) / F.col(f"d.{a}")
        part = part.withColumn("t", t).where("t between 0 and 1").withColumn("step", F.col("len") / F.abs(F.col(f"d.{a}")) * s)
        (b, nb, sb, eb), (c, nc, sc, ec) = (x for i, x in enumerate(axes) if i != m)
        place = lambda x, sx, ex: (F.col(f"src.{x}") + F.col("t") * F.col(f"d.{x}") - ex) / sx - 0.5
        part = part.withColumns({"pb": place(b, sb, eb), "pc": place(c, sc, ec)})
        part = part.withColumns({"ib": F.floor("pb"), "ic": F.floor("pc")}).withColumns({"fb": F.col("pb") - F.col("ib"), "fc": F.col("pc") - F.col("ic")})
        corners = F.array(*(F.struct((F.col("ib") + i).alias("b"), (F.col("ic") + j).alias("c"), ((F.col("fb") if i else 1 - F.col("fb")) * (F.col("fc") if j else 1 - F.col("fc"))).alias("w")) for i in (0, 1) for j in (0, 1)))
        part = part.select("ray_id", "k", "step", F.explode(corners).alias("q")).where(f"q.b between 0 and {nb - 1} and q.c between 0 and {nc - 1} and q.w > 0")
        at = {a: F.col("k"), b: F.col("q.b"), c: F.col("q.c")}
        part = part.select("ray_id", ((at["z"] * grid.ny + at["y"]) * grid.nx + at["x"]).cast("long").alias("voxel_id"), (F.col("q.w") * F.col("step")).alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out


def forward(matrix: DataFrame, volume: DataFrame) -> DataFrame:
    """(ray_id, value): A x."""
    return matrix.join(volume, "voxel_id").groupBy("ray_id").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def back(matrix: DataFrame, projection: DataFrame) -> DataFrame:
    """(voxel_id, value): the transpose of A times b."""
    return matrix.join(projection, "ray_id").groupBy("voxel_id").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def row_sums(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("ray_id").agg(F.sum("weight").alias("total"))


def column_sums(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("voxel_id").agg(F.sum("weight").alias("total"))


def material_paths(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """(ray_id, label, path in cm) of voxels with a label; vacuum (null or negative) has none."""
    rows = matrix.join(labels.where("label >= 0"), "voxel_id")
    return rows.groupBy("ray_id", "label").agg((F.sum("weight") * 0.1).alias("path"))


def polychromatic(paths: DataFrame, attenuation: DataFrame, spectrum: DataFrame) -> DataFrame:
    """(ray_id, signal): sum over energies of weight * energy * exp(- sum of mu * path).

    ``attenuation`` (label, energy, mu) and ``spectrum`` (energy, weight) are short tables.
    """
    per = paths.join(attenuation, "label").groupBy("ray_id", "energy").agg(F.sum(F.col("mu") * F.col("path")).alias("depth"))
    return per.join(spectrum, "energy").groupBy("ray_id").agg(F.sum(F.col("weight") * F.col("energy") * F.exp(-F.col("depth"))).alias("signal"))

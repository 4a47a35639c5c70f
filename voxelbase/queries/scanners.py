"""Projectors and reconstructions of cylindrical, helical and calibrated (projection-matrix) scanners."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelbase.functions.scalar import tidy
from voxelbase.operators import geometry as G
from voxelbase.operators import projector as J
from voxelbase.operators import rebin
from voxelbase.plans import fdk, solve
from voxelbase.sources.tables import volume

from .recon import FDK_SQL, FORWARD, GRID, HELIX, SCAN, _geometry_columns, _geometry_sql, _volume, data, geo_sql, matrix_sql, rays_sql, sirt_sql

R = lambda e, n=6: f"(round({e}, {n}) + 0.0)"
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


RADIUS = 150.0
X = "x AS (SELECT p_partkey % 400 AS voxel_id, avg(p_size) / 1000.0 AS value FROM part GROUP BY 1)"
READINGS = "b AS MATERIALIZED (SELECT ray_id, coalesce(p.value, 0.0) AS value FROM ray LEFT JOIN (SELECT ray_id, sum(weight * value) AS value FROM a JOIN x USING (voxel_id) GROUP BY ray_id) p USING (ray_id))"


def cyl_rays_sql(radius: float) -> str:
    """Pixels on a cylinder whose axis lies ``radius`` from the detector's middle, towards the source."""
    return f"""pix AS (SELECT view, v, u, a, sx, sy, sz, 60.0 - {radius} + {radius} * cos((u - 7.5) * 1.6 / {radius}) AS along, {radius} * sin((u - 7.5) * 1.6 / {radius}) AS across, (v - 1.5) * 1.6 AS h FROM geo, range(0, 4) w(v), range(0, 16) q(u)),
ray AS (SELECT (view * 4 + v) * 16 + u AS ray_id, view, v, u, sx, sy, sz, across * cos(a) - along * sin(a) - sx AS dx, across * sin(a) + along * cos(a) - sy AS dy, h AS dz FROM pix)"""


CYL = f"{geo_sql(SCAN)}, {cyl_rays_sql(RADIUS)}, {matrix_sql(SCAN, GRID)}, {X}, {READINGS}"
HELICAL = f"{geo_sql(HELIX)}, {rays_sql(HELIX)}, {matrix_sql(HELIX, GRID)}, {X}, {READINGS}"


def cyl_rays(spark):
    px = G.cylindrical_pixels(G.scanner_frames(spark, SCAN), SCAN, RADIUS)
    return px.select(((F.col("view") * SCAN.nv + F.col("v")) * SCAN.nu + F.col("u")).alias("ray_id"), "view", "v", "u", "src", "dst")


def readings(spark, d, rays, matrix):
    return rays.select("ray_id").join(J.forward(matrix, volume(spark, d, 10, 10, 4)), "ray_id", "left").select("ray_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def _values(rows, key="ray_id", digits=6):
    return rows.select(key, tidy(F.col("value"), digits).alias("value"))


@query("siddon_cylindrical", f"WITH {CYL} SELECT ray_id, {R('value')} AS value FROM b")
def _(spark, d):
    rays = cyl_rays(spark)
    return _values(readings(spark, d, rays, J.siddon(rays, GRID)))


@query("siddon_cylindrical_back", f"WITH {CYL} SELECT voxel_id, {R('sum(weight * value)', 5)} AS value FROM a JOIN b USING (ray_id) GROUP BY voxel_id")
def _(spark, d):
    rays = cyl_rays(spark)
    matrix = solve.settle(J.siddon(rays, GRID))
    return _values(J.back(matrix, readings(spark, d, rays, matrix)), "voxel_id", 5)


JOSEPH_A = """r AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS len, CASE WHEN abs(dx) >= abs(dy) AND abs(dx) >= abs(dz) THEN 0 ELSE 1 END AS m FROM ray),
s AS (SELECT ray_id, m, k, len / abs(CASE m WHEN 0 THEN dx ELSE dy END) AS step, ((-5 + k + 0.5) - CASE m WHEN 0 THEN sx ELSE sy END) / CASE m WHEN 0 THEN dx ELSE dy END AS t, sx, sy, sz, dx, dy, dz FROM r, range(0, 10) q(k)),
p AS (SELECT ray_id, m, k, step, CASE m WHEN 0 THEN sy + t * dy ELSE sx + t * dx END + 5 - 0.5 AS pb, sz + t * dz + 2 - 0.5 AS pc FROM s WHERE t BETWEEN 0 AND 1),
a AS (SELECT ray_id, step * greatest(0, 1 - abs(pb - j)) * greatest(0, 1 - abs(pc - z)) AS weight, CASE m WHEN 0 THEN (z * 10 + j) * 10 + k ELSE (z * 10 + k) * 10 + j END AS voxel_id FROM p, range(0, 10) aa(j), range(0, 4) bb(z) WHERE abs(pb - j) < 1 AND abs(pc - z) < 1)"""
JOSEPH_CYL = f"{geo_sql(SCAN)}, {cyl_rays_sql(RADIUS)}, {JOSEPH_A}, {X}, {READINGS}"
JOSEPH_FLAT = f"{geo_sql(SCAN)}, {rays_sql(SCAN)}, {JOSEPH_A}, {X}, {READINGS}"


@query("joseph_cylindrical", f"WITH {JOSEPH_CYL} SELECT ray_id, {R('value')} AS value FROM b")
def _(spark, d):
    rays = cyl_rays(spark)
    return _values(readings(spark, d, rays, J.joseph(rays, GRID)))


@query("joseph_cylindrical_back", f"WITH {JOSEPH_CYL} SELECT voxel_id, {R('sum(weight * value)', 5)} AS value FROM a JOIN b USING (ray_id) GROUP BY voxel_id")
def _(spark, d):
    rays = cyl_rays(spark)
    matrix = solve.settle(J.joseph(rays, GRID))
    return _values(J.back(matrix, readings(spark, d, rays, matrix)), "voxel_id", 5)


@query("joseph_back", f"WITH {JOSEPH_FLAT} SELECT voxel_id, {R('sum(weight * value)', 5)} AS value FROM a JOIN b USING (ray_id) GROUP BY voxel_id")
def _(spark, d):
    """The transpose of the Joseph projector, by gathering the same weights."""
    rays = J.rays(G.flat_geometry(spark, SCAN), SCAN)
    matrix = solve.settle(J.joseph(rays, GRID))
    return _values(J.back(matrix, readings(spark, d, rays, matrix)), "voxel_id", 5)


@query("sirt_cylindrical", sirt_sql(2).replace(FORWARD, CYL))
def _(spark, d):
    rays = cyl_rays(spark)
    matrix = solve.settle(J.siddon(rays, GRID))
    return _volume(solve.algebraic(matrix, solve.settle(readings(spark, d, rays, matrix)), 2))


@query("sirt_helical", sirt_sql(2).replace(FORWARD, HELICAL))
def _(spark, d):
    rays = J.rays(G.flat_geometry(spark, HELIX), HELIX)
    matrix = solve.settle(J.siddon(rays, GRID))
    return _volume(solve.algebraic(matrix, solve.settle(readings(spark, d, rays, matrix)), 2))


# Scanners known by their 3 x 4 matrices only.
@query("matrix_to_geometry", _geometry_sql(SCAN).replace(f"{R('a')} AS angle, ", ""))
def _(spark, d):
    g = G.from_projection_matrix(G.projection_matrix(G.flat_geometry(spark, SCAN)))
    return _geometry_columns(g.withColumn("angle", F.lit(0.0))).drop("angle")


def matrix_rays(spark):
    return J.rays(G.from_projection_matrix(G.projection_matrix(G.flat_geometry(spark, SCAN))), SCAN)


@query("matrix_siddon", f"WITH {FORWARD} SELECT ray_id, {R('value')} AS value FROM b")
def _(spark, d):
    rays = matrix_rays(spark)
    return _values(readings(spark, d, rays, J.siddon(rays, GRID)))


@query("matrix_siddon_back", f"WITH {FORWARD} SELECT voxel_id, {R('sum(weight * value)', 5)} AS value FROM a JOIN b USING (ray_id) GROUP BY voxel_id")
def _(spark, d):
    rays = matrix_rays(spark)
    matrix = solve.settle(J.siddon(rays, GRID))
    return _values(J.back(matrix, readings(spark, d, rays, matrix)), "voxel_id", 5)


@query("matrix_sirt", sirt_sql(2))
def _(spark, d):
    rays = matrix_rays(spark)
    matrix = solve.settle(J.siddon(rays, GRID))
    return _volume(solve.algebraic(matrix, solve.settle(readings(spark, d, rays, matrix)), 2))


# Detector maps of whole frames.
def _sample_sql(frame: str, u: str, v: str) -> str:
    """Bilinear samples of table (view, v, u, value) at places (uc, vc) of target pixels, 0 outside."""
    return f"pl AS (SELECT u, v, {u} AS uc, {v} AS vc FROM range(0, 16) q(u), range(0, 4) w(v)), sm AS (SELECT f.view, pl.v, pl.u, sum(f.value * (1 - abs(uc - f.u)) * (1 - abs(vc - f.v))) AS value FROM pl JOIN {frame} f ON f.u BETWEEN floor(uc) AND floor(uc) + 1 AND f.v BETWEEN floor(vc) AND floor(vc) + 1 GROUP BY f.view, pl.v, pl.u)"


_S = f"(120.0 * (120.0 - {RADIUS}) + sqrt(pow(120.0 * (120.0 - {RADIUS}), 2) - (pow((u - 7.5) * 1.6, 2) + 14400.0) * (pow(120.0 - {RADIUS}, 2) - pow({RADIUS}, 2)))) / (pow((u - 7.5) * 1.6, 2) + 14400.0)"
TO_FLAT = _sample_sql("pb", f"atan2({_S} * (u - 7.5) * 1.6, {_S} * 120.0 - (120.0 - {RADIUS})) * {RADIUS} / 1.6 + 7.5", f"{_S} * (v - 1.5) + 1.5")
PB = "pb AS MATERIALIZED (SELECT view, v, u, b.value FROM b JOIN ray USING (ray_id))"


def cyl_frames(spark, d):
    rays = cyl_rays(spark)
    b = readings(spark, d, rays, J.siddon(rays, GRID))
    return fdk.to_frames(rays.join(b, "ray_id").select("view", "v", "u", "value"), SCAN)


def _pixels(frames):
    i = F.col("i")
    return frames.select("view", F.posexplode("data").alias("i", "value")).select("view", F.floor(i / SCAN.nu).alias("v"), (i % SCAN.nu).cast("long").alias("u"), "value")


@query("cylinder_to_flat", f"WITH {CYL}, {PB}, {TO_FLAT} SELECT view, v, u, {R('value')} AS value FROM sm")
def _(spark, d):
    return _pixels(rebin.cylinder_to_flat(cyl_frames(spark, d), SCAN, RADIUS)).select("view", "v", "u", tidy(F.col("value")).alias("value"))


ARC = _sample_sql("pb", "tan((u - 7.5) * 1.6 / 120.0) * 120.0 / 1.6 + 7.5", "(v - 1.5) / cos((u - 7.5) * 1.6 / 120.0) + 1.5")


@query("flat_to_arc", f"WITH {FORWARD}, {PB}, {ARC} SELECT view, v, u, {R('value')} AS value FROM sm")
def _(spark, d):
    px = J.rays(G.flat_geometry(spark, SCAN), SCAN).join(data(spark, d)[1], "ray_id").select("view", "v", "u", "value")
    return _pixels(rebin.flat_to_arc(fdk.to_frames(px, SCAN), SCAN)).select("view", "v", "u", tidy(F.col("value")).alias("value"))


_FDK_TAIL = FDK_SQL[FDK_SQL.index("f AS MATERIALIZED") :]
_W = "b2 AS (SELECT view, v, u, value * 120.0 / sqrt(pow((u - 7.5) * 1.6, 2) + pow((v - 1.5) * 1.6, 2) + 14400.0) AS value FROM sm)"
CYL_FDK = f"WITH {CYL}, {PB}, {TO_FLAT}, {_W}, " + _FDK_TAIL.replace("FROM b p,", "FROM b2 p,")


@query("fdk_cylindrical", CYL_FDK)
def _(spark, d):
    flat = _pixels(rebin.cylinder_to_flat(cyl_frames(spark, d), SCAN, RADIUS))
    return _volume(fdk.reconstruct(flat, G.flat_geometry(spark, SCAN), SCAN, GRID))

"""Geometry, projectors, analytic and iterative reconstruction on a small scan."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from voxelbase.functions.scalar import cross, dot, norm, tidy
from voxelbase.operators import geometry as G
from voxelbase.operators import projector as J
from voxelbase.operators.geometry import Scan
from voxelbase.operators.projector import Grid
from voxelbase.plans import fdk, pocs, solve
from voxelbase.sources.tables import volume

SCAN = Scan(views=12, nu=16, nv=4, du=1.6, dv=1.6, sid=60.0, sdd=120.0, start=0.1)
HELIX = Scan(views=40, nu=16, nv=4, du=1.6, dv=1.6, sid=60.0, sdd=120.0, per_turn=16, start=0.3, direction=-1, pitch=8.0, start_z=-3.0, offset=(0.7, 0.2, -0.4))
GRID = Grid(10, 10, 4)

R = lambda e, n=6: f"(round({e}, {n}) + 0.0)"
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def geo_sql(s: Scan) -> str:
    """geo: source, first pixel and pixel steps of a circular or helical flat scan, untilted."""
    n = s.per_turn or s.views
    ou, on, ov = s.offset
    return f"""geo AS (SELECT view, a, {s.sid} * sin(a) AS sx, {-s.sid} * cos(a) AS sy, z AS sz, cos(a) * {s.du} AS ux, sin(a) * {s.du} AS uy, {s.dv} AS vz,
  {-(s.sdd - s.sid)} * sin(a) + {ou} * cos(a) + {on} * sin(a) - {(s.nu - 1) / 2 * s.du} * cos(a) AS ox, {s.sdd - s.sid} * cos(a) + {ou} * sin(a) - {on} * cos(a) - {(s.nu - 1) / 2 * s.du} * sin(a) AS oy, z + {ov - (s.nv - 1) / 2 * s.dv} AS oz
  FROM (SELECT view, {s.start} + view * ({s.direction} * 2 * pi() / {n}) AS a, {s.start_z} + view * {-s.pitch / n} AS z FROM range(0, {s.views}) t(view)))"""


def rays_sql(s: Scan) -> str:
    return f"""ray AS (SELECT (view * {s.nv} + v) * {s.nu} + u AS ray_id, view, v, u, sx, sy, sz, ox + u * ux - sx AS dx, oy + u * uy - sy AS dy, oz + v * vz - sz AS dz
  FROM geo, range(0, {s.nv}) a(v), range(0, {s.nu}) b(u))"""


def matrix_sql(s: Scan, g: Grid) -> str:
    """Lengths by the slab test of every ray and voxel: no traversal."""
    e = g.edge
    ends = lambda a, i, k: f"({e[i]} + ({k}) * {g.voxel[i]} - s{a}) / d{a}"
    low = ", ".join(f"least({ends(a, i, 'i' + a)}, {ends(a, i, 'i' + a + ' + 1')})" for i, a in enumerate("xyz"))
    high = ", ".join(f"greatest({ends(a, i, 'i' + a)}, {ends(a, i, 'i' + a + ' + 1')})" for i, a in enumerate("xyz"))
    return f"""vox AS (SELECT id AS voxel_id, id % {g.nx} AS ix, (id // {g.nx}) % {g.ny} AS iy, id // {g.nx * g.ny} AS iz FROM range(0, {g.nx * g.ny * g.nz}) t(id)),
a AS MATERIALIZED (SELECT ray_id, voxel_id, (hi - lo) * len AS weight FROM (SELECT ray_id, voxel_id, sqrt(dx * dx + dy * dy + dz * dz) AS len, greatest(0.0, {low}) AS lo, least(1.0, {high}) AS hi FROM ray, vox) WHERE hi - lo > 1e-12)"""


BASE = f"{geo_sql(SCAN)}, {rays_sql(SCAN)}, {matrix_sql(SCAN, GRID)}, x AS (SELECT p_partkey % {GRID.nx * GRID.ny * GRID.nz} AS voxel_id, avg(p_size) / 1000.0 AS value FROM part GROUP BY 1)"
FORWARD = f"{BASE}, b AS MATERIALIZED (SELECT ray_id, coalesce(p.value, 0.0) AS value FROM ray LEFT JOIN (SELECT ray_id, sum(weight * value) AS value FROM a JOIN x USING (voxel_id) GROUP BY ray_id) p USING (ray_id))"


def scene(spark, d):
    matrix = J.siddon(J.rays(G.flat_geometry(spark, SCAN), SCAN), GRID)
    return matrix, volume(spark, d, GRID.nx, GRID.ny, GRID.nz)


def data(spark, d):
    """The matrix, and a reading of every ray: 0 where it meets nothing, which is a measurement too."""
    matrix, x = scene(spark, d)
    rays = J.rays(G.flat_geometry(spark, SCAN), SCAN).select("ray_id")
    return matrix, rays.join(J.forward(matrix, x), "ray_id", "left").select("ray_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def _geometry_columns(g, *extra):
    flat = [tidy(F.col(f"{c}.{a}")).alias(f"{c}_{a}") for c in ("src", "det_s", "det_u", "det_v") for a in "xyz"]
    return g.select("view", tidy(F.col("angle")).alias("angle"), *flat, *extra)


def _geometry_sql(s):
    names = {"src": ("sx", "sy", "sz"), "det_s": ("ox", "oy", "oz"), "det_u": ("ux", "uy", "0.0"), "det_v": ("0.0", "0.0", "vz")}
    return f"WITH {geo_sql(s)} SELECT view, {R('a')} AS angle, " + ", ".join(f"{R(e)} AS {c}_{a}" for c, es in names.items() for a, e in zip("xyz", es)) + " FROM geo"


@query("geometry_circular", _geometry_sql(SCAN))
def _(spark, d):
    return _geometry_columns(G.flat_geometry(spark, SCAN))


@query("geometry_helical", _geometry_sql(HELIX))
def _(spark, d):
    return _geometry_columns(G.flat_geometry(spark, HELIX))


@query(
    "geometry_cylindrical",
    f"""WITH {geo_sql(SCAN)}, p AS (SELECT view, u, v, a, sz, (u - 7.5) * 1.6 / 120.0 AS phi, (v - 1.5) * 1.6 AS h FROM geo, range(0, 16) q(u), range(0, 4) w(v))
SELECT view, u::int AS u, v::int AS v, {R('-60.0 * sin(a) + 120.0 * sin(a) - 120.0 * cos(phi) * sin(a) + 120.0 * sin(phi) * cos(a)')} AS x, {R('60.0 * cos(a) - 120.0 * cos(a) + 120.0 * cos(phi) * cos(a) + 120.0 * sin(phi) * sin(a)')} AS y, {R('sz + h')} AS z FROM p""",
)
def _(spark, d):
    rows = G.cylindrical_pixels(G.scanner_frames(spark, SCAN), SCAN, 120.0)
    return rows.select("view", "u", "v", *(tidy(F.col(f"dst.{a}")).alias(a) for a in "xyz"))


@query("geometry_source_orbit", f"SELECT view, {R('30 * cos(0.1 + view * 2 * pi() / 12)')} AS src_x, {R('30 * sin(0.1 + view * 2 * pi() / 12)')} AS src_y, 45.0::double AS src_z, {R('-7.5 * 1.6')} AS x0, {R('-1.5 * 1.6')} AS y0, -60.0::double AS z0 FROM range(0, 12) t(view)")
def _(spark, d):
    g = G.source_orbit(spark, SCAN, 30.0, 45.0)
    return g.select("view", *(tidy(F.col(f"src.{a}")).alias(f"src_{a}") for a in "xyz"), *(tidy(F.col(f"det_s.{a}")).alias(f"{a}0") for a in "xyz"))


@query("geometry_tilted_axis", f"WITH {geo_sql(SCAN)} SELECT view, {R('sx')} AS x, {R('cos(0.3) * sy - sin(0.3) * sz')} AS y, {R('sin(0.3) * sy + cos(0.3) * sz')} AS z, {R('cos(0.3) * uy')} AS uy, {R('cos(0.3) * vz')} AS vz FROM geo")
def _(spark, d):
    g = G.tilted_axis(spark, SCAN, 0.3)
    return g.select("view", *(tidy(F.col(f"src.{a}")).alias(a) for a in "xyz"), tidy(F.col("det_u.y")).alias("uy"), tidy(F.col("det_v.z")).alias("vz"))


@query("geometry_rigid", f"WITH {geo_sql(SCAN)} SELECT view, {R('-sy + 1')} AS sx, {R('sx + 2')} AS sy, {R('sz + 3')} AS sz, {R('-uy')} AS ux, {R('ux')} AS uy FROM geo")
def _(spark, d):
    g = G.rigid(G.flat_geometry(spark, SCAN), [[0, -1, 0], [1, 0, 0], [0, 0, 1]], (1.0, 2.0, 3.0))
    return g.select("view", *(tidy(F.col(f"src.{a}")).alias(f"s{a}") for a in "xyz"), tidy(F.col("det_u.x")).alias("ux"), tidy(F.col("det_u.y")).alias("uy"))


@query("detector_tilts", None)
def _(spark, d):
    s = Scan(**(SCAN.__dict__ | {"tilt": (0.05, -0.1, 0.2)}))
    g = G.flat_geometry(spark, s)
    return g.select("view", tidy(norm(F.col("det_u"))).alias("du"), tidy(norm(F.col("det_v"))).alias("dv"), tidy(dot(F.col("det_u"), F.col("det_v"))).alias("skew"), tidy(cross(F.col("det_u"), F.col("det_v"))["z"]).alias("nz"))


@query("angle_steps", f"SELECT view, {R('2 * pi() / 12')} AS step FROM range(0, 12) t(view)")
def _(spark, d):
    return G.angle_steps(G.flat_geometry(spark, SCAN)).select("view", tidy(F.col("step")).alias("step"))


@query("angle_unwrap", f"SELECT view, {R('view * 0.7')} AS unwrapped FROM range(0, 60) t(view)")
def _(spark, d):
    rows = spark.range(60).select(F.col("id").alias("view"), (F.pmod(F.col("id") * 0.7 + math.pi, F.lit(2 * math.pi)) - math.pi).alias("angle"))
    return G.unwrap(rows, "view", "angle").select("view", tidy(F.col("unwrapped")).alias("unwrapped"))


@query(
    "project_points",
    f"""WITH {geo_sql(SCAN)}, p AS (SELECT p_partkey AS k, p_partkey % 7 - 3.0 AS x, p_partkey % 5 - 2.0 AS y, (p_partkey % 3 - 1.0) AS z FROM part),
t AS (SELECT view, k, {SCAN.sdd} / ((x - sx) * sin(a) * -1 + (y - sy) * cos(a)) AS m, (x - sx) * cos(a) + (y - sy) * sin(a) AS h, z - sz AS w FROM geo, p)
SELECT view, k, {R('h * m / 1.6 + 7.5')} AS u, {R('w * m / 1.6 + 1.5')} AS v FROM t""",
)
def _(spark, d):
    k = F.col("p_partkey")
    points = spark.read.parquet(f"{d}/part.parquet").select(k.alias("k"), F.struct((k % 7 - 3.0).alias("x"), (k % 5 - 2.0).alias("y"), (k % 3 - 1.0).alias("z")).alias("x"))
    rows = points.crossJoin(F.broadcast(G.projection_matrix(G.flat_geometry(spark, SCAN))))  # one small matrix a view
    u, v = G.project(F.col("p"), F.col("x"))
    return rows.select("view", "k", tidy(u).alias("u"), tidy(v).alias("v"))


@query("siddon_matrix", f"WITH {BASE} SELECT ray_id, voxel_id, {R('weight')} AS weight FROM a WHERE weight > 1e-6")
def _(spark, d):
    return scene(spark, d)[0].where("weight > 1e-6").select("ray_id", "voxel_id", tidy(F.col("weight")).alias("weight"))


@query("siddon_forward", f"WITH {FORWARD} SELECT ray_id, {R('value')} AS value FROM b")
def _(spark, d):
    return data(spark, d)[1].select("ray_id", tidy(F.col("value")).alias("value"))


@query("siddon_back", f"WITH {FORWARD} SELECT voxel_id, {R('sum(weight * value)', 5)} AS value FROM a JOIN b USING (ray_id) GROUP BY voxel_id")
def _(spark, d):
    matrix, b = data(spark, d)
    return J.back(matrix, b).select("voxel_id", tidy(F.col("value"), 5).alias("value"))


@query("row_column_sums", f"WITH {BASE} SELECT 'ray' AS kind, ray_id AS id, {R('sum(weight)')} AS total FROM a GROUP BY ray_id UNION ALL SELECT 'voxel', voxel_id, {R('sum(weight)')} FROM a GROUP BY voxel_id")
def _(spark, d):
    m, _ = scene(spark, d)
    rows = J.row_sums(m).select(F.lit("ray").alias("kind"), F.col("ray_id").alias("id"), "total").union(J.column_sums(m).select(F.lit("voxel"), "voxel_id", "total"))
    return rows.select("kind", "id", tidy(F.col("total")).alias("total"))


JOSEPH_SQL = f"""WITH {geo_sql(SCAN)}, {rays_sql(SCAN)}, x AS (SELECT p_partkey % 400 AS voxel_id, avg(p_size) / 1000.0 AS value FROM part GROUP BY 1),
r AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS len, CASE WHEN abs(dx) >= abs(dy) AND abs(dx) >= abs(dz) THEN 0 WHEN abs(dy) >= abs(dz) THEN 1 ELSE 2 END AS m FROM ray),
s AS (SELECT ray_id, m, k, len / abs(CASE m WHEN 0 THEN dx ELSE dy END) AS step, ((-5 + k + 0.5) - CASE m WHEN 0 THEN sx ELSE sy END) / CASE m WHEN 0 THEN dx ELSE dy END AS t, sx, sy, sz, dx, dy, dz FROM r, range(0, 10) q(k) WHERE m < 2),
p AS (SELECT ray_id, m, k, step, CASE m WHEN 0 THEN sy + t * dy ELSE sx + t * dx END + 5 - 0.5 AS pb, sz + t * dz + 2 - 0.5 AS pc FROM s WHERE t BETWEEN 0 AND 1),
w AS (SELECT ray_id, step * greatest(0, 1 - abs(pb - j)) * greatest(0, 1 - abs(pc - z)) AS weight, CASE m WHEN 0 THEN (z * 10 + j) * 10 + k ELSE (z * 10 + k) * 10 + j END AS voxel_id FROM p, range(0, 10) a(j), range(0, 4) b(z) WHERE abs(pb - j) < 1 AND abs(pc - z) < 1)
SELECT ray_id, {R('sum(weight * value)')} AS value FROM w JOIN x USING (voxel_id) GROUP BY ray_id"""


@query("joseph_forward", JOSEPH_SQL)
def _(spark, d):
    m = J.joseph(J.rays(G.flat_geometry(spark, SCAN), SCAN), GRID)
    return J.forward(m, volume(spark, d, 10, 10, 4)).select("ray_id", tidy(F.col("value")).alias("value"))


@query("adjoint_gap", f"WITH {FORWARD}, y AS (SELECT ray_id, ((19 * ray_id + 7) % 41) / 41.0 - 0.5 AS y FROM ray) SELECT {R('sum(value * y)', 4)} AS ax_y, 0.0::double AS gap FROM b JOIN y USING (ray_id)")
def _(spark, d):
    matrix, x = scene(spark, d)
    y = J.rays(G.flat_geometry(spark, SCAN), SCAN).select("ray_id", (((19 * F.col("ray_id") + 7) % 41) / 41.0 - 0.5).alias("value"))
    a = solve.inner(J.forward(matrix, x), y, "ray_id")
    b = solve.inner(J.back(matrix, y), x, "voxel_id")
    return spark.createDataFrame([(a, abs(a - b))], "a double, g double").select(tidy(F.col("a"), 4).alias("ax_y"), tidy(F.col("g")).alias("gap"))


PATHS = f"{BASE}, path AS (SELECT ray_id, voxel_id % 3 AS label, sum(weight) * 0.1 AS path FROM a GROUP BY ALL)"
MU = [(0, 40.0, 0.27), (0, 60.0, 0.21), (1, 40.0, 0.8), (1, 60.0, 0.4), (2, 40.0, 0.25), (2, 60.0, 0.19)]
SPECTRUM = [(40.0, 0.6), (60.0, 0.4)]


@query("material_paths", f"WITH {PATHS} SELECT ray_id, label, {R('path')} AS path FROM path")
def _(spark, d):
    m, _ = scene(spark, d)
    labels = GRID.voxels(spark).select("voxel_id", (F.col("voxel_id") % 3).alias("label"))
    return J.material_paths(m, labels).select("ray_id", "label", tidy(F.col("path")).alias("path"))


@query(
    "polychromatic_primary",
    f"WITH {PATHS}, mu(label, energy, mu) AS (VALUES {', '.join(map(str, MU))}), s(energy, w) AS (VALUES {', '.join(map(str, SPECTRUM))}), g AS (SELECT ray_id, energy, sum(mu * path) AS depth FROM path JOIN mu USING (label) GROUP BY ALL) SELECT ray_id, {R('sum(w * energy * exp(-depth))', 4)} AS signal FROM g JOIN s USING (energy) GROUP BY ray_id",
)
def _(spark, d):
    m, _ = scene(spark, d)
    labels = GRID.voxels(spark).select("voxel_id", (F.col("voxel_id") % 3).alias("label"))
    mu = spark.createDataFrame(MU, "label long, energy double, mu double")
    spectrum = spark.createDataFrame(SPECTRUM, "energy double, weight double")
    return J.polychromatic(J.material_paths(m, labels), mu, spectrum).select("ray_id", tidy(F.col("signal"), 4).alias("signal"))


# Solvers: SQL states the iterations one after another.
def _volume(x, digits=6):
    return x.select("voxel_id", tidy(F.col("value"), digits).alias("value"))


def sirt_sql(iterations: int, subsets: list[int] | None = None, relax: float = 1.0, decay: float = 1.0) -> str:
    ctes, x, k = [FORWARD, "x0 AS (SELECT DISTINCT voxel_id, 0.0::double AS value FROM a)"], "x0", 0
    n = len(subsets) if subsets else 1
    for i in range(iterations):
        for s in subsets or [0]:
            own = f"(SELECT * FROM a WHERE (ray_id // 64) % {n} = {s})"
            ctes.append(f"r{k} AS (SELECT ray_id, (b.value - p.value) / (p.total + 1e-8) AS value FROM b JOIN (SELECT ray_id, sum(weight * value) AS value, sum(weight) AS total FROM {own} JOIN {x} USING (voxel_id) GROUP BY ray_id) p USING (ray_id))")
            ctes.append(f"x{k + 1} AS MATERIALIZED (SELECT {x}.voxel_id, greatest({x}.value + {relax * decay**k} * coalesce(s.value, 0), 0.0) AS value FROM {x} LEFT JOIN (SELECT voxel_id, sum(weight * value) / (any_value(c) + 1e-8) AS value FROM {own} JOIN r{k} USING (ray_id) JOIN (SELECT voxel_id, sum(weight) AS c FROM {own} GROUP BY voxel_id) USING (voxel_id) GROUP BY voxel_id) s USING (voxel_id))")
            x, k = f"x{k + 1}", k + 1
    return f"WITH {', '.join(ctes)} SELECT voxel_id, {R('value')} AS value FROM {x}"


@query("sirt", sirt_sql(3))
def _(spark, d):
    m, b = data(spark, d)
    return _volume(solve.algebraic(solve.settle(m), solve.settle(b), 3))


@query("os_sart", sirt_sql(2, [0, 2, 1], 0.8, 0.95))
def _(spark, d):
    m, b = data(spark, d)
    x = solve.algebraic(solve.settle(m), solve.settle(b), 2, 0.8, 0.95, subsets=lambda ray: F.floor(ray / 64) % 3, n_subsets=3, golden=True)
    return _volume(x)


def cgls_sql(iterations: int) -> str:
    ctes = [FORWARD, "x0 AS (SELECT DISTINCT voxel_id, 0.0::double AS value FROM a)", "r0 AS (SELECT ray_id, value FROM b)", "p0 AS MATERIALIZED (SELECT voxel_id, sum(weight * value) AS value FROM a JOIN r0 USING (ray_id) GROUP BY voxel_id)", "g0 AS (SELECT sum(value * value) AS g FROM p0)"]
    for i in range(iterations):
        ctes += [
            f"q{i} AS MATERIALIZED (SELECT ray_id, sum(weight * value) AS value FROM a JOIN p{i} USING (voxel_id) GROUP BY ray_id)",
            f"al{i} AS (SELECT (SELECT g FROM g{i}) / sum(value * value) AS al FROM q{i})",
            f"x{i + 1} AS MATERIALIZED (SELECT voxel_id, x{i}.value + al * p{i}.value AS value FROM x{i} JOIN p{i} USING (voxel_id), al{i})",
            f"r{i + 1} AS MATERIALIZED (SELECT ray_id, r{i}.value - al * q{i}.value AS value FROM r{i} JOIN q{i} USING (ray_id), al{i})",
            f"s{i + 1} AS MATERIALIZED (SELECT voxel_id, sum(weight * value) AS value FROM a JOIN r{i + 1} USING (ray_id) GROUP BY voxel_id)",
            f"g{i + 1} AS (SELECT sum(value * value) AS g FROM s{i + 1})",
            f"p{i + 1} AS MATERIALIZED (SELECT voxel_id, s{i + 1}.value + (SELECT g FROM g{i + 1}) / ((SELECT g FROM g{i}) + 1e-16) * p{i}.value AS value FROM s{i + 1} JOIN p{i} USING (voxel_id))",
        ]
    return f"WITH {', '.join(ctes)} SELECT voxel_id, {R('value')} AS value FROM x{iterations}"


@query("cgls", cgls_sql(3))
def _(spark, d):
    m, b = data(spark, d)
    return _volume(solve.cgls(solve.settle(m), solve.settle(b), 3))


NEIGHBOURS = "nb AS (SELECT v.voxel_id, w.voxel_id AS other FROM vox v JOIN vox w ON abs(v.ix - w.ix) + abs(v.iy - w.iy) + abs(v.iz - w.iz) = 1)"


def gradient_sql(iterations: int, step: float, strength: float, grad: str) -> str:
    """``grad``: SQL of the penalty's gradient over (voxel_id, value) of {x}."""
    ctes, x = [FORWARD, NEIGHBOURS, "x0 AS (SELECT DISTINCT voxel_id, 0.0::double AS value FROM a)"], "x0"
    for i in range(iterations):
        ctes.append(f"r{i} AS (SELECT ray_id, b.value - p.value AS value FROM b JOIN (SELECT ray_id, sum(weight * value) AS value FROM a JOIN {x} USING (voxel_id) GROUP BY ray_id) p USING (ray_id))")
        ctes.append(f"d{i} AS (SELECT voxel_id, sum(weight * value) AS value FROM a JOIN r{i} USING (ray_id) GROUP BY voxel_id), g{i} AS ({grad.format(x=x)})")
        ctes.append(f"x{i + 1} AS MATERIALIZED (SELECT {x}.voxel_id, greatest({x}.value + {step} * (d{i}.value - {strength} * coalesce(g{i}.value, 0)), 0.0) AS value FROM {x} JOIN d{i} USING (voxel_id) LEFT JOIN g{i} USING (voxel_id))")
        x = f"x{i + 1}"
    return f"WITH {', '.join(ctes)} SELECT voxel_id, {R('value')} AS value FROM {x}"


PAIR = "SELECT x.voxel_id, sum({e}) AS value FROM {{x}} x JOIN nb USING (voxel_id) JOIN {{x}} o ON o.voxel_id = nb.other GROUP BY x.voxel_id"
D = "(x.value - o.value)"
SLOPES = "SELECT v.voxel_id, coalesce(a.value - v.value, 0.0) AS gx, coalesce(b.value - v.value, 0.0) AS gy, coalesce(c.value - v.value, 0.0) AS gz FROM {x} v JOIN vox USING (voxel_id) LEFT JOIN {x} a ON a.voxel_id = v.voxel_id + 1 AND ix < 9 LEFT JOIN {x} b ON b.voxel_id = v.voxel_id + 10 AND iy < 9 LEFT JOIN {x} c ON c.voxel_id = v.voxel_id + 100"
FLUX = "WITH s AS (" + SLOPES.replace("{x}", "{{x}}") + "), t AS (SELECT *, {w} AS w FROM s) SELECT voxel_id, sum(f) AS value FROM (SELECT voxel_id, -w * (gx + gy + gz) AS f FROM t UNION ALL SELECT voxel_id + 1, w * gx FROM t UNION ALL SELECT voxel_id + 10, w * gy FROM t UNION ALL SELECT voxel_id + 100, w * gz FROM t) GROUP BY voxel_id"
XVOX = f"vox AS (SELECT id AS voxel_id, id % 10 AS ix, (id // 10) % 10 AS iy, id // 100 AS iz FROM range(0, 400) t(id)), x AS (SELECT p_partkey % 400 AS voxel_id, avg(p_size) / 1000.0 AS value FROM part GROUP BY 1)"
PENALTIES = {
    "tikhonov": (solve.tikhonov_gradient, "SELECT voxel_id, value FROM {x}"),
    "quadratic": (solve.quadratic_gradient, PAIR.format(e=D)),
    "huber": (solve.huber_gradient(0.005), FLUX.format(w="1 / greatest(0.005, sqrt(gx * gx + gy * gy + gz * gz))")),
    "smoothed_tv": (solve.smoothed_tv_gradient(0.01), FLUX.format(w="1 / sqrt(gx * gx + gy * gy + gz * gz + 0.0001)")),
}
for _name, (_grad, _sql) in PENALTIES.items():

    @query(f"penalised_{_name}", gradient_sql(2, 0.002, 0.3, _sql))
    def _(spark, d, gradient=_grad):
        m, b = data(spark, d)
        return _volume(solve.penalised(solve.settle(m), solve.settle(b), GRID, 2, 0.002, 0.3, gradient))


PENALTY_SQL = f"""WITH {XVOX}, s AS ({SLOPES.format(x='x')}), n AS (SELECT sqrt(gx * gx + gy * gy + gz * gz) AS n FROM s)
SELECT 'huber' AS penalty, {R('sum(CASE WHEN n <= 0.005 THEN n * n / 0.01 ELSE n - 0.0025 END)')} AS value FROM n UNION ALL SELECT 'smoothed_tv', {R('sum(sqrt(n * n + 0.0001) - 0.01)')} FROM n UNION ALL SELECT 'tv', {R('sum(n)')} FROM n UNION ALL SELECT 'tikhonov', {R('sum(value * value) / 2')} FROM x"""


@query("penalty_values", PENALTY_SQL)
def _(spark, d):
    x = solve.settle(volume(spark, d, 10, 10, 4))
    rows = [(k, solve.penalty_value(x, GRID, k, p)) for k, p in (("huber", 0.005), ("smoothed_tv", 0.01), ("tv", 0.0), ("tikhonov", 0.0))]
    return spark.createDataFrame(rows, "penalty string, v double").select("penalty", tidy(F.col("v")).alias("value"))


def smooth_sql(rounds: int) -> str:
    ctes, x = [XVOX], "x"
    for i in range(rounds):
        ctes += [f"g{i} AS MATERIALIZED ({FLUX.format(w='1 / sqrt(gx * gx + gy * gy + gz * gz + 0.0001)').format(x=x)})", f"x{i + 1} AS MATERIALIZED (SELECT voxel_id, {x}.value - 0.002 * coalesce(g{i}.value, 0) AS value FROM {x} LEFT JOIN g{i} USING (voxel_id))"]
        x = f"x{i + 1}"
    return f"WITH {', '.join(ctes)} SELECT voxel_id, {R('value')} AS value FROM {x}"


@query("tv_smoothing", smooth_sql(2))
def _(spark, d):
    return _volume(solve.smooth_by_tv(volume(spark, d, 10, 10, 4), GRID, 2, 0.002, 0.01))


def denoise_sql(rounds: int, strength: float) -> str:
    t = 1 / 12**0.5
    ctes = [XVOX, "u0 AS (SELECT voxel_id, value, value AS bar, 0.0::double AS px, 0.0::double AS py, 0.0::double AS pz FROM x)"]
    for i in range(rounds):
        ctes += [
            f"b{i} AS (SELECT voxel_id, bar AS value FROM u{i}), s{i} AS ({SLOPES.format(x=f'b{i}')})",
            f"m{i} AS (SELECT u{i}.*, px + {t} * gx AS qx, py + {t} * gy AS qy, pz + {t} * gz AS qz FROM u{i} JOIN s{i} USING (voxel_id))",
            f"q{i} AS MATERIALIZED (SELECT voxel_id, value, qx / k AS px, qy / k AS py, qz / k AS pz FROM (SELECT *, greatest(1.0, sqrt(qx * qx + qy * qy + qz * qz) / {strength}) AS k FROM m{i}))",
            f"f{i} AS (SELECT voxel_id, sum(f) AS f FROM (SELECT voxel_id, -px - py - pz AS f FROM q{i} UNION ALL SELECT voxel_id + 1, px FROM q{i} UNION ALL SELECT voxel_id + 10, py FROM q{i} UNION ALL SELECT voxel_id + 100, pz FROM q{i}) GROUP BY voxel_id)",
            f"u{i + 1} AS MATERIALIZED (SELECT voxel_id, n AS value, 2 * n - old AS bar, px, py, pz FROM (SELECT q{i}.voxel_id, q{i}.value AS old, (q{i}.value - {t} * coalesce(f, 0) + {t} * x.value) / (1 + {t}) AS n, px, py, pz FROM q{i} JOIN x USING (voxel_id) LEFT JOIN f{i} USING (voxel_id)))",
        ]
    return f"WITH {', '.join(ctes)} SELECT voxel_id, {R('value')} AS value FROM u{rounds}"


@query("tv_denoise", denoise_sql(4, 0.004))
def _(spark, d):
    return _volume(solve.tv_denoise(volume(spark, d, 10, 10, 4), GRID, 0.004, 4))


# The same penalties on voxels of 0.5 x 1 x 2.
SPACED = Grid(10, 10, 4, (0.5, 1.0, 2.0))


def _spaced(sql: str) -> str:
    """The SQL at spacing 1 with slopes over the voxel's sides, and fluxes over them again."""
    for near, axis, k, h in zip("abc", "xyz", (1, 10, 100), SPACED.voxel):
        sql = sql.replace(f"coalesce({near}.value - v.value, 0.0) AS g{axis}", f"coalesce({near}.value - v.value, 0.0) / {h} AS g{axis}")
        sql = sql.replace(f"voxel_id + {k}, w * g{axis} FROM", f"voxel_id + {k}, w * g{axis} / {h} FROM").replace(f"voxel_id + {k}, p{axis} FROM", f"voxel_id + {k}, p{axis} / {h} FROM")
    sql = sql.replace("-w * (gx + gy + gz) AS f", "-w * (gx / 0.5 + gy + gz / 2.0) AS f").replace("-px - py - pz AS f", "-px / 0.5 - py - pz / 2.0 AS f")
    return sql.replace(str(1 / 12**0.5), str(1 / 21**0.5))  # 4 / 0.25 + 4 + 4 / 4


@query("penalty_values_spaced", _spaced(PENALTY_SQL) + f" UNION ALL SELECT 'flat_tv', {R('sum(sqrt(gx * gx + gy * gy))')} FROM s")
def _(spark, d):
    x = solve.settle(volume(spark, d, 10, 10, 4))
    rows = [(k, solve.penalty_value(x, SPACED, k, p)) for k, p in (("huber", 0.005), ("smoothed_tv", 0.01), ("tv", 0.0), ("tikhonov", 0.0))]
    rows.append(("flat_tv", solve.penalty_value(x, SPACED, "tv", flat=True)))
    return spark.createDataFrame(rows, "penalty string, v double").select("penalty", tidy(F.col("v")).alias("value"))


@query("tv_smoothing_spaced", _spaced(smooth_sql(2)))
def _(spark, d):
    return _volume(solve.smooth_by_tv(volume(spark, d, 10, 10, 4), SPACED, 2, 0.002, 0.01))


@query("tv_denoise_spaced", _spaced(denoise_sql(4, 0.004)))
def _(spark, d):
    return _volume(solve.tv_denoise(volume(spark, d, 10, 10, 4), SPACED, 0.004, 4))


# POCS: two outer steps, their norms as scalars of the query.
POCS = pocs.Pocs(iterations=2, relax=0.9, relax_decay=0.95, descents=2, length=0.3, length_decay=0.5, most_ratio=0.2)


def pocs_sql(p: pocs.Pocs, subsets: list[int]) -> str:
    ctes, x, k, n = [FORWARD, "x0 AS (SELECT DISTINCT voxel_id, 0.0::double AS value FROM a)"], "x0", 0, len(subsets)
    norm = lambda name, rows: ctes.append(f"{name} AS MATERIALIZED (SELECT sqrt(coalesce(sum(v * v), 0)) AS n FROM ({rows}))")
    off = lambda t: f"SELECT b.value - coalesce(q.value, 0) AS v FROM b LEFT JOIN (SELECT ray_id, sum(weight * value) AS value FROM a JOIN {t} USING (voxel_id) GROUP BY ray_id) q USING (ray_id)"
    gap = lambda t, u: f"SELECT {t}.value - {u}.value AS v FROM {t} JOIN {u} USING (voxel_id)"
    w = lambda c: f"exp(-pow({c} / {p.edge}, 2))" if p.edge else "1.0"
    for i in range(p.iterations):
        start = x
        norm(f"off{i}", off(x))
        for s in subsets:
            own = f"(SELECT * FROM a WHERE (ray_id // 64) % {n} = {s})"
            ctes.append(f"r{k} AS (SELECT ray_id, (b.value - p.value) / (p.total + 1e-8) AS value FROM b JOIN (SELECT ray_id, sum(weight * value) AS value, sum(weight) AS total FROM {own} JOIN {x} USING (voxel_id) GROUP BY ray_id) p USING (ray_id))")
            ctes.append(f"x{k + 1} AS MATERIALIZED (SELECT {x}.voxel_id, greatest({x}.value + {p.relax * p.relax_decay**i} * coalesce(s.value, 0), 0.0) AS value FROM {x} LEFT JOIN (SELECT voxel_id, sum(weight * value) / (any_value(c) + 1e-8) AS value FROM {own} JOIN r{k} USING (ray_id) JOIN (SELECT voxel_id, sum(weight) AS c FROM {own} GROUP BY voxel_id) USING (voxel_id) GROUP BY voxel_id) s USING (voxel_id))")
            x, k = f"x{k + 1}", k + 1
        norm(f"er{i}", off(x))
        norm(f"dp{i}", gap(x, start))
        step = (("1.0" if i == 0 else f"(SELECT off{i}.n / greatest(er0.n, 1e-6) FROM off{i}, er0)") if p.kind == "pcsd" else f"(SELECT n FROM le{i})")
        if p.kind == "asd" and i == 0:
            ctes.append(f"le0 AS (SELECT {p.length} * n AS n FROM dp0)")
        before = x
        for t in range(p.descents):
            tag = f"{i}_{t}"
            ctes += [
                f"d{tag} AS (SELECT v.voxel_id, coalesce(v.value - e.value, 0.0) AS dx, coalesce(v.value - f.value, 0.0) AS dy, coalesce(v.value - h.value, 0.0) AS dz FROM {x} v JOIN vox USING (voxel_id) LEFT JOIN {x} e ON e.voxel_id = v.voxel_id - 1 AND ix > 0 LEFT JOIN {x} f ON f.voxel_id = v.voxel_id - 10 AND iy > 0 LEFT JOIN {x} h ON h.voxel_id = v.voxel_id - 100)",
                f"w{tag} AS (SELECT voxel_id, {w('dx')} * dx / n AS fx, {w('dy')} * dy / n AS fy, {w('dz')} * dz / n AS fz FROM (SELECT *, sqrt({w('dx')} * dx * dx + {w('dy')} * dy * dy + {w('dz')} * dz * dz) + 1e-8 AS n FROM d{tag}))",
                f"g{tag} AS MATERIALIZED (SELECT voxel_id, sum(f) AS v FROM (SELECT voxel_id, fx + fy + fz AS f FROM w{tag} UNION ALL SELECT voxel_id - 1, -fx FROM w{tag} UNION ALL SELECT voxel_id - 10, -fy FROM w{tag} UNION ALL SELECT voxel_id - 100, -fz FROM w{tag}) GROUP BY voxel_id)",
                f"y{tag} AS MATERIALIZED (SELECT {x}.voxel_id, {x}.value - {step} / (SELECT sqrt(sum(v * v)) FROM g{tag} JOIN {x} USING (voxel_id)) * coalesce(g{tag}.v, 0) AS value FROM {x} LEFT JOIN g{tag} USING (voxel_id))",
            ]
            x = f"y{tag}"
        ctes.append(f"z{i} AS MATERIALIZED (SELECT voxel_id, greatest(value, 0.0) AS value FROM {x})")
        x = f"z{i}"
        if p.kind == "asd":
            norm(f"dg{i}", gap(x, before))
            ctes.append(f"le{i + 1} AS (SELECT le{i}.n * CASE WHEN dg{i}.n > {p.most_ratio} * dp{i}.n AND er{i}.n > {p.most_error} THEN {p.length_decay} ELSE 1 END AS n FROM le{i}, dg{i}, dp{i}, er{i})")
    return f"WITH {', '.join(ctes)} SELECT voxel_id, {R('value')} AS value FROM {x}"


for _name, _pocs, _subsets in (
    ("asd_pocs", POCS, [0]),
    ("os_asd_pocs", POCS, [0, 1, 2]),
    ("aw_asd_pocs", replace(POCS, edge=0.005), [0]),
    ("pcsd", replace(POCS, kind="pcsd"), [0]),
    ("os_aw_pcsd", replace(POCS, kind="pcsd", edge=0.02), [0, 1, 2]),
):

    @query(_name, pocs_sql(_pocs, _subsets))
    def _(spark, d, p=_pocs, n=len(_subsets)):
        m, b = (solve.settle(t) for t in data(spark, d))
        return _volume(pocs.reconstruct(m, b, GRID, p, (lambda ray: F.floor(ray / 64) % n) if n > 1 else None, n)[0])


@query("sart", sirt_sql(1, list(range(12)), 0.8))
def _(spark, d):
    """A step for each view."""
    m, b = (solve.settle(t) for t in data(spark, d))
    return _volume(solve.algebraic(m, b, 1, 0.8, subsets=lambda ray: F.floor(ray / 64) % 12, n_subsets=12))


WLS_SQL = f"""WITH {FORWARD}, w AS (SELECT ray_id, 1.0 / (1 + ray_id % 4) AS w FROM ray), one AS (SELECT ray_id, sum(weight) AS total FROM a GROUP BY ray_id)
SELECT (SELECT {R('sum(w * value * value) / 2')} FROM b JOIN w USING (ray_id)) AS objective, (SELECT {R('max(l)', 4)} FROM (SELECT sum(a.weight * total * w) AS l FROM a JOIN one USING (ray_id) JOIN w USING (ray_id) GROUP BY voxel_id)) AS lipschitz"""


@query("weighted_objective", WLS_SQL)
def _(spark, d):
    m, b = (solve.settle(t) for t in data(spark, d))
    w = b.select("ray_id", (1.0 / (1 + F.col("ray_id") % 4)).alias("weight"))
    rows = [(solve.weighted_squares(m, b, w, solve.zeros(m)), solve.lipschitz(m, w))]
    return spark.createDataFrame(rows, "a double, b double").select(tidy(F.col("a")).alias("objective"), tidy(F.col("b"), 4).alias("lipschitz"))


@query("monotone_descent", None)
def _(spark, d):
    m, b = (solve.settle(t) for t in data(spark, d))
    w = solve.settle(b.select("ray_id", F.lit(1.0).alias("weight")))
    return _volume(solve.descend(m, b, GRID, w, 2, 0.01, ("smoothed_tv", 0.01), solve.smoothed_tv_gradient(0.01)))


@query("regularised_algebraic", None)
def _(spark, d):
    m, b = (solve.settle(t) for t in data(spark, d))
    return _volume(solve.regularised(m, b, GRID, 2, 0.9, 0.0005, solve.smoothed_tv_gradient(0.01)))


@query("penalised_nesterov", None)
def _(spark, d):
    m, b = data(spark, d)
    return _volume(solve.penalised(solve.settle(m), solve.settle(b), GRID, 3, 0.002, 0.1, solve.quadratic_gradient, nesterov=True))


@query(
    "pwls",
    f"""WITH {FORWARD}, {NEIGHBOURS}, c AS (SELECT voxel_id, sum(a.weight * t.total * t.w) + 0.2 * any_value(n.k) + 1e-8 AS c FROM a JOIN (SELECT ray_id, sum(weight) AS total, 1.0 / (1 + ray_id % 4) AS w FROM a GROUP BY ray_id) t USING (ray_id) JOIN (SELECT voxel_id, count(*) AS k FROM nb GROUP BY voxel_id) n USING (voxel_id) GROUP BY voxel_id),
x1 AS MATERIALIZED (SELECT voxel_id, greatest(sum(weight * value / (1 + ray_id % 4)) / any_value(c.c), 0.0) AS value FROM a JOIN b USING (ray_id) JOIN c USING (voxel_id) GROUP BY voxel_id),
r AS (SELECT ray_id, (b.value - p.value) / (1 + ray_id % 4) AS value FROM b JOIN (SELECT ray_id, sum(weight * value) AS value FROM a JOIN x1 USING (voxel_id) GROUP BY ray_id) p USING (ray_id)),
g AS (SELECT x.voxel_id, sum(x.value - o.value) AS g FROM x1 x JOIN nb USING (voxel_id) JOIN x1 o ON o.voxel_id = nb.other GROUP BY x.voxel_id)
SELECT voxel_id, {R('greatest(x1.value + (s.value - 0.1 * g.g) / c.c, 0.0)')} AS value FROM x1 JOIN (SELECT voxel_id, sum(weight * value) AS value FROM a JOIN r USING (ray_id) GROUP BY voxel_id) s USING (voxel_id) JOIN g USING (voxel_id) JOIN c USING (voxel_id)""",
)
def _(spark, d):
    m, b = data(spark, d)
    w = b.select("ray_id", (1.0 / (1 + F.col("ray_id") % 4)).alias("weight"))
    return _volume(solve.pwls(solve.settle(m), solve.settle(b), GRID, solve.settle(w), 2, 0.1))


@query("convergence_report", None)
def _(spark, d):
    m, b = (solve.settle(t) for t in data(spark, d))
    before = solve.algebraic(m, b, 1)
    rows = [(1, *solve.convergence(m, b, before, solve.zeros(m)).values())]
    rows.append((2, *solve.convergence(m, b, solve.algebraic(m, b, 1, x0=before), before).values()))
    return spark.createDataFrame(rows, "iteration int, residual double, update double").select("iteration", tidy(F.col("residual"), 5).alias("residual"), tidy(F.col("update"), 5).alias("update"))


FDK_SQL = f"""WITH {geo_sql(SCAN)}, {rays_sql(SCAN)}, {matrix_sql(SCAN, GRID)}, x AS (SELECT p_partkey % 400 AS voxel_id, avg(p_size) / 1000.0 AS value FROM part GROUP BY 1),
b AS (SELECT view, v, u, coalesce(value, 0.0) * 120.0 / sqrt(pow((u - 7.5) * 1.6, 2) + pow((v - 1.5) * 1.6, 2) + 14400.0) AS value FROM ray LEFT JOIN (SELECT ray_id, sum(weight * value) AS value FROM a JOIN x USING (voxel_id) GROUP BY ray_id) USING (ray_id)),
f AS MATERIALIZED (SELECT p.view, p.v, o.u, sum(p.value * CASE WHEN o.u = p.u THEN 0.25 WHEN (o.u - p.u) % 2 = 0 THEN 0.0 ELSE -1 / (pi() * pi() * (o.u - p.u) * (o.u - p.u)) END) / 1.6 AS value FROM b p, range(0, 16) o(u) GROUP BY p.view, p.v, o.u),
q AS (SELECT voxel_id, view, -4.5 + ix AS px, -4.5 + iy AS py, -1.5 + iz AS pz, a, sx, sy, sz FROM vox, geo),
t AS (SELECT *, -(px - sx) * sin(a) + (py - sy) * cos(a) AS depth, (px - sx) * cos(a) + (py - sy) * sin(a) AS h FROM q),
s AS (SELECT voxel_id, view, depth, h * 120 / depth / 1.6 + 7.5 AS u, (pz - sz) * 120 / depth / 1.6 + 1.5 AS v FROM t)
SELECT s.voxel_id, {R('sum(3600 * 2 * pi() / 12 / (depth * depth) * f.value * (1 - abs(s.u - f.u)) * (1 - abs(s.v - f.v)))')} AS value
FROM s JOIN f ON f.view = s.view AND f.u BETWEEN floor(s.u) AND floor(s.u) + 1 AND f.v BETWEEN floor(s.v) AND floor(s.v) + 1 GROUP BY s.voxel_id"""


@query("fdk_reconstruct", FDK_SQL)
def _(spark, d):
    geometry = G.flat_geometry(spark, SCAN)
    _, b = data(spark, d)
    pixels = J.rays(geometry, SCAN).join(b, "ray_id").select("view", "v", "u", "value")
    return _volume(fdk.reconstruct(pixels, geometry, SCAN, GRID))


SHORT = Scan(views=9, nu=16, nv=4, du=1.6, dv=1.6, sid=60.0, sdd=120.0, start=0.1, per_turn=14)
_FAN, _COVER = math.atan(7.5 * 1.6 / 120.0), 9 * 2 * math.pi / 14
_Q = f"CASE WHEN be <= 0 THEN 0.0 WHEN be < 2 * ({_FAN} + ga) THEN pow(sin(pi() / 4 * be / ({_FAN} + ga)), 2) WHEN be <= pi() + 2 * ga THEN 1.0 WHEN be < pi() + 2 * {_FAN} THEN pow(sin(pi() / 4 * (pi() + 2 * {_FAN} - be) / ({_FAN} - ga)), 2) ELSE 0.0 END * {_COVER} / pi() * 2 * pi() / {_COVER}"
SHORT_SQL = FDK_SQL.replace(geo_sql(SCAN), geo_sql(SHORT)).replace(rays_sql(SCAN), rays_sql(SHORT)).replace("2 * pi() / 12", "2 * pi() / 14").replace("f AS MATERIALIZED", f"pk AS (SELECT view, v, u, value * {_Q} AS value FROM (SELECT *, view * 2 * pi() / 14 AS be, atan((u - 7.5) * 1.6 / 120.0) AS ga FROM b)), f AS MATERIALIZED").replace("FROM b p,", "FROM pk p,")


@query("fdk_short_scan", SHORT_SQL)
def _(spark, d):
    geometry = solve.settle(G.flat_geometry(spark, SHORT))
    matrix = J.siddon(J.rays(geometry, SHORT), GRID)
    b = J.forward(matrix, volume(spark, d, 10, 10, 4))
    pixels = J.rays(geometry, SHORT).join(b, "ray_id", "left").select("view", "v", "u", F.coalesce("value", F.lit(0.0)).alias("value"))
    return _volume(fdk.reconstruct(pixels, geometry, SHORT, GRID))


def _voxel_sql(nearest: bool) -> str:
    tail = "FROM s JOIN b f ON f.view = s.view AND "
    if nearest:
        return FDK_SQL[: FDK_SQL.index("SELECT s.voxel_id")] + f"SELECT s.voxel_id, {R('sum(f.value)')} AS value {tail} f.u = floor(s.u + 0.5) AND f.v = floor(s.v + 0.5) GROUP BY s.voxel_id"
    return FDK_SQL[: FDK_SQL.index("SELECT s.voxel_id")] + f"SELECT s.voxel_id, {R('sum(f.value * (1 - abs(s.u - f.u)) * (1 - abs(s.v - f.v)))')} AS value {tail} f.u BETWEEN floor(s.u) AND floor(s.u) + 1 AND f.v BETWEEN floor(s.v) AND floor(s.v) + 1 GROUP BY s.voxel_id"


for _nearest in (False, True):

    @query("voxel_back_nearest" if _nearest else "voxel_back_linear", _voxel_sql(_nearest))
    def _(spark, d, nearest=_nearest):
        geometry = G.flat_geometry(spark, SCAN)
        pixels = J.rays(geometry, SCAN).join(data(spark, d)[1], "ray_id").select("view", "v", "u", "value")
        frames = fdk.to_frames(fdk.preweight(pixels, SCAN), SCAN)
        return _volume(fdk.back_project(frames, geometry, SCAN, GRID, "none", nearest))


@query("fdk_packets_agree", "SELECT 0.0::double AS gap")
def _(spark, d):
    """Packets of five views added up against all views at once."""
    geometry = G.flat_geometry(spark, SCAN)
    _, b = data(spark, d)
    b = solve.settle(b)
    pixels = J.rays(geometry, SCAN).join(b, "ray_id", "left").select("view", "v", "u", F.coalesce("value", F.lit(0.0)).alias("value"))
    frames = solve.settle(fdk.filter_frames(fdk.to_frames(fdk.preweight(pixels, SCAN), SCAN), SCAN, "hann"))
    whole = fdk.back_project(frames, geometry, SCAN, GRID)
    parts = None
    for first in range(0, SCAN.views, 5):
        part = fdk.back_project(frames.where(F.col("view").between(first, first + 4)), geometry, SCAN, GRID)
        parts = part if parts is None else parts.unionByName(part)
    added = parts.groupBy("voxel_id").agg(F.sum("value").alias("value"))
    return whole.join(added.withColumnRenamed("value", "other"), "voxel_id").agg(tidy(F.max(F.abs(F.col("value") - F.col("other")))).alias("gap"))

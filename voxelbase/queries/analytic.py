"""Helical filtered back-projection and footprint projectors, on scans and volumes that the tables size."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voxelbase.functions.scalar import tidy
from voxelbase.functions.scratch import scratch_path, settle
from voxelbase.operators import footprint
from voxelbase.operators import geometry as G
from voxelbase.operators.geometry import Scan
from voxelbase.operators.projector import Grid
from voxelbase.plans import fdk, helical, orbit, xfdk
from voxelbase.sources import tables
from voxelbase.streaming import halo, protocol

from .recon import geo_sql

R = lambda e, n=6: f"(round({e}, {n}) + 0.0)"
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# A helical scan with a view for each row of embeddings: 4 rows of 16 channels; the volume is as tall as the scan.
TURN, RISE = 32, 1.6


def helix(views: int, down: bool = False) -> tuple[Scan, Grid]:
    scan = Scan(views=views, nu=16, nv=4, du=1.6, dv=1.6, sid=60.0, sdd=120.0, per_turn=TURN, start=0.3, pitch=RISE if down else -RISE, offset=(0.0, 0.0, 0.0))
    nz = max(1, math.floor(views / TURN * RISE))
    return scan, Grid(8, 8, nz, (1.0, 1.0, 1.0), (0.5, -0.25, (-1 if down else 1) * nz / 2))


def helix_frames(spark, d):
    return tables.frames(spark, d).select("view", "data")


def _helix_sql(down: bool = False) -> str:
    """Parallel views (view, v, p, value) of all embeddings; n: views, half turns, views cut at the start, planes."""
    fan = math.atan(7.5 * 1.6 / 120.0) / 7.5
    lead = 10 + int(fan * 8 * TURN / (2 * math.pi))
    return f"""c AS (SELECT *, {lead} + (n - {2 * lead} - views) // 2 AS cut, greatest(1, floor(n * {RISE} / {TURN}))::bigint AS nz, {'-' if down else ''}{RISE} AS climb FROM (SELECT count(*) AS n, (count(*) - {2 * lead}) // {TURN // 2} * {TURN // 2} AS views FROM embeddings)),
e AS (SELECT vec_id AS view, i // 16 AS v, i % 16 AS u, abs(embedding[i + 1]::double) AS value FROM embeddings, range(0, 64) q(i)),
ac AS (SELECT k, least(15.0, greatest(0.0, 7.5 + 120.0 * tan((k - 7.5) * {fan}) / 1.6)) AS pos FROM range(0, 16) q(k)),
arc AS MATERIALIZED (SELECT view, v, k, sum(value * (1 - abs(pos - u))) AS value FROM e JOIN ac ON abs(pos - u) < 1 GROUP BY view, v, k),
ta AS (SELECT p, asin((p - 15.0) * {fan / 2}) / {fan} + 7.5 AS ch FROM range(0, 32) q(p)),
t2 AS (SELECT p, least(floor(ch) + j, 15)::bigint AS k, CASE j WHEN 0 THEN 1 - (ch - floor(ch)) ELSE ch - floor(ch) END AS wk FROM ta, range(0, 2) q(j) WHERE ch BETWEEN 0 AND 15),
t3 AS (SELECT p, k, wk, (k - 7.5) * {fan} * {TURN} / (2 * pi()) AS late FROM t2),
t4 AS (SELECT p, k, (floor(late) + m)::bigint AS after, wk * CASE m WHEN 0 THEN 1 - (late - floor(late)) ELSE late - floor(late) END AS weight FROM t3, range(0, 2) q(m)),
z0 AS (SELECT t.view, v, p FROM c, range(0, 100000) t(view), range(0, 4) a(v), range(0, 32) b(p) WHERE t.view < views),
rb AS MATERIALIZED (SELECT z0.view, z0.v, z0.p, coalesce(x.value, 0.0) AS value FROM z0 LEFT JOIN (SELECT arc.view - c.cut - after AS view, v, p, sum(weight * value) AS value FROM c, t4 JOIN arc USING (k) GROUP BY 1, 2, 3) x USING (view, v, p))"""


def _wfbp_sql(down: bool = False) -> str:
    fan = math.atan(7.5 * 1.6 / 120.0) / 7.5
    return f"""WITH {_helix_sql(down)},
f AS MATERIALIZED (SELECT r.view, r.v, o.p, sum(r.value * CASE WHEN o.p = r.p THEN 0.25 WHEN (o.p - r.p) % 2 = 0 THEN 0.0 ELSE -1 / (pi() * pi() * (o.p - r.p) * (o.p - r.p)) END) / {30 * fan} AS value FROM rb r, range(0, 32) o(p) GROUP BY r.view, r.v, o.p),
vx AS (SELECT id AS voxel_id, -3.0 + id % 8 AS x, -3.75 + id // 8 % 8 AS y, {'-nz' if down else '0'} + 0.5 + id // 64 AS z, views, cut, climb FROM c, range(0, 10000000) t(id) WHERE id < nz * 64),
g AS (SELECT voxel_id, t.view, x, y, z, climb, 0.3 + (cut + t.view) * 2 * pi() / {TURN} AS th, climb * (cut + t.view) / {TURN} AS tz FROM vx, range(0, 100000) t(view) WHERE t.view < views AND abs(z - climb * (cut + t.view) / {TURN}) < 4),
h AS (SELECT *, x * cos(th) + y * sin(th) AS pp, y * cos(th) - x * sin(th) AS al FROM g),
q AS (SELECT voxel_id, view, pp, (z - tz - climb * asin(pp / 60.0) / (2 * pi())) / ((sqrt(3600 - pp * pp) + al) * 0.02) AS q FROM h),
w AS (SELECT voxel_id, view, pp / {30 * fan} + 15 AS ch, 1.5 + 1.5 * q AS row, CASE WHEN abs(q) < 0.6 THEN 1.0 ELSE pow(cos(pi() / 2 * (abs(q) - 0.6) / 0.4), 2) END AS w FROM q WHERE abs(q) < 1),
s AS (SELECT w.voxel_id, w.view, any_value(w) AS w, sum(f.value * (1 - abs(row - f.v)) * (1 - abs(ch - f.p))) AS value FROM w JOIN f ON f.view = w.view AND f.v BETWEEN floor(row) AND floor(row) + 1 AND f.p BETWEEN floor(ch) AND floor(ch) + 1 GROUP BY w.voxel_id, w.view),
ph AS (SELECT voxel_id, sum(w * value) / sum(w) AS value FROM s GROUP BY voxel_id, view % {TURN // 2} HAVING sum(w) > 1e-6)
SELECT voxel_id, {R('coalesce(value, 0) * 2 * pi() / ' + str(TURN))} AS value FROM vx LEFT JOIN (SELECT voxel_id, sum(value) AS value FROM ph GROUP BY voxel_id) USING (voxel_id)"""


@query("parallel_rebin", f"WITH {_helix_sql()} SELECT view, v, p, {R('value')} AS value FROM rb")
def _(spark, d):
    scan, _ = helix(helix_frames(spark, d).count())
    rows = helical.parallel_rebin(helix_frames(spark, d), scan).select("view", F.posexplode("data").alias("i", "value"))
    return rows.select("view", F.floor(F.col("i") / 32).alias("v"), (F.col("i") % 32).cast("long").alias("p"), tidy(F.col("value")).alias("value"))


for _down in (False, True):

    @query("wfbp_helical_down" if _down else "wfbp_helical", _wfbp_sql(_down))
    def _(spark, d, down=_down):
        """The bed's other way turns the source's."""
        scan, grid = helix(helix_frames(spark, d).count(), down)
        return helical.reconstruct(helix_frames(spark, d), scan, grid).select("voxel_id", tidy(F.col("value")).alias("value"))


# Footprints: a voxel for each row of part, in planes of 10 x 10, in a volume of fixed height.
FOOT = Scan(views=12, nu=16, nv=8, du=1.6, dv=1.6, sid=60.0, sdd=120.0, start=0.1)


def part_volume(spark, d):
    """(voxel_id, value) with one voxel for each part, and the grid that holds them."""
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("long").alias("voxel_id"), (F.col("p_size") / 1000.0).alias("value"))
    nz = part.agg(F.max("voxel_id")).first()[0] // 100 + 1
    return part, Grid(10, 10, nz, (1.0, 1.0, 8.0 / nz))


FOOT_SQL = f"""{geo_sql(FOOT)}, nz AS (SELECT max(p_partkey) // 100 + 1 AS nz FROM part),
vo AS (SELECT id AS voxel_id, -4.5 + id % 10 AS x, -4.5 + id // 10 % 10 AS y, -4 + (id // 100 + 0.5) * 8.0 / nz AS z, 8.0 / nz AS sz FROM nz, range(0, 100000000) t(id) WHERE id < nz * 100),
k AS (SELECT voxel_id, view, cos(a) AS co, sin(a) AS si, vo.sz, x * cos(a) + y * sin(a) AS h, 60.0 - x * sin(a) + y * cos(a) AS de, z FROM vo, geo),
m AS (SELECT *, 75 * h / de + 7.5 AS u, 75 * z / de + 3.5 AS v, 75 * (co / de + h * si / (de * de)) AS du0, 75 * (si / de - h * co / (de * de)) AS du1, 75 * z * si / (de * de) AS dv0, -75 * z * co / (de * de) AS dv1, 75 / de AS dv2 FROM k),
b0 AS (SELECT *, (abs(du0) + abs(du1)) / 2 AS hu, (abs(dv0) + abs(dv1) + abs(dv2) * sz) / 2 AS hv, sqrt(pow(du1 * dv2, 2) + pow(du0 * dv2, 2) + pow(du0 * dv1 - du1 * dv0, 2)) AS ja FROM m),
am AS MATERIALIZED (SELECT voxel_id, view, pv, pu, sz * ja / (4 * hu * hv) * greatest(0, least(u + hu, pu + 0.5) - greatest(u - hu, pu - 0.5)) * greatest(0, least(v + hv, pv + 0.5) - greatest(v - hv, pv - 0.5)) AS weight
  FROM b0, range(0, 8) q(pv), range(0, 16) w(pu) WHERE abs(u - pu) < hu + 0.5 AND abs(v - pv) < hv + 0.5)"""
FOOT_FORWARD = f"WITH {FOOT_SQL}, fw AS (SELECT g.view, g.pv AS v, g.pu AS u, coalesce(s.value, 0.0) AS value FROM (SELECT view, pv, pu FROM range(0, 12) t(view), range(0, 8) q(pv), range(0, 16) w(pu)) g LEFT JOIN (SELECT view, pv, pu, sum(weight * p_size / 1000.0) AS value FROM am JOIN part ON p_partkey = voxel_id GROUP BY view, pv, pu) s USING (view, pv, pu))"


@query("footprint_forward", f"{FOOT_FORWARD} SELECT view, v, u, {R('value')} AS value FROM fw")
def _(spark, d):
    volume, grid = part_volume(spark, d)
    rows = footprint.forward(volume, G.flat_geometry(spark, FOOT), FOOT, grid).select("view", F.posexplode("data").alias("i", "value"))
    return rows.select("view", F.floor(F.col("i") / FOOT.nu).alias("v"), (F.col("i") % FOOT.nu).cast("long").alias("u"), tidy(F.col("value")).alias("value"))


@query("footprint_back", f"{FOOT_FORWARD} SELECT voxel_id, {R('coalesce(b.value, 0)', 5)} AS value FROM vo LEFT JOIN (SELECT voxel_id, sum(weight * value) AS value FROM (SELECT voxel_id, view, pv AS v, pu AS u, weight FROM am) JOIN fw USING (view, v, u) GROUP BY voxel_id) b USING (voxel_id)")
def _(spark, d):
    volume, grid = part_volume(spark, d)
    geometry = settle(G.flat_geometry(spark, FOOT))
    frames = settle(footprint.forward(volume, geometry, FOOT, grid))
    return footprint.back(frames, geometry, FOOT, grid).select("voxel_id", tidy(F.col("value"), 5).alias("value"))


@query("footprint_adjoint_gap", "SELECT 0.0::double AS gap, count(*) AS voxels FROM part")
def _(spark, d):
    """Relative gap of <Ax, y> and <x, Aty> with y = the frames' own pixels turned round, and how many voxels took part."""
    volume, grid = part_volume(spark, d)
    geometry = settle(G.flat_geometry(spark, FOOT))
    frames = settle(footprint.forward(volume, geometry, FOOT, grid).withColumn("y", F.reverse("data")))
    one = frames.agg(F.sum(F.aggregate(F.zip_with("data", "y", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)).alias("one"))
    other = footprint.back(frames.select("view", F.col("y").alias("data")), geometry, FOOT, grid).withColumnRenamed("value", "aty").join(volume, "voxel_id")
    two = other.agg(F.sum(F.col("aty") * F.col("value")).alias("two"), F.count(F.lit(1)).alias("voxels"))
    return one.join(two).select(F.round(F.abs(F.col("one") - F.col("two")) / F.abs(F.col("one")), 9).alias("gap"), "voxels")


# A full circle with a view for each row of embeddings.
CIRCLE_GRID = Grid(10, 10, 6, (1.0, 1.0, 1.0), (0.5, -0.25, 0.2))


def circle(views: int) -> Scan:
    return Scan(views=views, nu=16, nv=4, du=1.6, dv=1.6, sid=60.0, sdd=120.0, start=0.3)


_BETA, _GAMMA = math.atan(7.5 * 1.6 / 120.0), math.atan(1.5 * 1.6 / 120.0)
_EDGE = 60.0 * math.sin(_BETA)
_SPACE, _COT, _WIDE = 2 * _EDGE / 15, 1 / math.tan(_GAMMA), _EDGE**2 / 120.0
XFDK_SQL = f"""WITH c AS (SELECT count(*) AS n FROM embeddings),
e AS (SELECT vec_id AS view, i // 16 AS v, i % 16 AS u, abs(embedding[i + 1]::double) AS value FROM embeddings, range(0, 64) q(i)),
b AS (SELECT j, asin(least(1.0, greatest(-1.0, ({_EDGE} - j * {_SPACE}) / 60.0))) AS be FROM range(0, 16) q(j)),
pl AS (SELECT i, j, -120.0 * tan(be) / 1.6 + 7.5 AS uc, 120.0 * tan(i * {2 * _GAMMA / 3} - {_GAMMA}) / (cos(be) * 1.6) + 1.5 AS vc, cos(be) * cos(i * {2 * _GAMMA / 3} - {_GAMMA}) AS co FROM b, range(0, 4) q(i)),
sm AS MATERIALIZED (SELECT e.view, i, j, sum(co * value * (1 - abs(uc - u)) * (1 - abs(vc - v))) AS value FROM pl JOIN e ON u BETWEEN floor(uc) AND floor(uc) + 1 AND v BETWEEN floor(vc) AND floor(vc) + 1 GROUP BY e.view, i, j),
la AS (SELECT j, -be * n / (2 * pi()) AS late, n FROM b, c),
rb AS MATERIALIZED (SELECT t.view, sm.i, sm.j, sum(sm.value * CASE m WHEN 0 THEN 1 - (late - floor(late)) ELSE late - floor(late) END) AS value
  FROM la, range(0, 2) q(m), range(0, 100000) t(view) JOIN sm ON sm.view = (((t.view + floor(late)::bigint + m) % n) + n) % n AND sm.j = la.j WHERE t.view < n GROUP BY t.view, sm.i, sm.j),
f AS MATERIALIZED (SELECT p.view, p.i, o.j, sum(p.value * CASE WHEN o.j = p.j THEN 0.25 WHEN (o.j - p.j) % 2 = 0 THEN 0.0 ELSE -1 / (pi() * pi() * (o.j - p.j) * (o.j - p.j)) END) / {_SPACE} AS value FROM rb p, range(0, 16) o(j) GROUP BY p.view, p.i, o.j),
vx AS (SELECT id AS voxel_id, -4.0 + id % 10 AS x, -4.75 + id // 10 % 10 AS y, -2.3 + id // 100 AS z FROM range(0, 600) t(id)),
co AS (SELECT *, sqrt(x * x + y * y) AS r, atan2(-x, y) AS phi, {_COT} * abs(z) AS lost FROM vx),
cv AS (SELECT *, CASE WHEN r >= 60 OR lost > (3600 - r * r) / 60 + 0.00048 THEN -1.0 WHEN r <= 60 - lost THEN pi() / 2 ELSE least(pi() / 2, greatest(0.0, asin(least(1.0, greatest(-1.0, (60 - lost) / r))) - atan(sqrt(r * r - pow(60 - lost, 2)) / lost))) END AS room,
  least(1.0, greatest(-1.0, (r - (60 - lost - {_WIDE})) / {_WIDE})) AS bl FROM co),
g AS (SELECT cv.*, t.view, n, 0.3 + t.view * 2 * pi() / n AS th FROM cv, c, range(0, 100000) t(view) WHERE t.view < n),
h AS (SELECT *, x * cos(th) + y * sin(th) AS xi, sqrt(3600 - pow(x * cos(th) + y * sin(th), 2)) + y * cos(th) - x * sin(th) AS len, (th - phi + pi()) - 2 * pi() * floor((th - phi + pi()) / (2 * pi())) - pi() AS tu FROM g),
w AS (SELECT voxel_id, view, n, (xi + {_EDGE}) / {_SPACE} AS uc, (atan(z / len) + {_GAMMA}) / {2 * _GAMMA / 3} AS vc, (1 + sin(pi() / 2 * bl)) / 2 AS blend, room, tu FROM h WHERE abs(atan(z / len)) <= {_GAMMA} AND room >= 0),
k AS (SELECT *, 1 - blend + blend * CASE WHEN room <= 1e-7 THEN CASE WHEN tu >= -pi() / 2 AND tu < pi() / 2 THEN 2.0 ELSE 0.0 END
  ELSE sin(pi() / 2 * least(1.0, greatest(-1.0, (tu + pi() / 2) / room))) - sin(pi() / 2 * least(1.0, greatest(-1.0, (tu - pi() / 2) / room))) END AS weight FROM w),
s AS (SELECT k.voxel_id, sum(pi() / n * weight * value * (1 - abs(uc - f.j)) * (1 - abs(vc - f.i))) AS value FROM k JOIN f ON f.view = k.view AND f.j BETWEEN floor(uc) AND floor(uc) + 1 AND f.i BETWEEN floor(vc) AND floor(vc) + 1 GROUP BY k.voxel_id)
SELECT voxel_id, {R('coalesce(s.value, 0.0)')} AS value FROM vx LEFT JOIN s USING (voxel_id)"""


@query("xfdk_reconstruct", XFDK_SQL)
def _(spark, d):
    frames = helix_frames(spark, d)
    return xfdk.reconstruct(frames, circle(frames.count()), CIRCLE_GRID).select("voxel_id", tidy(F.col("value")).alias("value"))


@query("xfdk_stream", XFDK_SQL)
def _(spark, d):
    """The same frames, in packets by a stream with a restart: half of them, then the rest from the checkpoint."""
    frames = helix_frames(spark, d)
    scan, path = circle(frames.count()), scratch_path(spark, "xfdk")
    for part in (0, 1):
        frames.where(F.floor(F.col("view") * 2 / scan.views) == part).repartitionByRange(3, "view").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
        targets = halo.gathered(xfdk.resampled(stream, scan), xfdk.gather_of(scan))
        halo.reconstruct(targets, lambda b: xfdk.back_project(xfdk.filtered(b, scan), scan, CIRCLE_GRID), f"{path}/parts", f"{path}/checkpoint")
    voxels = CIRCLE_GRID.voxels(spark).select("voxel_id").join(halo.volume(spark, f"{path}/parts"), "voxel_id", "left")
    return voxels.select("voxel_id", tidy(F.coalesce("value", F.lit(0.0))).alias("value"))


# A source on its own circle above a still detector of 8 x 8 pixels, and a circle with a tilted axis: a view for each row of embeddings.
STILL, WINDOW, ORBIT_GRID = Scan(views=1, nu=8, nv=8, du=2.0, dv=2.0, sid=60.0, sdd=100.0), Scan(views=1, nu=5, nv=5, du=2.0, dv=2.0, sid=60.0, sdd=100.0), Grid(5, 6, 3, (0.9, 0.8, 0.7), (0.2, -0.3, 0.1))
_RADIUS, _HEIGHT, _BELOW = 4.0, 45.0, 40.0
_CX, _CY, _CZ = ORBIT_GRID.centre


def _still(spark, d):
    frames = helix_frames(spark, d)
    scan = Scan(**(STILL.__dict__ | {"views": frames.count(), "start": 0.3}))
    geometry = G.source_orbit(spark, scan, _RADIUS, _HEIGHT).withColumns({"origin_u": (F.col("view") % 2 + 1).cast("double"), "origin_v": F.lit(1.0)})
    return frames, geometry, scan


_VOXELS = f"vx AS (SELECT id AS voxel_id, {_CX} + (id % 5 - 2) * 0.9 AS x, {_CY} + (id // 5 % 6 - 2.5) * 0.8 AS y, {_CZ} + (id // 30 - 1) * 0.7 AS z FROM range(0, 90) t(id))"
ORBIT_SQL = f"""WITH c AS (SELECT count(*) AS n FROM embeddings),
e AS (SELECT vec_id AS view, i // 8 AS v, i % 8 AS u, abs(embedding[i + 1]::double) AS value FROM embeddings, range(0, 64) q(i)),
g AS (SELECT view, n, a, {_RADIUS} * cos(a) AS sx, {_RADIUS} * sin(a) AS sy, view * 2 * pi() / n AS de, view % 2 + 3.0 AS mu FROM (SELECT t.view, n, 0.3 + t.view * 2 * pi() / n AS a FROM c, range(0, 100000) t(view) WHERE t.view < n)),
pl AS (SELECT g.*, u, v, mu + (u - 2) * cos(de) - (v - 2) * sin(de) AS rx, 3.0 + (u - 2) * sin(de) + (v - 2) * cos(de) AS ry FROM g, range(0, 5) q(u), range(0, 5) w(v)),
ra AS (SELECT view, {_CX} - sx AS ax, {_CY} - sy AS ay, {_CZ - _HEIGHT} AS az, sqrt(pow({_CX} - sx, 2) + pow({_CY} - sy, 2) + {(_CZ - _HEIGHT) ** 2}) AS s FROM g),
sm AS MATERIALIZED (SELECT pl.view, pl.u, pl.v, sum(e.value * (1 - abs(rx - e.u)) * (1 - abs(ry - e.v))) * any_value(pow(s * {(_HEIGHT + _BELOW) / (_HEIGHT - _CZ)}, 2) / (2 * s) / sqrt(pow((rx - 3.5) * 2 - sx, 2) + pow((ry - 3.5) * 2 - sy, 2) + {(_HEIGHT + _BELOW) ** 2})) AS value
  FROM pl JOIN ra USING (view) JOIN e ON e.view = pl.view AND e.u BETWEEN floor(rx) AND floor(rx) + 1 AND e.v BETWEEN floor(ry) AND floor(ry) + 1 GROUP BY pl.view, pl.u, pl.v),
f AS MATERIALIZED (SELECT p.view, p.v, o.u, sum(p.value * CASE WHEN o.u = p.u THEN 0.25 WHEN (o.u - p.u) % 2 = 0 THEN 0.0 ELSE -1 / (pi() * pi() * (o.u - p.u) * (o.u - p.u)) END) / 2.0 AS value FROM sm p, range(0, 5) o(u) GROUP BY p.view, p.v, o.u),
{_VOXELS},
k AS (SELECT voxel_id, g.*, (sx + {_HEIGHT + _BELOW} / ({_HEIGHT} - z) * (x - sx)) / 2 + 3.5 - mu AS px, (sy + {_HEIGHT + _BELOW} / ({_HEIGHT} - z) * (y - sy)) / 2 + 3.5 - 3 AS py, pow(s, 4) * 2 * pi() / n / pow((x - sx) * ax + (y - sy) * ay + (z - {_HEIGHT}) * az, 2) AS weight FROM vx, g JOIN ra USING (view)),
s AS (SELECT voxel_id, view, weight, px * cos(de) + py * sin(de) + 2 AS uc, py * cos(de) - px * sin(de) + 2 AS vc FROM k),
t AS (SELECT voxel_id, sum(weight * value * (1 - abs(uc - f.u)) * (1 - abs(vc - f.v))) AS value FROM s JOIN f ON f.view = s.view AND f.u BETWEEN floor(uc) AND floor(uc) + 1 AND f.v BETWEEN floor(vc) AND floor(vc) + 1 GROUP BY voxel_id)
SELECT voxel_id, {R('coalesce(t.value, 0.0)')} AS value FROM vx LEFT JOIN t USING (voxel_id)"""


def _voxels(rows):
    return rows.select("voxel_id", tidy(F.col("value")).alias("value"))


@query("source_orbit_fdk", ORBIT_SQL)
def _(spark, d):
    frames, geometry, scan = _still(spark, d)
    return _voxels(orbit.source_orbit(frames, geometry, scan, WINDOW, ORBIT_GRID))


_TILT = 0.2
_TC, _TS = math.cos(_TILT), math.sin(_TILT)
# The tilted scan seen from its own axis: a plain circle around voxels turned back, its reference ray aimed at the turned centre.
TILTED_SQL = f"""WITH c AS (SELECT count(*) AS n FROM embeddings),
e AS (SELECT vec_id AS view, i // 16 AS v, i % 16 AS u, abs(embedding[i + 1]::double) AS value FROM embeddings, range(0, 64) q(i)),
g AS (SELECT view, n, a, 60 * sin(a) AS sx, -60 * cos(a) AS sy FROM (SELECT t.view, n, 0.3 + t.view * 2 * pi() / n AS a FROM c, range(0, 100000) t(view) WHERE t.view < n)),
ra AS (SELECT *, {_CX} - sx AS ax, {_TC * _CY + _TS * _CZ} - sy AS ay, {_TC * _CZ - _TS * _CY} AS az FROM g),
rb AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS s, 120.0 / (ay * cos(a) - ax * sin(a)) AS far FROM ra),
sm AS MATERIALIZED (SELECT view, v, u, value * pow(s * far, 2) / (2 * s) / sqrt(pow((u - 7.5) * 1.6, 2) + pow((v - 1.5) * 1.6, 2) + 14400) AS value FROM e JOIN rb USING (view)),
f AS MATERIALIZED (SELECT p.view, p.v, o.u, sum(p.value * CASE WHEN o.u = p.u THEN 0.25 WHEN (o.u - p.u) % 2 = 0 THEN 0.0 ELSE -1 / (pi() * pi() * (o.u - p.u) * (o.u - p.u)) END) / 1.6 AS value FROM sm p, range(0, 16) o(u) GROUP BY p.view, p.v, o.u),
{_VOXELS},
k AS (SELECT voxel_id, view, s, n, a, ax, ay, az, x - sx AS qx, {_TC} * y + {_TS} * z - sy AS qy, {_TC} * z - {_TS} * y AS qz FROM vx, rb),
s AS (SELECT voxel_id, view, (qx * cos(a) + qy * sin(a)) / (qy * cos(a) - qx * sin(a)) * 75 + 7.5 AS uc, qz / (qy * cos(a) - qx * sin(a)) * 75 + 1.5 AS vc, pow(s, 4) * 2 * pi() / n / pow(qx * ax + qy * ay + qz * az, 2) AS weight FROM k),
t AS (SELECT voxel_id, sum(weight * value * (1 - abs(uc - f.u)) * (1 - abs(vc - f.v))) AS value FROM s JOIN f ON f.view = s.view AND f.u BETWEEN floor(uc) AND floor(uc) + 1 AND f.v BETWEEN floor(vc) AND floor(vc) + 1 GROUP BY voxel_id)
SELECT voxel_id, {R('coalesce(t.value, 0.0)')} AS value FROM vx LEFT JOIN t USING (voxel_id)"""


@query("tilted_fdk", TILTED_SQL)
def _(spark, d):
    frames = helix_frames(spark, d)
    scan = circle(frames.count())
    return _voxels(orbit.reconstruct(frames, G.tilted_axis(spark, scan, _TILT), scan, ORBIT_GRID))


@query("tilted_stream", TILTED_SQL)
def _(spark, d):
    """The tilted scan as packets of 37 views: a first attempt fails on a packet out of order and is cancelled, the second is completed."""
    frames = helix_frames(spark, d)
    scan, path = circle(frames.count()), scratch_path(spark, "protocol")
    geometry = settle(G.tilted_axis(spark, scan, _TILT))
    packet = F.floor(F.col("view") / 37)
    packets = frames.groupBy(packet.alias("k")).agg(F.array_sort(F.collect_list(F.struct("view", "data"))).alias("frames"), F.min("view").alias("first_view"))
    rows = lambda first: packets.select(F.lit("tilted").alias("scan"), (F.col("k") + first).alias("seq"), F.lit("packet").alias("op"), "first_view", "frames")
    order = lambda *ops: spark.createDataFrame([("tilted", seq, op, None, None) for seq, op in ops], protocol.COMMANDS)
    last = 1_000_000
    parts = [order((0, "begin")).unionByName(rows(1).where("k < 2")).unionByName(rows(2).where("k = 3")), order((10, "cancel"), (11, "begin")), rows(12).where("k < 5"), rows(12).where("k >= 5").unionByName(order((last, "complete")))]
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(protocol.COMMANDS).parquet(f"{path}/in")
        protocol.run(stream, scan.views, scan.nu * scan.nv, lambda b: fdk.back_project(orbit.filtered(b, geometry, scan.nu, scan.nv, ORBIT_GRID.centre), geometry, scan, ORBIT_GRID, "radial"), path)
    return _voxels(protocol.volumes(spark, path))

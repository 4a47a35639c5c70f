"""Filters of the frames as 8 x 8 images, one above another as a volume, and what is found in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelbase.functions.scalar import tidy
from voxelbase.operators import tiles as T
from voxelbase.operators.neighbour import gaussian_kernel, mean_kernel
from voxelbase.sources.tables import frames

from .pointwise import PX

R = lambda e, n=6: f"(round({e}, {n}) + 0.0)"
QUERIES, ORACLES = {}, {}
N = 8
VOX = f"{PX}, v AS (SELECT view AS z, u // 8 AS y, u % 8 AS x, value FROM px), hi AS (SELECT max(z) AS m FROM v)"


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def planes(spark, d):
    return frames(spark, d).select(F.col("view").alias("z"), "data")


def _long(rows, digits=6):
    i = F.col("i")
    rows = rows.select("z", F.posexplode("data").alias("i", "value"))
    return rows.select("z", F.floor(i / N).alias("y"), (i % N).cast("long").alias("x"), tidy(F.col("value"), digits).alias("value"))


def near(radius: int, flat: bool, table: str = "v", cols: str = "q.value") -> str:
    """Every voxel p with the voxels q of its window, border replicated, at offsets a, b, c."""
    z = "q.z = p.z" if flat else "q.z = least(greatest(p.z + c, 0), hi.m)"
    c = "(SELECT 0 AS c)" if flat else f"(SELECT c FROM range({-radius}, {radius + 1}) t(c))"
    return f"(SELECT p.z, p.y, p.x, p.value AS own, a, b, c, {cols} FROM hi, v p, range({-radius}, {radius + 1}) s(a), range({-radius}, {radius + 1}) r(b), {c} JOIN {table} q ON {z} AND q.y = least(greatest(p.y + b, 0), 7) AND q.x = least(greatest(p.x + a, 0), 7))"


def _sql(weight: str, radius: int, flat: bool) -> str:
    return f"WITH {VOX}, w AS (SELECT z, y, x, value, {weight} AS w FROM {near(radius, flat)}) SELECT z, y, x, {R('sum(w * value) / sum(w)')} AS value FROM w GROUP BY z, y, x"


def _guided_sql(flat: bool) -> str:
    return f"""WITH {VOX}, m AS (SELECT z, y, x, avg(value) AS m, avg(value * value) AS s FROM {near(1, flat)} GROUP BY z, y, x), ab AS (SELECT z, y, x, greatest(s - m * m, 0) / (greatest(s - m * m, 0) + 0.01) AS a0, m FROM m),
av AS (SELECT z, y, x, any_value(own) AS own, avg(a0) AS a, avg((1 - a0) * m) AS b FROM {near(1, flat, 'ab', 'q.a0, q.m')} GROUP BY z, y, x) SELECT z, y, x, {R('own * a + b')} AS value FROM av"""


for _flat in (False, True):
    _tail = "_2d" if _flat else ""
    _h = 0 if _flat else 1

    @query(f"mean_filter{_tail}", _sql("1", 1, _flat))
    def _(spark, d, flat=_flat, h=_h):
        return _long(T.map_tiles(planes(spark, d), N, N, h, T.separable(mean_kernel(1), flat)))

    @query(f"gaussian_filter{_tail}", _sql("exp(-(a * a + b * b + c * c) / 1.28)", 1, _flat))
    def _(spark, d, flat=_flat, h=_h):
        return _long(T.map_tiles(planes(spark, d), N, N, h, T.separable(gaussian_kernel(0.8, 1), flat)))

    @query(f"bilateral_filter{_tail}", _sql("exp(-(a * a + b * b + c * c) / 4.5) * exp(-(value - own) * (value - own) / 0.02)", 1, _flat))
    def _(spark, d, flat=_flat, h=_h):
        return _long(T.map_tiles(planes(spark, d), N, N, h, T.bilateral(1, 1.5, 0.1, flat)))

    @query(f"guided_filter{_tail}", _guided_sql(_flat))
    def _(spark, d, flat=_flat, h=_h):
        return _long(T.map_tiles(planes(spark, d), N, N, 2 * h, T.guided(1, 0.01, flat)))


@query("peaks_2d", f"WITH {VOX}, w AS (SELECT z, y, x, any_value(own) AS own, max(value) AS top FROM {near(1, True)} GROUP BY z, y, x) SELECT z, y, x FROM w WHERE own >= 0.2 AND own >= top")
def _(spark, d):
    return T.local_maxima(planes(spark, d), N, N, 0.2)


@query("distance_transform_2d", f"WITH {VOX} SELECT p.z, p.y, p.x, min((p.y - q.y) ** 2 + (p.x - q.x) ** 2)::double AS value FROM v p JOIN v q ON q.z = p.z AND q.value > 0.25 GROUP BY p.z, p.y, p.x")
def _(spark, d):
    return _long(T.squared_distance(planes(spark, d), N, N, 0.25)).where(F.col("value") < float("inf"))


COMPONENTS = f"""WITH RECURSIVE {VOX}, h AS (SELECT z, y, x, y * 8 + x AS i, value FROM v WHERE value > 0.15), e AS (SELECT p.z, p.i, q.i AS j FROM h p JOIN h q ON q.z = p.z AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1),
r AS (SELECT z, i, i AS j FROM h UNION SELECT r.z, r.i, e.j FROM r JOIN e ON e.z = r.z AND e.i = r.j), c AS (SELECT z, i, min(j) AS component FROM r GROUP BY z, i)
SELECT z, component, count(*) AS area, {R('sum(greatest(value - 0.15, 1e-6) * y) / sum(greatest(value - 0.15, 1e-6))')} AS y, {R('sum(greatest(value - 0.15, 1e-6) * x) / sum(greatest(value - 0.15, 1e-6))')} AS x FROM c JOIN h USING (z, i) GROUP BY z, component HAVING count(*) >= 3"""


@query("components_2d", COMPONENTS)
def _(spark, d):
    rows = T.components(planes(spark, d), N, N, 0.15, 3)
    return rows.select("z", "component", "area", tidy(F.col("weight_y")).alias("y"), tidy(F.col("weight_x")).alias("x"))


@query("mean_over_z", f"WITH {VOX} SELECT y, x, {R('avg(value)')} AS value FROM v GROUP BY y, x")
def _(spark, d):
    return _long(planes(spark, d), 12).groupBy("y", "x").agg(tidy(F.avg("value")).alias("value"))


@query("display_window", f"WITH {VOX} SELECT {R('min(value)')} AS low, {R('max(value)')} AS high, count(*) AS n FROM v WHERE isfinite(value)")
def _(spark, d):
    rows = _long(planes(spark, d), 12).where(~F.isnan("value") & (F.abs("value") < float("inf")))
    return rows.agg(tidy(F.min("value")).alias("low"), tidy(F.max("value")).alias("high"), F.count(F.lit(1)).alias("n"))


@query("slopes_3d", f"WITH {VOX} SELECT p.z, p.y, p.x, {R('coalesce(a.value - p.value, 0)')} AS gx, {R('coalesce(b.value - p.value, 0)')} AS gy, {R('coalesce(c.value - p.value, 0)')} AS gz FROM v p LEFT JOIN v a ON a.z = p.z AND a.y = p.y AND a.x = p.x + 1 LEFT JOIN v b ON b.z = p.z AND b.y = p.y + 1 AND b.x = p.x LEFT JOIN v c ON c.z = p.z + 1 AND c.y = p.y AND c.x = p.x")
def _(spark, d):
    from voxelbase.operators.projector import Grid
    from voxelbase.plans.solve import slopes

    rows = planes(spark, d).select("z", F.posexplode("data").alias("i", "value")).select((F.col("z") * N * N + F.col("i")).alias("voxel_id"), "value")
    top = rows.agg(F.max("voxel_id")).first()[0] or 0
    i = F.col("voxel_id")
    out = slopes(rows, Grid(N, N, top // (N * N) + 1))
    return out.select(F.floor(i / (N * N)).alias("z"), (F.floor(i / N) % N).alias("y"), (i % N).alias("x"), *(tidy(F.col(c)).alias(c) for c in ("gx", "gy", "gz")))

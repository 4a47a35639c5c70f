"""Small figures: samples in volumes, integrals, error moments, candidates, stopping rules, normalised fits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxelbase.functions import scalar as S
from voxelbase.functions.scalar import tidy
from voxelbase.operators import lookup as L
from voxelbase.operators import measure as M
from voxelbase.operators import pointwise as P
from voxelbase.operators import select as O
from voxelbase.sources.tables import AIR, frames, pixels, volume

from .pointwise import PX

R = lambda e, n=6: f"(round({e}, {n}) + 0.0)"
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("display_log", f"WITH {PX} SELECT view, u, {R(f'-ln(greatest(value / greatest({AIR}, 1e-30), 1e-30))')} AS p FROM px")
def _(spark, d):
    return pixels(spark, d).select("view", "u", tidy(P.display_log(F.col("value"), F.lit(AIR))).alias("p"))


@query("finite_frames", f"WITH {PX} SELECT view, count(*) AS n, sum(CASE WHEN isfinite(ln(value - 0.01)) THEN 0 ELSE 1 END)::bigint AS odd FROM (SELECT view, u, greatest(value, 0.02) AS value FROM px) GROUP BY view")
def _(spark, d):
    rows = pixels(spark, d).select("view", F.log(F.greatest(F.col("value"), F.lit(0.02)) - 0.01).alias("x"))
    return rows.groupBy("view").agg(F.count(F.lit(1)).alias("n"), F.count_if(~S.is_finite(F.col("x"))).alias("odd"))


@query("log_linear_lookup", f"WITH {PX}, k(a, b, p, q) AS (VALUES (0.0, 0.1, 4.0, 1.5), (0.1, 0.3, 1.5, 0.4), (0.3, 0.6, 0.4, 0.05)) SELECT view, u, {R('exp(ln(p) + (least(value, 0.599999) - a) / (b - a) * (ln(q) - ln(p)))')} AS mu FROM px JOIN k ON least(value, 0.599999) >= a AND least(value, 0.599999) < b")
def _(spark, d):
    x = F.least(F.col("value"), F.lit(0.599999))
    return pixels(spark, d).select("view", "u", tidy(L.log_linear(x, [(0.0, 4.0), (0.1, 1.5), (0.3, 0.4), (0.6, 0.05)])).alias("mu"))


@query("simpson_integral", f"WITH {PX} SELECT view, {R('sum(value * CASE WHEN u = 0 OR u = 62 THEN 1 WHEN u % 2 = 1 THEN 4 ELSE 2 END) * 0.5 / 3')} AS integral FROM px WHERE u <= 62 GROUP BY view")
def _(spark, d):
    return frames(spark, d).select("view", tidy(S.simpson(F.slice("data", 1, 63), 0.5)).alias("integral"))


@query("world_to_voxel", f"WITH p AS (SELECT c_custkey AS k, c_acctbal / 1000 AS x, c_custkey % 11 - 5.5 AS y, c_nationkey / 10.0 AS z FROM customer) SELECT k, {R('(x + 5.0) / 1.0 - 0.5')} AS i, {R('(y + 5.0) / 1.0 - 0.5')} AS j, {R('(z + 2.0) / 1.0 - 0.5')} AS k3 FROM p")
def _(spark, d):
    from .recon import GRID

    c = F.col("c_custkey")
    p = F.struct((F.col("c_acctbal") / 1000).alias("x"), (c % 11 - 5.5).alias("y"), (F.col("c_nationkey") / 10.0).alias("z"))
    i = S.voxel_place(p, GRID)
    return spark.read.parquet(f"{d}/customer.parquet").select(c.alias("k"), *(tidy(e).alias(n) for e, n in zip(i, ("i", "j", "k3"), strict=True)))


TRILINEAR = f"""WITH x AS (SELECT i % 10 AS ix, (i // 10) % 10 AS iy, i // 100 AS iz, value FROM (SELECT p_partkey % 400 AS i, avg(p_size) / 1000.0 AS value FROM part GROUP BY 1)),
q AS (SELECT c_custkey AS k, (c_custkey % 23) / 2.0 - 0.7 AS a, (c_custkey % 19) / 2.0 - 0.3 AS b, (c_custkey % 7) / 1.5 - 0.4 AS c FROM customer)
SELECT k, {R('coalesce(sum(value * (1 - abs(a - ix)) * (1 - abs(b - iy)) * (1 - abs(c - iz))), 0)')} AS value FROM q LEFT JOIN x ON ix BETWEEN floor(a) AND floor(a) + 1 AND iy BETWEEN floor(b) AND floor(b) + 1 AND iz BETWEEN floor(c) AND floor(c) + 1 GROUP BY k"""


@query("trilinear_samples", TRILINEAR)
def _(spark, d):
    from .recon import GRID

    k = F.col("c_custkey")
    points = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("k"), ((k % 23) / 2.0 - 0.7).alias("a"), ((k % 19) / 2.0 - 0.3).alias("b"), ((k % 7) / 1.5 - 0.4).alias("c"))
    return L.trilinear(points, volume(spark, d, 10, 10, 4), GRID).select("k", tidy(F.col("value")).alias("value"))


@query("error_moments", f"WITH {PX}, p AS (SELECT label, view * 64 + u AS id, value AS l, value * 0.01 + u * 1e-4 - 0.003 AS e FROM px) SELECT label, count(*) AS n, {R('avg(e)')} AS mean, {R('sqrt(avg(e * e))')} AS rmse, {R('sqrt(avg(l * l))')} AS level, {R('sqrt(avg(least(l - 0.1, 0) * least(l - 0.1, 0)))')} AS clipped, {R('sqrt(avg((e - l) * (e - l)))')} AS difference, arg_max(id, (abs(e), -id)) AS worst_at FROM p GROUP BY label")
def _(spark, d):
    rows = pixels(spark, d).select("label", (F.col("view") * 64 + F.col("u")).alias("id"), F.col("value").alias("l"), (F.col("value") * 0.01 + F.col("u") * 1e-4 - 0.003).alias("e"))
    out = M.error_moments(rows, "label", F.col("e"), F.col("l"), F.col("l") - 0.1, F.col("id"))
    return out.select("label", "n", *(tidy(F.col(c)).alias(c) for c in ("mean", "rmse", "level", "clipped", "difference")), "worst_at")


@query("energy_merge", "SELECT DISTINCT energy FROM (SELECT p_size::double AS energy FROM part UNION ALL SELECT l_quantity / 2 FROM lineitem)")
def _(spark, d):
    a = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_size").cast("double").alias("energy"))
    return a.union(spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity") / 2)).distinct()


@query("best_candidates", f"SELECT l_partkey AS target, arg_min(l_orderkey * 8 + l_linenumber, (abs(l_discount - 0.05), l_orderkey * 8 + l_linenumber)) AS candidate, {R('min(abs(l_discount - 0.05))')} AS error FROM lineitem GROUP BY l_partkey")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("target"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("candidate"), F.abs(F.col("l_discount") - 0.05).alias("error"))
    return O.best(rows, "target", "candidate", "error").select("target", "candidate", tidy(F.col("error")).alias("error"))


@query("stop_ratio", f"WITH r AS (SELECT event_type AS run, event_id AS iteration, 1 + value AS mse FROM events), w AS (SELECT *, lag(mse, 3) OVER p AS old, least(mse, lag(mse, 1) OVER p, lag(mse, 2) OVER p) AS low FROM r WINDOW p AS (PARTITION BY run ORDER BY iteration)) SELECT run, iteration, {R('(old - low) / old')} AS gain FROM w WHERE old IS NOT NULL")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("run"), F.col("event_id").alias("iteration"), (1 + F.col("value")).alias("mse"))
    w = Window.partitionBy("run").orderBy("iteration")
    old, low = F.lag("mse", 3).over(w), F.least(F.col("mse"), F.lag("mse", 1).over(w), F.lag("mse", 2).over(w))
    return rows.select("run", "iteration", tidy((old - low) / old).alias("gain")).where("gain is not null")


@query("circle_fit_3d", None)
def _(spark, d):
    """The circle of the sources of a tilted orbit, one point an order line."""
    a = F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.lit(360)) * 0.0174532925199433
    x, y = 60.0 * F.cos(a), 60.0 * F.sin(a)
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select((x + 1.0).alias("x"), (0.8 * y - 2.0).alias("y"), (0.6 * y + 3.0).alias("z"))
    centre, normal, radius = M.circle_fit_3d(rows)
    names = ["cx", "cy", "cz", "nx", "ny", "nz", "r"]
    return spark.createDataFrame(list(zip(names, [*centre, *normal, radius], strict=True)), "term string, v double").select("term", tidy(F.col("v"), 4).alias("value"))


ORACLES["circle_fit_3d"] = "SELECT * FROM (VALUES ('cx', 1.0::double), ('cy', -2.0::double), ('cz', 3.0::double), ('nx', 0.0::double), ('ny', -0.6::double), ('nz', 0.8::double), ('r', 60.0::double)) t(term, value)"

"""Metrics, histograms, region reports, fits and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelbase.functions.scalar import tidy
from voxelbase.operators import measure as M
from voxelbase.sources.tables import pixels, volume

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


def _pairs(spark, d):
    return pixels(spark, d).select("label", "view", "u", F.col("value").alias("truth"), (F.col("value") * 1.01 + F.col("u") * 1e-4).alias("value"))


@query("quality_metrics", f"WITH {PX}, p AS (SELECT label, value AS t, value * 1.01 + u * 1e-4 AS v FROM px) SELECT label, count(*) AS n, {R('avg(v - t)')} AS bias, {R('sqrt(avg((v - t) * (v - t)))')} AS rmse, {R('sqrt(sum((v - t) * (v - t)) / sum(t * t))')} AS nrmse, {R('avg(abs(v - t))')} AS mae, {R('sum(t * v) / sqrt(sum(t * t) * sum(v * v))')} AS cosine, {R('max(abs(v - t))')} AS worst FROM p GROUP BY label")
def _(spark, d):
    q = M.quality(_pairs(spark, d), ["label"])
    return q.select("label", "n", *(tidy(F.col(c)).alias(c) for c in ("bias", "rmse", "nrmse", "mae", "cosine", "worst")))


@query("error_summary", f"WITH {PX}, p AS (SELECT label, value * 0.01 + u * 1e-4 AS e FROM px) SELECT label, count(*) AS n, {R('avg(e)')} AS bias, {R('quantile_cont(abs(e), 0.95)')} AS p95, {R('max(abs(e))')} AS worst FROM p GROUP BY label")
def _(spark, d):
    e = F.col("value") - F.col("truth")
    return _pairs(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), tidy(F.avg(e)).alias("bias"), tidy(F.percentile(F.abs(e), F.lit(0.95))).alias("p95"), tidy(F.max(F.abs(e))).alias("worst"))


@query("region_statistics", f"WITH {PX} SELECT label, count(*) AS n, {R('avg(value)')} AS mean, {R('stddev_pop(value)')} AS std, {R('min(value)')} AS low, {R('max(value)')} AS high FROM px WHERE label IN (1, 2, 3, 8) AND u BETWEEN 2 AND 61 GROUP BY label")
def _(spark, d):
    rows = pixels(spark, d).where(F.col("label").isin(1, 2, 3, 8) & F.col("u").between(2, 61))
    v = F.col("value")
    return rows.groupBy("label").agg(F.count(v).alias("n"), tidy(F.avg(v)).alias("mean"), tidy(F.stddev_pop(v)).alias("std"), tidy(F.min(v)).alias("low"), tidy(F.max(v)).alias("high"))


@query("roi_profile", f"WITH v AS (SELECT p_partkey % 400 AS i, avg(p_size) / 1000.0 AS value FROM part GROUP BY 1), z AS (SELECT i // 100 AS z, avg(value) AS m, count(*) AS n FROM v WHERE pow(i % 10 - 4.5, 2) + pow((i // 10) % 10 - 4.5, 2) <= 9 GROUP BY ALL) SELECT z, n, {R('m')} AS mean FROM z")
def _(spark, d):
    i = F.col("voxel_id")
    inside = F.pow(i % 10 - 4.5, 2.0) + F.pow(F.floor(i / 10) % 10 - 4.5, 2.0) <= 9
    return volume(spark, d, 10, 10, 4).where(inside).groupBy(F.floor(i / 100).alias("z")).agg(F.count(F.lit(1)).alias("n"), tidy(F.avg("value")).alias("mean"))


@query("thickness_histogram", f"WITH {PX} SELECT floor(value / 0.05)::int AS a, (u // 8)::int AS b, count(*) AS n, sum(CASE WHEN view % 5 <> 0 THEN 1 ELSE 0 END)::bigint AS training FROM px GROUP BY ALL")
def _(spark, d):
    return pixels(spark, d).groupBy(F.floor(F.col("value") / 0.05).cast("int").alias("a"), F.floor(F.col("u") / 8).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("view") % 5 != 0).cast("int")).alias("training"))


@query("track_marginals", f"WITH {PX}, o AS (SELECT * FROM px WHERE value > 0.3) SELECT 'view' AS kind, view AS id, count(*) AS n FROM o GROUP BY view UNION ALL SELECT 'target', u, count(*) FROM o GROUP BY u")
def _(spark, d):
    sets = pixels(spark, d).where("value > 0.3").groupingSets([["view"], ["u"]], "view", "u").agg(F.count(F.lit(1)).alias("n"))
    return sets.select(F.when(F.col("u").isNull(), "view").otherwise("target").alias("kind"), F.coalesce("view", "u").alias("id"), "n")


@query("weighted_centroid", f"WITH {PX} SELECT view, {R('sum(u * greatest(value - 0.1, 0)) / sum(greatest(value - 0.1, 0))', 5)} AS u, count(*) AS n FROM px WHERE value > 0.1 GROUP BY view")
def _(spark, d):
    w = F.greatest(F.col("value") - 0.1, F.lit(0.0))
    return pixels(spark, d).where("value > 0.1").groupBy("view").agg(tidy(F.sum(F.col("u") * w) / F.sum(w), 5).alias("u"), F.count(F.lit(1)).alias("n"))


@query("block_average", f"SELECT (i % 10) // 2 AS bx, ((i // 10) % 10) // 2 AS by, (i // 100) // 2 AS bz, {R('avg(s)')} AS value FROM (SELECT p_partkey % 400 AS i, avg(p_size) / 1000.0 AS s FROM part GROUP BY 1) GROUP BY ALL")
def _(spark, d):
    return M.block_average(volume(spark, d, 10, 10, 4), 10, 10, 2).select("bx", "by", "bz", tidy(F.col("value")).alias("value"))


@query("distance_transform", f"WITH {PX} SELECT p.view, p.u, min(abs(p.u - q.u))::int AS distance FROM px p JOIN px q ON q.view = p.view AND q.value > 0.3 GROUP BY p.view, p.u")
def _(spark, d):
    """Distance to the nearest pixel above a threshold along the row, by the nearest one before and behind."""
    from pyspark.sql import Window

    w = Window.partitionBy("view").orderBy("u")
    hit = F.when(F.col("value") > 0.3, F.col("u"))
    before = F.last(hit, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.first(hit, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = pixels(spark, d).select("view", "u", F.least(F.col("u") - before, behind - F.col("u")).alias("distance"))
    return rows.where("distance is not null")


ELEMENTS = [("H", 40.0, 0.346), ("O", 40.0, 0.2585), ("C", 40.0, 0.2076), ("H", 60.0, 0.326), ("O", 60.0, 0.1907), ("C", 60.0, 0.1753)]
FRACTIONS = [("water", "H", 0.1119), ("water", "O", 0.8881), ("fat", "H", 0.12), ("fat", "C", 0.6), ("fat", "O", 0.2)]


@query("material_mixture", f"WITH e(element, energy, mu) AS (VALUES {', '.join(map(str, ELEMENTS))}), f(material, element, fraction) AS (VALUES {', '.join(map(str, FRACTIONS))}), t AS (SELECT material, sum(fraction) AS t FROM f GROUP BY ALL) SELECT material, energy::double AS energy, {R('sum(fraction / t * mu)')} AS mu FROM f JOIN t USING (material) JOIN e USING (element) GROUP BY material, energy")
def _(spark, d):
    f, e = spark.createDataFrame(FRACTIONS, "material string, element string, fraction double"), spark.createDataFrame(ELEMENTS, "element string, energy double, mu double")
    return M.mixture(f, e).select("material", "energy", tidy(F.col("mu")).alias("mu"))


@query("spectrum_figures", f"WITH s AS (SELECT p_size AS energy, p_retailprice AS weight FROM part) SELECT {R('sum(weight)', 2)} AS photons, {R('sum(weight * energy)', 2)} AS energy_sum, {R('sum(weight * energy) / sum(weight)')} AS mean_energy FROM s")
def _(spark, d):
    s = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_size").alias("energy"), F.col("p_retailprice").alias("weight"))
    return M.spectrum_figures(s).select(tidy(F.col("photons"), 2).alias("photons"), tidy(F.col("energy_sum"), 2).alias("energy_sum"), tidy(F.col("mean_energy")).alias("mean_energy"))


@query("air_water_calibration", f"WITH {PX}, m AS (SELECT avg(CASE WHEN u < 16 THEN value END) AS a, avg(CASE WHEN u >= 48 THEN value + 0.5 END) AS w FROM px) SELECT {R('1000 / (w - a)', 4)} AS scale, {R('-1000 / (w - a) * w', 4)} AS offset_hu FROM m")
def _(spark, d):
    px = pixels(spark, d)
    s, o = M.air_water_calibration(px.where("u < 16"), px.where("u >= 48").withColumn("value", F.col("value") + 0.5))
    return spark.createDataFrame([(s, o)], "s double, o double").select(tidy(F.col("s"), 4).alias("scale"), tidy(F.col("o"), 4).alias("offset_hu"))


def _table(spark, names, values, digits=4):
    return spark.createDataFrame(list(zip(names, map(float, values), strict=True)), "term string, v double").select("term", tidy(F.col("v"), digits).alias("value"))


@query("water_bhc_fit", f"WITH {PX}, p AS (SELECT value AS x, 0.3 + 2 * value + u * 0.001 AS y FROM px) SELECT 'c0' AS term, {R('regr_intercept(y, x)', 4)} AS value FROM p UNION ALL SELECT 'c1', {R('regr_slope(y, x)', 4)} FROM p")
def _(spark, d):
    rows = pixels(spark, d).select(F.col("value").alias("x"), (0.3 + 2 * F.col("value") + F.col("u") * 0.001).alias("y"))
    return _table(spark, ["c0", "c1"], M.polynomial_fit(rows, "x", "y", 1))


@query("cubic_fit", "SELECT * FROM (VALUES ('c0', 0.1::double), ('c1', 0.9::double), ('c2', 0.2::double), ('c3', 0.05::double)) t(term, value)")
def _(spark, d):
    x = F.col("value") * 4
    rows = pixels(spark, d).select(x.alias("x"), (0.1 + 0.9 * x + 0.2 * x * x + 0.05 * x * x * x).alias("y"))
    return _table(spark, ["c0", "c1", "c2", "c3"], M.polynomial_fit(rows, "x", "y", 3), 3)


@query("robust_bhc_fit", "SELECT * FROM (VALUES ('a', 0.3::double), ('b', 0.2::double)) t(term, value)")
def _(spark, d):
    """The coefficients come back although each tenth sample is wrong."""
    q = F.col("u") / 40.0
    px = pixels(spark, d).withColumn("delta", 0.3 * q * q + 0.2 * F.col("value") * q + F.when(F.col("view") % 10 == 0, 5.0).otherwise(0.0))
    return _table(spark, ["a", "b"], M.robust_fit(px, [q * q, F.col("value") * q], F.col("delta")), 2)


@query("circle_fit", "SELECT * FROM (VALUES ('x', 3.0::double), ('y', -2.0::double), ('r', 5.0::double)) t(term, value)")
def _(spark, d):
    pts = spark.range(50).select((3 + 5 * F.cos(F.col("id") * 0.1)).alias("x"), (-2 + 5 * F.sin(F.col("id") * 0.1)).alias("y"))
    return _table(spark, ["x", "y", "r"], M.circle_fit(pts))


@query("dlt_fit", "SELECT 0.0::double AS worst")
def _(spark, d):
    """The largest reprojection error of a projection matrix fitted to exact points."""
    from voxelbase.operators import geometry as G

    from .recon import SCAN

    k = F.col("id")
    x = F.struct((k % 7 - 3.0).alias("x"), (k % 5 - 2.0).alias("y"), (F.floor(k / 7) % 4 - 1.5).alias("z"))
    p = G.projection_matrix(G.flat_geometry(spark, SCAN)).where("view = 2").select("p")
    pts = spark.range(140).select(x.alias("p3")).crossJoin(F.broadcast(p))  # one matrix
    u, v = G.project(F.col("p"), F.col("p3"))
    pts = pts.select("p3.*", u.alias("u"), v.alias("v"))
    fit = F.array(*map(F.lit, M.homogeneous_fit(pts)))
    pu, pv = G.project(fit, F.struct("x", "y", "z"))
    return pts.agg(tidy(F.max(F.hypot(pu - F.col("u"), pv - F.col("v"))), 3).alias("worst"))


@query("scatter_fixed_point", None)
def _(spark, d):
    """Damped fixed point: primary = measured - kernel * primary, floored; eight rounds."""
    from voxelbase.operators.neighbour import scatter_fixed_point
    from voxelbase.sources.tables import frames

    rows = scatter_fixed_point(frames(spark, d), [0.02, 0.04, 0.06, 0.04, 0.02], 8, 0.7, 1.5e-8)
    return rows.select("view", F.posexplode("data").alias("u", "v")).select("view", "u", tidy(F.col("v")).alias("primary"))

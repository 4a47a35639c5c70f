"""Joins and orderings of tracks, beads, organs and materials, and sample filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelbase.functions.scalar import tidy
from voxelbase.operators import relate as N
from voxelbase.sources.tables import frames, pixels

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


@query("material_attenuation", f"WITH {PX}, m AS (SELECT p_partkey % 10 AS material, avg(p_size) / 1000 AS mu FROM part GROUP BY ALL) SELECT view, u, {R('value * mu')} AS p FROM px JOIN m ON label = material")
def _(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    mu = part.groupBy((F.col("p_partkey") % 10).alias("label")).agg((F.avg("p_size") / 1000).alias("mu"))
    return pixels(spark, d).join(F.broadcast(mu), "label").select("view", "u", tidy(F.col("value") * F.col("mu")).alias("p"))  # mu: ten rows


PRESETS = [(0, "Soft Tissue", ["tissue"]), (1, "Water", ["H2O", "liquid water"]), (2, "Cortical_Bone", ["bone", "h-2-o"])]
ASKED = ["h2o", "SOFT_TISSUE", "cortical bone", "Bone", "air"]


@query("preset_lookup", f"SELECT p_partkey, a AS name, CASE a WHEN 'h2o' THEN 'Water' WHEN 'SOFT_TISSUE' THEN 'Soft Tissue' WHEN 'air' THEN NULL ELSE 'Cortical_Bone' END AS preset FROM (SELECT p_partkey, ({ASKED})[(p_partkey % 5)::int + 1] AS a FROM part)")
def _(spark, d):
    asked = F.array(*map(F.lit, ASKED))[(F.col("p_partkey") % 5).cast("int")]
    names = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", asked.alias("name"))
    return N.resolve_presets(names, spark.createDataFrame(PRESETS, "ordinal int, preset string, aliases array<string>")).select("p_partkey", "name", "preset")


@query("organ_media", f"SELECT c_custkey AS organ_id, n_name AS medium, {R('CASE WHEN c_acctbal >= 0 THEN c_acctbal / 1000 ELSE n_regionkey + 1 + c_custkey % 2 END')} AS density FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    organs = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("organ_id"), (F.col("c_custkey") % 2).alias("sex"), F.col("c_nationkey").alias("medium_id"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 1000).alias("density"))
    media = spark.read.parquet(f"{d}/nation.parquet").select(F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("sex"), F.col("n_nationkey").alias("medium_id"), F.col("n_name").alias("medium"), "n_regionkey")
    media = media.select("sex", "medium_id", "medium", (F.col("n_regionkey") + 1.0 + F.col("sex")).alias("density"))
    return N.organ_densities(organs, media).select("organ_id", "medium", tidy(F.col("density")).alias("density"))


@query("mirror_pairs", f"WITH {PX} SELECT a.view, a.u::int AS u, {R('a.value - b.value')} AS difference FROM px a JOIN px b ON b.view = a.view AND b.u = 63 - a.u")
def _(spark, d):
    """Each pixel against its mirror in the row; both lie in one frame, so nothing shuffles."""
    rows = frames(spark, d).select("view", F.posexplode(F.zip_with("data", F.reverse("data"), lambda a, b: a - b)).alias("u", "x"))
    return rows.select("view", "u", tidy(F.col("x")).alias("difference"))


@query("track_merge", f"WITH {PX}, f AS (SELECT view, u, value FROM px WHERE u < 40 AND value > 0.1), b AS (SELECT view, u, value / 2 AS value FROM px WHERE u >= 20 AND value > 0.05) SELECT coalesce(f.view, b.view) AS view, coalesce(f.u, b.u)::int AS target, {R('coalesce(f.value, b.value)')} AS u, coalesce(f.value > 0.12, false) OR coalesce(b.value > 0.05, false) AS observed, (coalesce(f.value > 0.12, false) OR coalesce(b.value > 0.05, false)) AND NOT coalesce(f.u, b.u) % 7 = 0 AS usable FROM f FULL JOIN b ON f.view = b.view AND f.u = b.u")
def _(spark, d):
    px = pixels(spark, d).withColumn("merged", F.col("u") % 7 == 0)
    forward = px.where("u < 40 and value > 0.1").select("view", F.col("u").alias("target"), F.col("value").alias("u"), (F.col("value") > 0.12).alias("observed"), "merged")
    backward = px.where("u >= 20 and value > 0.05").select("view", F.col("u").alias("target"), (F.col("value") / 2).alias("u"), (F.col("value") / 2 > 0.05).alias("observed"), "merged")
    return N.merge_tracks(forward, backward).select("view", "target", tidy(F.col("u")).alias("u"), "observed", "usable")


AX, AY = [0.0, 0.1, 0.3], [0.0, 8.0, 16.0, 32.0, 50.0]
DENSITY = [[(i + 1) * (1.0 - y / 64) for y in AY] for i in range(len(AX))]


@query("radial_density", f"WITH {PX}, p AS (SELECT view, u, least(value, 0.3) AS x FROM px) SELECT view, u::int AS u, {R('CASE WHEN u > 50 THEN 0.0 ELSE (1 + CASE WHEN x < 0.1 THEN x / 0.1 ELSE 1 + (x - 0.1) / 0.2 END) * (1 - u / 64) END')} AS density FROM p")
def _(spark, d):
    rho = N.bilinear_table(F.col("value"), F.col("u").cast("double"), AX, AY, DENSITY)
    return pixels(spark, d).select("view", "u", tidy(rho).alias("density"))


@query("rejected_ids", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(spark, d):
    every = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"))
    return every.join(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("id")), "id", "left_anti").distinct()


@query("medians", f"WITH {PX}, s AS (SELECT label, value, row_number() OVER (PARTITION BY label ORDER BY value) AS k, count(*) OVER (PARTITION BY label) AS n FROM px) SELECT label, {R('median(value)')} AS between, {R('max(CASE WHEN k = n // 2 + 1 THEN value END)')} AS upper FROM s GROUP BY label")
def _(spark, d):
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value DESC)")
    return pixels(spark, d).groupBy("label").agg(tidy(F.percentile("value", F.lit(0.5))).alias("between"), tidy(upper).alias("upper"))


@query("row_components", f"WITH {PX}, r AS (SELECT view, u, u - row_number() OVER (PARTITION BY view ORDER BY u) AS c FROM px WHERE value > 0.1) SELECT view, count(*) AS area, min(u)::int AS first_u FROM r GROUP BY view, c")
def _(spark, d):
    return N.row_components(pixels(spark, d), F.col("value") > 0.1).select("view", "area", "first_u")


@query("contrast_report", f"WITH {PX}, m AS (SELECT label, avg(value) AS mean FROM px GROUP BY label) SELECT m.label, {R('m.mean - r.mean')} AS contrast, abs(m.mean / r.mean - 1) <= 0.02 AS within FROM m, m r WHERE r.label = 0")
def _(spark, d):
    px = pixels(spark, d)
    mean = px.groupBy("label").agg(F.avg("value").alias("mean"))
    reference = px.where("label = 0").agg(F.avg("value").alias("ref"))  # one row
    rows = mean.crossJoin(F.broadcast(reference))
    return rows.select("label", tidy(F.col("mean") - F.col("ref")).alias("contrast"), (F.abs(F.col("mean") / F.col("ref") - 1) <= 0.02).alias("within"))


@query("class_counts", f"WITH {PX} SELECT CASE WHEN value < 0.05 THEN 'air' WHEN value < 0.2 THEN 'water' ELSE 'bone' END AS class, count(*) AS n FROM px GROUP BY 1")
def _(spark, d):
    v = F.col("value")
    return pixels(spark, d).groupBy(F.when(v < 0.05, "air").when(v < 0.2, "water").otherwise("bone").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("ring_order", "WITH b AS (SELECT p_partkey AS bead, p_brand AS ring, row_number() OVER (PARTITION BY p_brand ORDER BY round(atan2(p_partkey % 17 - 8.0, p_size - 25.5), 9), p_partkey) - 1 AS place, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT bead, ring, place::int AS place, ((place + 2) % n)::int AS turned FROM b")
def _(spark, d):
    beads = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("bead"), F.col("p_brand").alias("ring"), (F.col("p_size") - 25.5).alias("x"), (F.col("p_partkey") % 17 - 8.0).alias("y"))
    return N.ring_order(beads, ["ring"], F.col("x"), F.col("y"), "bead", 2).select("bead", "ring", "place", "turned")


@query("first_centres", f"WITH {PX}, c AS (SELECT view, (u // 8)::int AS v, (u % 8)::int AS u FROM px WHERE value > 0.1), r AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY v, u) - 1 AS place FROM c) SELECT view, v, u, place::int AS place FROM r WHERE place < 6")
def _(spark, d):
    centres = pixels(spark, d).where("value > 0.1").select("view", F.floor(F.col("u") / 8).cast("int").alias("v"), (F.col("u") % 8).alias("u"))
    return N.first_centres(centres, ["view"], "v", "u", 6).select("view", "v", "u", "place")


@query("material_samples", f"WITH {PX} SELECT view, u, {R('value * 10')} AS first_mm, {R('u / 64')} AS second_mm, view % 5 = 0 AS held_out FROM px WHERE isfinite(value) AND value >= 0 AND value * 10 + u / 64 >= 0.5")
def _(spark, d):
    first, second = F.col("value") * 10, F.col("u") / 64
    rows = pixels(spark, d).where(~F.isnan("value") & (F.col("value") >= 0) & (F.col("value") < float("inf")) & (first + second >= 0.5))
    return rows.select("view", "u", tidy(first).alias("first_mm"), tidy(second).alias("second_mm"), (F.col("view") % 5 == 0).alias("held_out"))


_A = N.ATOMIC_WEIGHT
_FRACTIONS = [("H2O", "H", f"2 * {_A['H']} / (2 * {_A['H']} + {_A['O']})"), ("H2O", "O", f"{_A['O']} / (2 * {_A['H']} + {_A['O']})")]
_MG = f"({_A['Mg']} + 2 * ({_A['O']} + {_A['H']}))"
_FRACTIONS += [("Mg(OH)2", "Mg", f"{_A['Mg']} / {_MG}"), ("Mg(OH)2", "O", f"2 * {_A['O']} / {_MG}"), ("Mg(OH)2", "H", f"2 * {_A['H']} / {_MG}")]


@query("chemical_formula", "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{e}', {R(x)})" for f, e, x in _FRACTIONS) + ") t(formula, element, fraction)")
def _(spark, d):
    rows = N.weight_fractions(spark.createDataFrame([("H2O",), ("Mg(OH)2",)], "formula string"))
    return rows.select("formula", "element", tidy(F.col("fraction")).alias("fraction"))

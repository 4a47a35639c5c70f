"""Row-wise operators and look-ups over the frames table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voxelbase.functions import scalar as S
from voxelbase.operators import lookup as L
from voxelbase.operators import pointwise as P
from voxelbase.sources.tables import AIR, frames, pixels

T = S.tidy
PX = "px AS (SELECT view, label, u, abs(e::double) AS value FROM (SELECT vec_id AS view, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS u FROM embeddings))"
R = lambda e, n=6: f"(round({e}, {n}) + 0.0)"

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("energy_restore", f"WITH {PX} SELECT view, u, {R(f'{AIR} * exp(-value)')} AS energy FROM px")
def _(spark, d):
    return pixels(spark, d).select("view", "u", T(P.energy_restore(F.col("value"), F.lit(AIR))).alias("energy"))


@query("log_convert", f"WITH {PX} SELECT view, u, {R(f'-ln(greatest(value / {AIR}, {P.TINY}))')} AS p FROM px")
def _(spark, d):
    return pixels(spark, d).select("view", "u", T(P.log_convert(F.col("value"), F.lit(AIR))).alias("p"))


@query("transmission_log", f"WITH {PX} SELECT view, u, {R('exp(-value)')} AS t, {R('-ln(greatest(value, 1e-8))')} AS p FROM px")
def _(spark, d):
    v = F.col("value")
    return pixels(spark, d).select("view", "u", T(F.exp(-v)).alias("t"), T(P.transmission_to_log(v)).alias("p"))


@query("object_mask", f"WITH {PX} SELECT view, count(*) AS n, sum(CASE WHEN -ln(greatest(value / {AIR}, 1e-30)) > 2.5 THEN 1 ELSE 0 END)::bigint AS in_object FROM px GROUP BY view")
def _(spark, d):
    mask = P.object_mask(F.col("value"), F.lit(AIR), 2.5)
    return pixels(spark, d).groupBy("view").agg(F.count(F.lit(1)).alias("n"), F.sum(mask.cast("int")).alias("in_object"))


@query("guided_residual", f"WITH {PX} SELECT view, u, {R(f'greatest({AIR} * 1e-8, value - 0.7 * greatest(0.0, value * value - 0.01))')} AS e FROM px")
def _(spark, d):
    v = F.col("value")
    return pixels(spark, d).select("view", "u", T(P.guided_residual(v, v * v - 0.01, F.lit(AIR), 0.7)).alias("e"))


@query("water_bhc", f"WITH {PX} SELECT view, u, {R('0.02 + c * (0.9 + c * (0.15 + c * 0.03))')} AS p FROM (SELECT *, least(greatest(value, 0.01), 0.25) AS c FROM px)")
def _(spark, d):
    return pixels(spark, d).select("view", "u", T(P.polynomial_bhc(F.col("value"), [0.02, 0.9, 0.15, 0.03], 0.01, 0.25)).alias("p"))


@query("empirical_bhc", f"WITH {PX} SELECT view, u, {R('value + 0.3 * (u / 40.0) * (u / 40.0) + 0.2 * value * (u / 40.0)')} AS p FROM px")
def _(spark, d):
    return pixels(spark, d).select("view", "u", T(P.empirical_bhc(F.col("value"), F.col("u"), 0.3, 0.2, 40.0)).alias("p"))


@query(
    "ideal_bone_correction",
    f"WITH {PX}, q AS (SELECT *, u / 20.0 AS w, u / 60.0 AS b FROM px), r AS (SELECT *, -ln(0.4 * exp(-(w * 0.3 + b * 0.9)) + 0.6 * exp(-(w * 0.2 + b * 0.5))) AS poly FROM q) SELECT view, u, {R('value + (w * 0.22 + b * 0.6) - (0.01 + poly * (1.05 + poly * 0.02))')} AS p FROM r",
)
def _(spark, d):
    paths = [F.col("u") / 20.0, F.col("u") / 60.0]
    out = P.ideal_bone_correction(F.col("value"), paths, [0.22, 0.6], [(0.4, [0.3, 0.9]), (0.6, [0.2, 0.5])], [0.01, 1.05, 0.02])
    return pixels(spark, d).select("view", "u", T(out).alias("p"))


@query("cosine_preweight", f"WITH {PX} SELECT view, u, {R('value * 400.0 / sqrt(pow((u - 31.5) * 0.8, 2) + pow((1 - 1.0) * 0.8, 2) + 160000.0) * (400.0 / 400.0)')} AS p FROM px")
def _(spark, d):
    w = P.cosine_weight(F.col("u"), F.lit(1), 64, 3, 0.8, 0.8, 200.0, 400.0)
    return pixels(spark, d).select("view", "u", T(F.col("value") * w).alias("p"))


FAN, SCAN = 0.25, math.pi + 0.5
PARKER_SQL = f"""WITH g AS (SELECT vec_id AS view, (vec_id % 120) * {SCAN} / 120 AS beta, (unnest(range(0, 64)) - 31.5) * 0.007 AS gamma FROM embeddings)
SELECT view, {R('gamma')} AS gamma, {R(f'''{SCAN} / pi() * CASE WHEN beta <= 0 THEN 0.0 WHEN beta < 2 * ({FAN} + gamma) THEN pow(sin(pi() / 4 * beta / ({FAN} + gamma)), 2)
WHEN beta <= pi() + 2 * gamma THEN 1.0 WHEN beta < pi() + {2 * FAN} THEN pow(sin(pi() / 4 * (pi() + {2 * FAN} - beta) / ({FAN} - gamma)), 2) ELSE 0.0 END''')} AS w FROM g"""


@query("parker_weight", PARKER_SQL)
def _(spark, d):
    rows = frames(spark, d).select("view", (F.col("view") % 120 * SCAN / 120).alias("beta"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("u"))
    gamma = (F.col("u") - 31.5) * 0.007
    return rows.select("view", T(gamma).alias("gamma"), T(P.parker_weight(F.col("beta"), gamma, FAN, SCAN)).alias("w"))


@query("helical_redundancy", f"WITH {PX} SELECT view, u, {R('CASE WHEN abs(q) < 0.6 THEN 1.0 WHEN abs(q) < 1 THEN pow(cos(pi() / 2 * (abs(q) - 0.6) / 0.4), 2) ELSE 0.0 END')} AS w FROM (SELECT *, (u - 31.5) / 30.0 AS q FROM px)")
def _(spark, d):
    return pixels(spark, d).select("view", "u", T(P.helical_redundancy((F.col("u") - 31.5) / 30.0, 0.6)).alias("w"))


@query(
    "vector_algebra",
    f"WITH {PX}, x AS (SELECT view, u, value - 0.05 AS x, value * 3 AS y FROM px) SELECT view, u, {R('y - x')} AS residual, {R('x + 0.5 * y / (abs(x) + 1e-8)', 4)} AS update, {R('least(greatest(x, 0.0), 1.0)')} AS bounded, {R('CASE WHEN abs(x) > 1e-8 THEN 1 / x ELSE 0.0 END', 3)} AS inverse, {R('x * y')} AS product, {R('x + 0.5 * x * y')} AS addmul, {R('0.5 * x + y')} AS axpy FROM x",
)
def _(spark, d):
    out = P.vector_algebra(F.col("value") - 0.05, F.col("value") * 3, 0.5)
    return pixels(spark, d).select("view", "u", *(T(c, {"update": 4, "inverse": 3}.get(k, 6)).alias(k) for k, c in out.items()))


@query("das_quantise", f"WITH {PX} SELECT view, u, {R('round_even(least(value * 1000.0 + 3.5, 200.0) / 0.25, 0) * 0.25 / 1000.0')} AS signal FROM px")
def _(spark, d):
    return pixels(spark, d).select("view", "u", T(P.das(F.col("value"), F.lit(0.0), 1000.0, 3.5, 200.0, 0.25)).alias("signal"))


@query("hash_noise", None)
def _(spark, d):
    h = S.hash32((F.col("view") * 64 + F.col("u")).cast("long"))
    return pixels(spark, d).select("view", "u", h.alias("hash"), S.uniform24(h).alias("uniform"))


@query(
    "mu_hu_round_trip",
    f"WITH {PX}, h AS (SELECT view, u, value, value * (1000.0 / 0.02) + -1000.0 AS hu FROM px) SELECT view, u, {R('hu')} AS hu, {R('(hu + 1000.0) / (1000.0 / 0.02)')} AS mu FROM h",
)
def _(spark, d):
    hu = S.mu_to_hu(F.col("value"), 0.02)
    return pixels(spark, d).select("view", "u", T(hu).alias("hu"), T(S.hu_to_mu(hu, 0.02)).alias("mu"))


@query("hu_classes", f"WITH {PX} SELECT label, (CASE WHEN value >= 0.05 THEN 1 ELSE 0 END + CASE WHEN value >= 0.1 THEN 1 ELSE 0 END + CASE WHEN value >= 0.2 THEN 1 ELSE 0 END) AS class, count(*) AS n FROM px GROUP BY ALL")
def _(spark, d):
    return pixels(spark, d).groupBy("label", P.classify(F.col("value"), [0.05, 0.1, 0.2]).alias("class")).agg(F.count(F.lit(1)).alias("n"))


WINDOW_SQL = {
    "ram_lak": "1.0",
    "shepp_logan": "CASE WHEN x = 0 THEN 1.0 ELSE sin(pi() * x / 2) / (pi() * x / 2) END",
    "cosine": "cos(pi() * x / 2)",
    "hann": "0.5 * (1 + cos(pi() * x))",
    "hamming": "0.54 + 0.46 * cos(pi() * x)",
    "blackman": "0.42 + 0.5 * cos(pi() * x) + 0.08 * cos(2 * pi() * x)",
    "butterworth": "1 / (1 + pow(x, 4.0))",
    "tukey": "CASE WHEN x < 0.25 THEN 0.5 * (1 + cos(pi() * (x / 0.25 - 1))) WHEN x > 0.75 THEN 0.5 * (1 + cos(pi() * ((x - 1) / 0.25 + 1))) ELSE 1.0 END",
}


@query("filter_windows", "WITH t AS (SELECT i, i / 128.0 AS x FROM range(0, 129) r(i)) " + " UNION ALL ".join(f"SELECT '{k}' AS kind, i, {R(e)} AS w FROM t" for k, e in WINDOW_SQL.items()))
def _(spark, d):
    rows = spark.range(129).select(F.col("id").alias("i"), (F.col("id") / 128.0).alias("x"))
    kinds = F.create_map(*(c for k in WINDOW_SQL for c in (F.lit(k), T(S.window(k, F.col("x"))))))
    return rows.select("i", F.explode(kinds).alias("kind", "w")).select("kind", "i", "w")


@query("kaiser_window", None)
def _(spark, d):
    rows = spark.range(129).select(F.col("id").alias("i"), (F.col("id") / 128.0).alias("x"))
    return rows.select("i", T(S.window("kaiser", F.col("x"))).alias("w"), T(S.bessel_i0(F.col("x") * 12)).alias("i0"))


@query("detector_efficiency", f"WITH {PX} SELECT view, u, {R('exp(-0.1 / cos(value)) * (1 - exp(-1.3 / cos(value)))')} AS eta FROM px")
def _(spark, d):
    return pixels(spark, d).select("view", "u", T(P.detector_efficiency(F.lit(0.1), F.lit(1.3), F.cos("value"))).alias("eta"))


@query("scatter_amplitude", f"WITH {PX} SELECT view, u, {R('CASE WHEN value < 0.05 THEN 0.9 * 0.4 * value / 0.05 / exp(-value) ELSE 0.4 + value END')} AS a FROM px")
def _(spark, d):
    v = F.col("value")
    return pixels(spark, d).select("view", "u", T(P.scatter_amplitude(F.exp(-v), v, 0.05, 0.4, 0.9, 0.4 + v)).alias("a"))


# Look-ups.
MATERIALS = [(0, "water", 1.0), (1, "bone", 1.85), (2, "fat", 0.92), (3, "muscle", 1.06), (4, "lung", 0.26)]
MAT_SQL = "m(label, name, density) AS (VALUES " + ", ".join(f"({a}, '{b}', {c}::double)" for a, b, c in MATERIALS) + ")"


@query("label_materials", f"WITH {PX}, {MAT_SQL} SELECT name, count(*) AS n, {R('sum(value * density)', 4)} AS mass FROM px JOIN m ON px.label % 5 = m.label GROUP BY name")
def _(spark, d):
    table = spark.createDataFrame(MATERIALS, "label int, name string, density double")
    rows = L.join_required(pixels(spark, d).withColumn("label", F.col("label") % 5), table, "label")
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), T(F.sum(F.col("value") * F.col("density")), 4).alias("mass"))


@query("unmapped_labels", f"WITH {PX}, {MAT_SQL} SELECT label, count(*) AS n FROM px WHERE label NOT IN (SELECT label FROM m) GROUP BY label")
def _(spark, d):
    table = spark.createDataFrame(MATERIALS, "label int, name string, density double")
    return L.unmatched(pixels(spark, d), table, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


KNOTS = [(0.0, 1.0), (0.05, 1.6), (0.1, 1.9), (0.2, 2.05), (0.5, 2.1)]


def _segments(value):
    parts = "".join(f"WHEN value < {b[0]} THEN {a[1]} + (value - {a[0]}) * ({(b[1] - a[1])} / {b[0] - a[0]}) " for a, b in zip(KNOTS, KNOTS[1:]))
    return f"CASE {parts} ELSE {KNOTS[-1][1]} END"


@query("linear_lookup", f"WITH {PX} SELECT view, u, {R(_segments('value'))} AS y FROM px")
def _(spark, d):
    return pixels(spark, d).select("view", "u", T(L.piecewise_linear(F.col("value"), KNOTS)).alias("y"))


@query("pchip_lookup", None)
def _(spark, d):
    return pixels(spark, d).select("view", "u", T(L.pchip(F.col("value"), KNOTS)).alias("y"))


INV_SQL = "CASE " + " ".join(f"WHEN y < {b[1]} THEN {a[0]} + (y - {a[1]}) * ({b[0] - a[0]} / {b[1] - a[1]})" for a, b in zip(KNOTS, KNOTS[1:])) + f" ELSE {KNOTS[-1][0]} END"


@query("inverse_lookup", f"WITH {PX} SELECT view, u, {R(INV_SQL)} AS x FROM (SELECT view, u, 1.0 + value * 2 AS y FROM px)")
def _(spark, d):
    return pixels(spark, d).select("view", "u", T(L.inverse_linear(1.0 + F.col("value") * 2, KNOTS)).alias("x"))


LUT = [[0.0, 0.1, 0.25, 0.4], [0.05, 0.2, 0.4, 0.6], [0.1, 0.3, 0.6, 0.9]]
LUT_SQL = "t(j, i, z) AS (VALUES " + ", ".join(f"({j}, {i}, {z}::double)" for j, row in enumerate(LUT) for i, z in enumerate(row)) + ")"


@query(
    "two_material_lut",
    f"""WITH {PX}, {LUT_SQL}, q AS (SELECT view, u, value / 0.1 AS x, u / 32.0 AS y FROM px),
r AS (SELECT *, floor(x)::int AS i, floor(y)::int AS j FROM q WHERE x < 3 AND y < 2)
SELECT view, u, {R('(1 - (y - r.j)) * ((1 - (x - r.i)) * a.z + (x - r.i) * b.z) + (y - r.j) * ((1 - (x - r.i)) * c.z + (x - r.i) * e.z)')} AS p
FROM r JOIN t a ON a.j = r.j AND a.i = r.i JOIN t b ON b.j = r.j AND b.i = r.i + 1 JOIN t c ON c.j = r.j + 1 AND c.i = r.i JOIN t e ON e.j = r.j + 1 AND e.i = r.i + 1""",
)
def _(spark, d):
    rows = pixels(spark, d).withColumns({"x": F.col("value") / 0.1, "y": F.col("u") / 32.0})
    return rows.select("view", "u", T(L.bilinear(F.col("x"), F.col("y"), LUT)).alias("p")).where("p is not null")


@query(
    "soft_basis",
    f"WITH {PX}, q AS (SELECT *, least(value / 0.05, 5.999) AS x FROM px), s AS (SELECT view, floor(x)::int AS node, 1 - (x - floor(x)) AS w FROM q UNION ALL SELECT view, floor(x)::int + 1, x - floor(x) FROM q) SELECT view, node, {R('sum(w)')} AS weight FROM s GROUP BY view, node",
)
def _(spark, d):
    rows = L.soft_assign(pixels(spark, d).withColumn("x", F.least(F.col("value") / 0.05, F.lit(5.999))), "x")
    return rows.groupBy("view", "node").agg(T(F.sum("weight")).alias("weight"))


@query("air_pairing", "SELECT e.vec_id AS view, count(*) AS n, round(sum(abs(e.embedding[1]::double) / (1 + s.s_acctbal * s.s_acctbal)), 6) + 0.0 AS ratio FROM embeddings e JOIN supplier s ON e.vec_id % 10 = s.s_suppkey GROUP BY e.vec_id")
def _(spark, d):
    air = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("k"), (1 + F.col("s_acctbal") * F.col("s_acctbal")).alias("air"))
    rows = frames(spark, d).withColumn("k", F.col("view") % 10)
    return L.join_required(rows, air, "k").groupBy("view").agg(F.count(F.lit(1)).alias("n"), T(F.sum(F.col("data")[0] / F.col("air"))).alias("ratio"))

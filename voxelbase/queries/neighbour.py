"""Filters, resampling, recurrences and selections over the frames table."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from voxelbase.functions.scalar import tidy
from voxelbase.functions.scratch import scratch_path
from voxelbase.operators import neighbour as N
from voxelbase.operators import select as O
from voxelbase.operators.projector import Grid
from voxelbase.operators.traps import Traps, afterglow, afterglow_stream
from voxelbase.sources.tables import frames, pixels
from voxelbase.streaming.halo import keyed_state

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


def _flat(rows, column="data", name="value", digits=6):
    return rows.select("view", F.posexplode(column).alias("u", name)).select("view", "u", tidy(F.col(name), digits).alias(name))


def _stencil(terms: dict[int, float]) -> str:
    """SQL of a stencil with replicated border: a self join on clamped indices."""
    k = ", ".join(f"({o}, {w}::double)" for o, w in terms.items())
    return f"WITH {PX}, k(o, w) AS (VALUES {k}) SELECT p.view, p.u, {R('sum(k.w * q.value)')} AS value FROM px p, k JOIN px q ON q.view = p.view AND q.u = least(greatest(p.u + k.o, 0), 63) GROUP BY p.view, p.u"


@query("mean_filter_row", _stencil({k: 1 / 5 for k in range(-2, 3)}))
def _(spark, d):
    return _flat(N.convolve(frames(spark, d), N.mean_kernel(2)))


@query("gaussian_filter_row", _stencil(dict(zip(range(-3, 4), N.gaussian_kernel(1.2, 3), strict=True))))
def _(spark, d):
    return _flat(N.convolve(frames(spark, d), N.gaussian_kernel(1.2, 3)))


@query("edge_convolution", _stencil({-1: 0.2, 0: 0.5, 1: 0.3}))
def _(spark, d):
    return _flat(N.convolve(frames(spark, d), [0.2, 0.5, 0.3]))


@query("crosstalk", f"WITH {PX}, k(o, w) AS (VALUES (-1, 0.1), (0, 0.7), (1, 0.2)) SELECT p.view, p.u, {R('sum(k.w * q.value) / sum(k.w)')} AS value FROM px p, k JOIN px q ON q.view = p.view AND q.u = p.u + k.o GROUP BY p.view, p.u")
def _(spark, d):
    return _flat(N.crosstalk(frames(spark, d), [0.1, 0.7, 0.2]))


@query("bilateral_filter_row", f"WITH {PX}, w AS (SELECT p.view, p.u, q.value, exp(-pow(k.o, 2) / 4.5) * exp(-pow(q.value - p.value, 2) / 0.02) AS w FROM px p, range(-2, 3) k(o) JOIN px q ON q.view = p.view AND q.u = least(greatest(p.u + k.o, 0), 63)) SELECT view, u, {R('sum(w * value) / sum(w)')} AS value FROM w GROUP BY view, u")
def _(spark, d):
    return _flat(N.bilateral(frames(spark, d), 2, 1.5, 0.1))


GUIDED = f"""WITH {PX}, m AS (SELECT p.view, p.u, avg(q.value) AS m, avg(q.value * q.value) AS s FROM px p, range(-2, 3) k(o) JOIN px q ON q.view = p.view AND q.u = least(greatest(p.u + k.o, 0), 63) GROUP BY p.view, p.u),
ab AS (SELECT view, u, (s - m * m) / (s - m * m + 0.01) AS a, m * (1 - (s - m * m) / (s - m * m + 0.01)) AS b FROM m),
av AS (SELECT p.view, p.u, avg(q.a) AS a, avg(q.b) AS b FROM px p, range(-2, 3) k(o) JOIN ab q ON q.view = p.view AND q.u = least(greatest(p.u + k.o, 0), 63) GROUP BY p.view, p.u)
SELECT view, u, {R('value * a + b')} AS value FROM px JOIN av USING (view, u)"""


@query("guided_filter_row", GUIDED)
def _(spark, d):
    return _flat(N.guided(frames(spark, d), 2, 0.01))


@query("resize_linear", f"WITH {PX}, c AS (SELECT c, least(greatest((c + 0.5) * (64 / 100.0) - 0.5, 0.0), 63.0) AS x FROM range(0, 100) t(c)) SELECT view, c::int AS u, {R('sum(value * (1 - abs(x - u)))')} AS value FROM c JOIN px ON u BETWEEN floor(x) AND floor(x) + 1 GROUP BY view, c")
def _(spark, d):
    return _flat(frames(spark, d).withColumn("data", N.resize_linear(F.col("data"), 100)))


@query("resize_nearest", f"WITH {PX} SELECT view, c::int AS u, {R('value')} AS value FROM range(0, 24) t(c) JOIN px ON u = floor((c + 0.5) * (64 / 24.0))")
def _(spark, d):
    return _flat(frames(spark, d).withColumn("data", N.resize_nearest(F.col("data"), 24)))


@query("resize_area", f"WITH {PX} SELECT view, c::int AS u, {R('sum(value * greatest(least(u + 1, (c + 1) * 64 / 24.0) - greatest(u, c * 64 / 24.0), 0)) / (64 / 24.0)')} AS value FROM range(0, 24) t(c), px GROUP BY view, c")
def _(spark, d):
    return _flat(frames(spark, d).withColumn("data", N.resize_area(F.col("data"), 24)))


@query("forward_difference", f"WITH {PX} SELECT view, u, {R('coalesce(lead(value) OVER (PARTITION BY view ORDER BY u) - value, 0)')} AS value FROM px")
def _(spark, d):
    return _flat(frames(spark, d).withColumn("data", N.difference(F.col("data"))))


@query("local_maxima", f"WITH {PX}, n AS (SELECT *, coalesce(lag(value) OVER w, value) AS a, coalesce(lead(value) OVER w, value) AS b FROM px WINDOW w AS (PARTITION BY view ORDER BY u)) SELECT view, u FROM n WHERE value >= 0.2 AND value >= a AND value >= b")
def _(spark, d):
    return frames(spark, d).select("view", F.explode(N.local_maxima(F.col("data"), 0.2)).alias("u"))


@query("afterglow", f"WITH {PX} SELECT p.view, p.u, {R('any_value(0.95 * p.value) + coalesce(sum(pow(0.3, p.view - q.view) * 0.05 * q.value), 0)')} AS out FROM px p LEFT JOIN px q ON q.u = p.u AND q.view BETWEEN p.view - 20 AND p.view - 1 GROUP BY p.view, p.u")
def _(spark, d):
    return N.afterglow(pixels(spark, d), ["u"], "view", 0.05, 0.3, 20).select("view", "u", tidy(F.col("out")).alias("out"))


TRAPS = Traps(0.06, (0.7, 0.3), (3.0, 400.0), 8.0, 20.0)
SLOW_TRAPS = replace(TRAPS, steady=True)


def _traps_sql(t: Traps) -> str:
    """Every frame's own share, and of all earlier ones what each trap still gives; a steady start counts as frames like the first for ever."""
    late = []
    for w, tau in zip(t.weights, t.taus):
        give, gain = 1 - math.exp(-t.exposure / tau), math.exp(-t.frame / tau)
        take = t.share * w * tau * give / t.exposure * math.exp(-(t.frame - t.exposure) / tau)
        late.append(f"{give} * (coalesce(sum({take} * pow({gain}, p.view - q.view - 1) * q.value), 0)" + (f" + {take / max(1 - gain, 1e-6)} * pow({gain}, p.view) * any_value(f.value))" if t.steady else ")"))
    own = 1 - t.share + sum(t.share * w * (1 - tau * (1 - math.exp(-t.exposure / tau)) / t.exposure) for w, tau in zip(t.weights, t.taus))
    return f"WITH {PX}, f AS (SELECT u, value FROM px WHERE view = 0) SELECT p.view, p.u, {R(f'any_value({own} * p.value) + ' + ' + '.join(late))} AS out FROM px p JOIN f USING (u) LEFT JOIN px q ON q.u = p.u AND q.view < p.view GROUP BY p.view, p.u"


def _pixels_of(rows):
    return rows.select("view", F.posexplode("data").alias("u", "out")).select("view", "u", tidy(F.col("out")).alias("out"))


@query("afterglow_traps", _traps_sql(TRAPS))
def _(spark, d):
    return _pixels_of(afterglow(frames(spark, d), TRAPS))


@query("afterglow_steady", _traps_sql(SLOW_TRAPS))
def _(spark, d):
    return _pixels_of(afterglow(frames(spark, d), SLOW_TRAPS))


@query("afterglow_stream", _traps_sql(SLOW_TRAPS))
def _(spark, d):
    """The same frames as a stream in two runs from one checkpoint, the later half first in each."""
    path = scratch_path(spark, "afterglow")
    rows = frames(spark, d).select(F.lit("object").alias("scan"), "view", "data")
    for k in (0, 1):
        for half in (1, 0):
            rows.where((F.floor(F.col("view") / 100) % 2 == k) & (F.col("view") % 2 == half)).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 16).parquet(f"{path}/in")
        with keyed_state(spark):
            afterglow_stream(stream, SLOW_TRAPS).writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/out/batch={n}")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _pixels_of(spark.read.schema("scan string, view long, data array<double>").parquet(f"{path}/out"))


@query("track_prediction", f"WITH {PX} SELECT view, label, u AS target, {R('2 * lag(value, 1) OVER w - lag(value, 2) OVER w')} AS predicted FROM px WINDOW w AS (PARTITION BY u ORDER BY view)")
def _(spark, d):
    rows = pixels(spark, d).select("view", "label", F.col("u").alias("target"), F.col("value").alias("u"))
    return N.predict_tracks(rows).select("view", "label", "target", tidy(F.col("predicted")).alias("predicted"))


@query("stagnation", f"WITH r AS (SELECT event_type AS solver, event_id AS iteration, 1 + value AS residual FROM events), c AS (SELECT *, abs(residual - lag(residual) OVER w) / lag(residual) OVER w AS change FROM r WINDOW w AS (PARTITION BY solver ORDER BY iteration)), g AS (SELECT *, coalesce(change < 0.4, false) AS slow, sum(CASE WHEN coalesce(change < 0.4, false) THEN 0 ELSE 1 END) OVER (PARTITION BY solver ORDER BY iteration) AS grp FROM c) SELECT solver, iteration, {R('change')} AS change, (sum(slow::int) OVER (PARTITION BY solver, grp ORDER BY iteration))::bigint AS patience FROM g")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("solver"), F.col("event_id").alias("iteration"), (1 + F.col("value")).alias("residual"))
    return N.stagnation(rows, 0.4).select("solver", "iteration", tidy(F.col("change")).alias("change"), "patience")


G8 = Grid(8, 8, 8)


@query("erosion", "WITH v AS (SELECT id, id % 8 AS x, (id // 8) % 8 AS y, id // 64 AS z, CASE WHEN id % 37 = 0 THEN 1 ELSE 0 END AS label FROM range(0, 512) t(id)) SELECT a.id AS voxel_id, any_value(a.label) AS label FROM v a JOIN v b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 AND a.label = b.label GROUP BY a.id HAVING count(*) = 27")
def _(spark, d):
    labels = G8.voxels(spark).select("voxel_id", F.when(F.col("voxel_id") % 37 == 0, 1).otherwise(0).alias("label"))
    return N.erode(labels, G8)


# Selections.
@query("top_components", f"WITH {PX}, c AS (SELECT view, u // 8 AS component, sum(value) AS area FROM px GROUP BY ALL) SELECT view, component::int AS component, {R('area')} AS area, rank::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY view ORDER BY area DESC, component) AS rank FROM c) WHERE rank <= 4")
def _(spark, d):
    c = pixels(spark, d).groupBy("view", F.floor(F.col("u") / 8).cast("int").alias("component")).agg(F.sum("value").alias("area"))
    return O.top(c, ["view"], [F.desc("area"), F.col("component")], 4).select("view", "component", tidy(F.col("area")).alias("area"), "rank")


@query("stratified_limit", f"WITH {PX} SELECT bin::int AS bin, view, u FROM (SELECT floor(value / 0.05) AS bin, view, u, row_number() OVER (PARTITION BY floor(value / 0.05) ORDER BY view, u) AS r FROM px WHERE view % 5 <> 0) WHERE r <= 12")
def _(spark, d):
    rows = pixels(spark, d).where("view % 5 <> 0").withColumn("bin", F.floor(F.col("value") / 0.05).cast("int"))
    return O.top(rows, ["bin"], [F.col("view"), F.col("u")], 12).select("bin", "view", "u")


@query("exact_quantiles", f"WITH {PX} SELECT label, {R('quantile_cont(value, 0.05)')} AS q05, {R('quantile_cont(value, 0.5)')} AS q50, {R('quantile_cont(value, 0.95)')} AS q95 FROM px GROUP BY label")
def _(spark, d):
    q = [tidy(F.percentile("value", F.lit(p))).alias(n) for p, n in ((0.05, "q05"), (0.5, "q50"), (0.95, "q95"))]
    return pixels(spark, d).groupBy("label").agg(*q)


@query("robust_threshold", f"WITH {PX}, m AS (SELECT view, median(value) AS m FROM px GROUP BY view), a AS (SELECT view, any_value(m) AS m, median(abs(value - m)) AS mad, stddev_pop(value) AS sd FROM px JOIN m USING (view) GROUP BY view) SELECT view, {R('m + 3 * s')} AS threshold, (SELECT count(*) FROM px WHERE px.view = a.view AND px.value > m + 3 * s) AS above FROM (SELECT view, m, CASE WHEN 1.4826 * mad > 2.3e-16 THEN 1.4826 * mad ELSE sd END AS s FROM a)a")
def _(spark, d):
    return O.robust_threshold(frames(spark, d), 3.0).select("view", tidy(F.col("threshold")).alias("threshold"), "above")


@query("best_anchor", f"WITH {PX} SELECT label, arg_max(view, (s, -view)) AS view, {R('max(s)')} AS score FROM (SELECT label, view, sum(value) AS s FROM px GROUP BY ALL) GROUP BY label")
def _(spark, d):
    s = pixels(spark, d).groupBy("label", "view").agg(F.sum("value").alias("s"))
    return s.groupBy("label").agg(F.max_by("view", F.struct("s", -F.col("view"))).alias("view"), tidy(F.max("s")).alias("score"))


GOLDEN = "WITH s AS (SELECT n, min(s) AS step FROM range(2, 41) a(n), range(1, 80) b(s) WHERE s >= greatest(1, round(n / 1.6180339887498949)) AND gcd(s, n) = 1 GROUP BY n) SELECT n::int AS n, pos::int AS pos, ((pos * step) % n)::int AS subset FROM s, range(0, 40) p(pos) WHERE pos < n"


@query("golden_order", GOLDEN)
def _(spark, d):
    from voxelbase.plans.solve import golden_order

    return spark.createDataFrame([(n, i, s) for n in range(2, 41) for i, s in enumerate(golden_order(n))], "n int, pos int, subset int")


@query("lower_quantiles", f"WITH {PX}, r AS (SELECT label, value, row_number() OVER (PARTITION BY label ORDER BY value) AS k, count(*) OVER (PARTITION BY label) AS n FROM px) SELECT label, {R('max(CASE WHEN k = floor(0.05 * (n - 1)) + 1 THEN value END)')} AS q05, {R('max(CASE WHEN k = floor(0.95 * (n - 1)) + 1 THEN value END)')} AS q95 FROM r GROUP BY label")
def _(spark, d):
    return O.lower_quantiles(pixels(spark, d), "label", "value", {"q05": 0.05, "q95": 0.95}).select("label", tidy(F.col("q05")).alias("q05"), tidy(F.col("q95")).alias("q95"))


@query("rejected_targets", f"WITH {PX} SELECT DISTINCT u AS target FROM px EXCEPT SELECT u FROM px WHERE value > 0.55")
def _(spark, d):
    px = pixels(spark, d)
    return px.select(F.col("u").alias("target")).subtract(px.where("value > 0.55").select("u"))


@query("nearest_bead", "WITH b AS (SELECT s_suppkey AS bead, s_acctbal AS x FROM supplier), c AS (SELECT c_custkey AS k, c_acctbal AS x FROM customer) SELECT k, bead FROM (SELECT k, bead, abs(c.x - b.x) AS d, row_number() OVER (PARTITION BY k ORDER BY abs(c.x - b.x), bead) AS r FROM c, b) WHERE r = 1 AND d <= 50")
def _(spark, d):
    points = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"))
    beads = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("bead"), F.col("s_acctbal").alias("bx"))
    return O.nearest(points, beads, 50.0).select("k", "bead")

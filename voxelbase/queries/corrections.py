"""Scatter by kernel mixtures and its solvers, on frames of 8 x 8 pixels from every row of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelbase.functions.scalar import tidy
from voxelbase.plans import scatter as S
from voxelbase.sources import tables

R = lambda e, n=6: f"(round({e}, {n}) + 0.0)"
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


MODEL = S.Kernels(
    ny=8, nx=8, dv=1.25, du=1.0,
    nodes=(0.1, 0.5, 1.0, 2.0), radii=(0.0, 1.5, 3.0, 6.0),
    density=((0.030, 0.020, 0.010, 0.002), (0.040, 0.022, 0.012, 0.003), (0.050, 0.026, 0.013, 0.004), (0.070, 0.030, 0.015, 0.006)),
    amplitude=((0.2, 0.9), (0.8, 1.6), (1.6, 3.0)), water=((0.0, 0.0), (0.4, 2.0), (1.0, 4.0), (2.0, 9.0)),
    support_v=5.0, support_u=4.5, t_max=0.95, gamma=0.02, sigma=0.6, edge_scale=0.4, edge_ramp=3.0,
)
HOW = S.Damping(iterations=3, first=1.0, least=0.5, decay=0.9, margin=0.8, quantile=0.05, risk=0.2)
BELOW, SCALE = 0.8, 0.9
#: Trials that settle every frame: three steps, each refused once at most.
TRIALS = 6


def shots(spark, d):
    """(view, data, air): attenuation six times a row's magnitudes."""
    return tables.frames(spark, d).select("view", F.transform("data", lambda x: tables.AIR * F.exp(-6 * x)).alias("data"), F.array_repeat(F.lit(tables.AIR), 64).alias("air"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"{float(v)!r}::double" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)


def curve_sql(name: str, knots) -> str:
    """CTE ``name`` (i, x, y, m): knots with monotone slopes by weighted harmonic means, and one-sided ones at the ends."""

    def end(h0, h1, d0, d1):
        s = f"(((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1}))"
        return f"CASE WHEN {s} * {d0} <= 0 THEN 0.0 WHEN {d0} * {d1} < 0 AND abs({s}) > 3 * abs({d0}) THEN 3 * {d0} ELSE {s} END"

    w = "OVER (ORDER BY i)"
    return f"""{name}_k(i, x, y) AS (VALUES {_values((i, float(a), float(b)) for i, (a, b) in enumerate(knots))}),
{name}_d AS (SELECT *, lead(x) {w} - x AS h, (lead(y) {w} - y) / (lead(x) {w} - x) AS d FROM {name}_k),
{name}_n AS (SELECT *, lag(h) {w} AS hb, lag(d) {w} AS db, lag(h, 2) {w} AS hc, lag(d, 2) {w} AS dc, lead(h) {w} AS ha, lead(d) {w} AS da, lead(x) {w} AS xn, lead(y) {w} AS yn FROM {name}_d),
{name}_s AS (SELECT *, CASE WHEN hb IS NULL THEN {end('h', 'ha', 'd', 'da')} WHEN h IS NULL THEN {end('hb', 'hc', 'db', 'dc')} WHEN db * d <= 0 THEN 0.0 ELSE 3 * (h + hb) / ((2 * h + hb) / db + (h + 2 * hb) / d) END AS m FROM {name}_n),
{name} AS (SELECT *, lead(m) {w} AS mn FROM {name}_s)"""


HERMITE = "((2*f*f*f - 3*f*f + 1) * y + (f*f*f - 2*f*f + f) * h * m + (3*f*f - 2*f*f*f) * yn + (f*f*f - f*f) * h * mn)"


def _fixed_sql() -> str:
    """Frames f, kernels ke(k, dy, dx, w), edges ed, smoothing weights of the model."""
    m = MODEL
    rv, ru = m.reach()
    nodes = [(k, a, m.nodes[max(k - 1, 0)], m.nodes[min(k + 1, len(m.nodes) - 1)]) for k, a in enumerate(m.nodes)]
    density = [(k, m.radii[i], m.radii[i + 1], row[i], row[i + 1]) for k, row in enumerate(m.density) for i in range(len(m.radii) - 1)]
    amp = [(m.amplitude[i][0], m.amplitude[i + 1][0], m.amplitude[i][1], m.amplitude[i + 1][1]) for i in range(len(m.amplitude) - 1)]
    return f"""f AS MATERIALIZED (SELECT vec_id AS view, i // 8 AS y, i % 8 AS x, 1.5 * exp(-6 * abs(embedding[i + 1]::double)) AS data FROM embeddings, range(0, 64) t(i)),
ed AS MATERIALIZED (SELECT a.view, a.y, a.x, {m.edge_scale} + {1 - m.edge_scale} * least(1.0, coalesce(min((a.y - b.y) * (a.y - b.y) * {m.dv * m.dv} + (a.x - b.x) * (a.x - b.x) * {m.du * m.du}), 1e9) / {m.edge_ramp}) AS edge
  FROM f a LEFT JOIN f b ON a.view = b.view AND b.data >= {BELOW} * 1.5 WHERE a.data < {BELOW} * 1.5 GROUP BY a.view, a.y, a.x),
no(k, node, before, after) AS (VALUES {_values(nodes)}),
de(k, r0, r1, d0, d1) AS (VALUES {_values(density)}),
am(x0, x1, a0, a1) AS (VALUES {_values(amp)}),
{curve_sql('wa', m.water)},
re AS (SELECT dy, dx, sqrt(dy * dy * {m.dv * m.dv} + dx * dx * {m.du * m.du}) AS r FROM range({-rv}, {rv + 1}) a(dy), range({-ru}, {ru + 1}) b(dx)),
ke AS MATERIALIZED (SELECT k, dy, dx, (d0 + (r - r0) / (r1 - r0) * (d1 - d0)) * {m.dv * m.du} AS w FROM re JOIN de ON r >= r0 AND (r < r1 OR (r = r1 AND r1 = {m.radii[-1]}))),
gu AS (SELECT o, exp(-0.5 * o * o * {m.du * m.du / m.sigma**2}) AS w FROM range({-_reach(m.du)}, {_reach(m.du) + 1}) t(o)),
gv AS (SELECT o, exp(-0.5 * o * o * {m.dv * m.dv / m.sigma**2}) AS w FROM range({-_reach(m.dv)}, {_reach(m.dv) + 1}) t(o)),
gs AS (SELECT gv.o AS oy, gu.o AS ox, gv.w * gu.w / ((SELECT sum(w) FROM gv) * (SELECT sum(w) FROM gu)) AS w FROM gu, gv)"""


def _reach(pitch: float) -> int:
    return len(S.gaussian(pitch, MODEL.sigma)) // 2


def _scatter_sql(n, primary: str) -> str:
    """CTE s{n} (view, y, x, s) of the scatter that relation ``primary`` (view, y, x, p) makes."""
    m = MODEL
    return f"""t{n} AS MATERIALIZED (SELECT view, y, x, p, -ln(least(greatest(p / 1.5, 1e-300), 1.0)) AS a FROM {primary}),
w{n} AS (SELECT view, t.y, t.x, {HERMITE.replace('* y ', '* yy ')} AS w FROM (SELECT t.view, t.y, t.x, wa.y AS yy, h, m, yn, mn, (least(a, {m.water[-1][0]}) - wa.x) / h AS f FROM t{n} t JOIN wa ON h IS NOT NULL AND a >= wa.x AND (a < xn OR xn = {m.water[-1][0]})) t),
h{n} AS MATERIALIZED (SELECT t.view, t.y, t.x, sum(gs.w * w{n}.w) AS w FROM t{n} t, gs JOIN w{n} ON w{n}.view = t.view AND w{n}.y = least(greatest(t.y + oy, 0), 7) AND w{n}.x = least(greatest(t.x + ox, 0), 7) GROUP BY t.view, t.y, t.x),
r{n} AS (SELECT t.view, t.y, t.x, a, p * edge * CASE WHEN a < {m.amplitude[0][0]} THEN {m.t_max * m.amplitude[0][1] / m.amplitude[0][0]} * a * exp(a) ELSE a0 + (least(a, {m.amplitude[-1][0]}) - x0) / (x1 - x0) * (a1 - a0) END AS q
  FROM t{n} t JOIN ed USING (view, y, x) JOIN am ON greatest(a, {m.amplitude[0][0]}) >= x0 AND (a < x1 OR x1 = {m.amplitude[-1][0]}) WHERE a > 0),
k{n} AS (SELECT r.view, r.y, r.x, k, q * CASE WHEN c <= before THEN CASE WHEN node = before THEN 1 ELSE 0 END WHEN c <= node THEN (c - before) / (node - before) ELSE (after - c) / (after - node) END AS q
  FROM (SELECT *, least(greatest(a, {m.nodes[0]}), {m.nodes[-1]}) AS c FROM r{n}) r JOIN no ON c BETWEEN before AND after),
c{n} AS MATERIALIZED (SELECT q.view, q.y + dy AS y, q.x + dx AS x, sum(q * ke.w) AS plain, sum(q * ke.w * h.w) AS wet FROM k{n} q JOIN ke USING (k) JOIN h{n} h ON h.view = q.view AND h.y = q.y AND h.x = q.x WHERE q.y + dy BETWEEN 0 AND 7 AND q.x + dx BETWEEN 0 AND 7 GROUP BY 1, 2, 3),
s{n} AS MATERIALIZED (SELECT t.view, t.y, t.x, coalesce((1 - {m.gamma} * h.w) * plain + {m.gamma} * wet, 0.0) AS s FROM t{n} t JOIN h{n} h USING (view, y, x) LEFT JOIN c{n} USING (view, y, x))"""


def _adaptive_sql() -> str:
    """st (view, figures) and px (view, y, x, p) once every frame has come to rest."""
    h = HOW

    def figures(n, p):
        """Way and per-view figures of primaries ``p``."""
        return f"""{_scatter_sql(n, p)},
y{n} AS MATERIALIZED (SELECT view, y, x, p, data - p - {SCALE} * greatest(s, 0.0) AS way FROM {p} JOIN f USING (view, y, x) JOIN s{n} USING (view, y, x)),
e{n} AS (SELECT view, sqrt(sum(way * way)) / sqrt(sum(data * data)) AS residual, least(1.0, min(CASE WHEN way < 0 THEN {h.margin} * greatest(p - {1.5 * S.FLOOR!r}, 0) / -way END)) AS bound FROM y{n} JOIN f USING (view, y, x) GROUP BY view)"""

    parts = [
        "p0 AS (SELECT view, y, x, data AS p FROM f)",
        figures("0", "p0"),
        f"st0 AS (SELECT view, 0 AS iterations, 1 AS predictions, 0 AS rejected, 0 AS limited, {h.first}::double AS damping, residual, 0.0::double AS change, bound, 0.0::double AS least, true AS fresh, 'running' AS status FROM e0), px0 AS (SELECT * FROM y0)",
    ]
    for n in range(1, TRIALS + 1):
        b = n - 1
        wished = f"CASE WHEN iterations = 0 THEN {h.first} ELSE least({h.first} * pow({h.decay}, iterations), damping * 1.25) END"
        parts += [
            f"g{n} AS (SELECT * REPLACE (CASE WHEN fresh AND status = 'running' THEN least(w, bound) ELSE damping END AS damping, CASE WHEN fresh AND status = 'running' THEN least({h.least}, least(w, bound)) ELSE least END AS least, limited + CASE WHEN fresh AND status = 'running' AND bound < w THEN 1 ELSE 0 END AS limited) FROM (SELECT *, {wished} AS w FROM st{b}))",
            f"b{n} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN status = 'running' AND damping <= 0 THEN 'positivity_stalled' ELSE status END AS status) FROM g{n})",
            f"p{n} AS MATERIALIZED (SELECT view, y, x, px.p + damping * way AS p FROM px{b} px JOIN b{n} USING (view) WHERE status = 'running')",
            figures(n, f"p{n}"),
            f"d{n} AS (SELECT view, sqrt(sum((n.p - o.p) * (n.p - o.p))) / sqrt(sum(o.p * o.p)) AS moved FROM p{n} n JOIN px{b} o USING (view, y, x) GROUP BY view)",
            f"""st{n} AS MATERIALIZED (SELECT view, b.iterations + good::int AS iterations, predictions + tried::int AS predictions, rejected + (tried AND NOT good)::int AS rejected, limited,
  CASE WHEN tried AND NOT good AND damping > least THEN greatest(least, damping / 2) ELSE damping END AS damping, CASE WHEN good THEN new_residual ELSE residual END AS residual,
  CASE WHEN good THEN moved ELSE change END AS change, CASE WHEN good THEN new_bound ELSE bound END AS bound, least, good AS fresh,
  CASE WHEN status <> 'running' THEN status WHEN good AND b.iterations + 1 = {h.iterations} THEN 'completed' WHEN NOT good AND damping <= least THEN 'stalled' ELSE 'running' END AS status
  FROM (SELECT b.*, e.residual AS new_residual, e.bound AS new_bound, moved, e.view IS NOT NULL AS tried, coalesce(e.residual <= b.residual, false) AS good FROM b{n} b LEFT JOIN e{n} e USING (view) LEFT JOIN d{n} USING (view)) b)""",
            f"px{n} AS MATERIALIZED (SELECT o.view, o.y, o.x, CASE WHEN fresh THEN t.p ELSE o.p END AS p, CASE WHEN fresh THEN t.way ELSE o.way END AS way FROM px{b} o JOIN st{n} USING (view) LEFT JOIN y{n} t USING (view, y, x))",
        ]
    return f"WITH {_fixed_sql()}, " + ",\n".join(parts)


def _pixels(rows, name: str):
    return rows.select("view", F.posexplode(name).alias("u", "v")).select("view", "u", tidy(F.col("v")).alias(name))


@query("kernel_scatter", f"WITH {_fixed_sql()}, p0 AS (SELECT view, y, x, data AS p FROM f), {_scatter_sql('0', 'p0')} SELECT view, y * 8 + x AS u, {R('s')} AS scatter FROM s0")
def _(spark, d):
    return _pixels(S.scatter(shots(spark, d), MODEL, BELOW), "scatter")


def _rounds_sql(rounds: int, damping: float) -> str:
    out = [f"WITH {_fixed_sql()}, p0 AS (SELECT view, y, x, data AS p FROM f)"]
    for n in range(rounds):
        out += [_scatter_sql(n, f"p{n}"), f"p{n + 1} AS MATERIALIZED (SELECT view, y, x, {1 - damping} * p + {damping} * greatest({1.5 * S.FLOOR!r}, data - {SCALE} * greatest(s, 0.0)) AS p FROM p{n} JOIN s{n} USING (view, y, x) JOIN f USING (view, y, x))"]
    return ",\n".join(out) + f" SELECT view, y * 8 + x AS u, {R('p')} AS primary FROM p{rounds}"


@query("damped_scatter", _rounds_sql(3, 0.6).replace("AS primary", 'AS "primary"'))
def _(spark, d):
    return _pixels(S.fixed_scatter(shots(spark, d), MODEL, BELOW, 3, 0.6, SCALE), "primary")


@query("adaptive_scatter", _adaptive_sql() + f' SELECT view, y * 8 + x AS u, {R("p")} AS "primary" FROM px{TRIALS}')
def _(spark, d):
    return _pixels(S.adaptive_scatter(shots(spark, d), MODEL, BELOW, HOW, SCALE), "primary")


@query(
    "adaptive_scatter_report",
    _adaptive_sql()
    + f""", lo AS (SELECT view, data / 1.5 AS low, row_number() OVER (PARTITION BY view ORDER BY data) - 1 AS i, count(*) OVER (PARTITION BY view) AS n FROM f WHERE data < {BELOW} * 1.5)
SELECT view, iterations, predictions, rejected, limited, {R('damping')} AS damping, {R('residual')} AS residual, {R('change')} AS change, {R('coalesce(low, 1.0)')} AS low, coalesce(low < {HOW.risk}, false) AS risk, status
FROM st{TRIALS} LEFT JOIN (SELECT view, low FROM lo WHERE i = floor({HOW.quantile} * (n - 1))) USING (view)""",
)
def _(spark, d):
    rows = S.adaptive_scatter(shots(spark, d), MODEL, BELOW, HOW, SCALE)
    return rows.select("view", "iterations", "predictions", "rejected", "limited", *(tidy(F.col(c)).alias(c) for c in ("damping", "residual", "change", "low")), "risk", "status")

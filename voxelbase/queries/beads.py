"""Assignment and tracking of beads: every row of ``embeddings`` is a view of a scan of fifty."""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelbase.functions.scalar import tidy
from voxelbase.plans import tracks as T

R = lambda e, n=6: f"(round({e}, {n}) + 0.0)"
QUERIES, ORACLES = {}, {}
VIEWS, ANCHOR, GATE, NEAR = 50, 20, 6.0, 3.5


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _rows(spark, d):
    e = F.col("embedding").cast("array<double>")
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.floor(F.col("vec_id") / VIEWS).alias("scan"), (F.col("vec_id") % VIEWS).alias("step"), e.alias("e"))


def _path(step: Column, t: int) -> tuple[Column, Column]:
    turn = step * (2 * math.pi / VIEWS)
    return 20.0 + 5 * t + 4 * F.sin(turn + t), 40.0 + 18 * F.cos(turn + 0.9 * t)


def centres(spark, d):
    """(scan, step, y, x): beads with noise, some missing, the first two as one blob when close, and strays."""
    rows = _rows(spark, d)
    at = []
    for t in range(3):
        y, x = _path(F.col("step"), t)
        at.append((y + F.col("e")[2 * t] * 2, x + F.col("e")[2 * t + 1] * 2, F.col("e")[7 + t] < 0.15))
    (y0, x0, on0), (y1, x1, on1), (y2, x2, on2) = at
    blob = on0 & on1 & ((y0 - y1) * (y0 - y1) + (x0 - x1) * (x0 - x1) < NEAR * NEAR)
    stray = F.col("e")[11] > 0.1
    spots = [
        F.when(blob, F.struct(((y0 + y1) / 2).alias("y"), ((x0 + x1) / 2).alias("x"))).when(on0, F.struct(y0.alias("y"), x0.alias("x"))),
        F.when(on1 & ~blob, F.struct(y1.alias("y"), x1.alias("x"))),
        F.when(on2, F.struct(y2.alias("y"), x2.alias("x"))),
        F.when(stray, F.struct((200 * F.abs(F.col("e")[12])).alias("y"), (200 * F.abs(F.col("e")[13])).alias("x"))),
    ]
    spots = F.filter(F.array(*spots), lambda s: s.isNotNull())
    return rows.select("scan", "step", F.transform(spots, lambda s: s["y"]).alias("y"), F.transform(spots, lambda s: s["x"]).alias("x"))


def anchors(spark, d):
    places = [_path(F.lit(ANCHOR), t) for t in range(3)]
    return _rows(spark, d).where(F.col("step") == ANCHOR).select("scan", "step", F.array(*(p[0] for p in places)).alias("y"), F.array(*(p[1] for p in places)).alias("x"))


def _centres_sql() -> str:
    turn = 2 * math.pi / VIEWS
    path = lambda t, s: (f"20.0 + 5 * {t} + 4 * sin({s} * {turn!r} + {t})", f"40.0 + 18 * cos({s} * {turn!r} + {0.9 * t!r})")
    beads = ", ".join(f"{path(t, 'step')[0]} + e[{2 * t + 1}] * 2 AS y{t}, {path(t, 'step')[1]} + e[{2 * t + 2}] * 2 AS x{t}, e[{8 + t}] < 0.15 AS on{t}" for t in range(3))
    anchor = [[path(t, f"{ANCHOR}")[k] for t in range(3)] for k in (0, 1)]
    return f"""e0 AS (SELECT vec_id // {VIEWS} AS scan, vec_id % {VIEWS} AS step, list_transform(embedding, lambda q: q::double) AS e FROM embeddings),
e1 AS (SELECT scan, step, e, {beads} FROM e0),
e2 AS (SELECT *, on0 AND on1 AND (y0 - y1) * (y0 - y1) + (x0 - x1) * (x0 - x1) < {NEAR * NEAR} AS blob FROM e1),
e3 AS (SELECT scan, step, list_filter([CASE WHEN blob THEN [(y0 + y1) / 2, (x0 + x1) / 2] WHEN on0 THEN [y0, x0] END, CASE WHEN on1 AND NOT blob THEN [y1, x1] END, CASE WHEN on2 THEN [y2, x2] END,
  CASE WHEN e[12] > 0.1 THEN [200 * abs(e[13]), 200 * abs(e[14])] END], lambda s: s IS NOT NULL) AS c FROM e2),
an AS (SELECT scan, [[{'], ['.join(f'{anchor[0][t]}, {anchor[1][t]}' for t in range(3))}]] AS places FROM e0 WHERE step = {ANCHOR})"""


def _match_sql(source: str) -> str:
    """``source`` (c: centres, p: three predictions) with own: the centre of each, d: squared distances, share: near predictions of that centre."""
    perms = "[" + ", ".join(str([i + 1 for i in p]) for p in permutations(range(4), 3)) + "]"
    sq = lambda a, b: f"(({a})[1] - ({b})[1]) * (({a})[1] - ({b})[1]) + (({a})[2] - ({b})[2]) * (({a})[2] - ({b})[2])"
    cost = " + ".join(sq(f"c[q[{t}]]", f"p[{t}]") for t in (1, 2, 3))
    nearest = ", ".join(f"list_position(list_transform(c, lambda k: {sq('k', f'p[{t}]')}), list_min(list_transform(c, lambda k: {sq('k', f'p[{t}]')})))" for t in (1, 2, 3))
    one = f"(SELECT *, list_filter({perms}, lambda q: list_max(q) <= len(c)) AS ways FROM {source})"
    two = f"(SELECT *, list_transform(ways, lambda q: {cost}) AS costs FROM {one})"
    three = f"(SELECT *, CASE WHEN len(c) >= 3 THEN ways[list_position(costs, list_min(costs))] WHEN len(c) > 0 THEN [{nearest}] ELSE [0, 0, 0] END AS own FROM {two})"
    four = f"(SELECT *, [{', '.join(f'coalesce({sq(f"c[own[{t}]]", f"p[{t}]")} <= {GATE * GATE}, false)' for t in (1, 2, 3))}] AS near FROM {three})"
    return f"(SELECT *, [{', '.join('+'.join(f'(near[{t}] AND near[{u}] AND own[{t}] = own[{u}])::int' for u in (1, 2, 3)) for t in (1, 2, 3))}] AS share FROM {four})"


PLACES = "[" + ", ".join(f"CASE WHEN share[{t}] = 1 THEN c[own[{t}]] ELSE p[{t}] END" for t in (1, 2, 3)) + "]"


@query(
    "exact_assignment",
    f"""WITH {_centres_sql()}, m AS (SELECT scan, step, share, {PLACES} AS places FROM {_match_sql('(SELECT e3.*, places AS p FROM e3, (SELECT any_value(places) AS places FROM an))')})
SELECT scan, step, t::int - 1 AS target, {R('places[t][1]')} AS y, {R('places[t][2]')} AS x, share[t] = 1 AS observed, share[t] > 1 AS merged FROM m, range(1, 4) r(t)""",
)
def _(spark, d):
    """Every view's centres given to three fixed places, one to one where there are enough."""
    turn = ANCHOR * 2 * math.pi / VIEWS
    fixed = np.array([(20.0 + 5 * t + 4 * math.sin(turn + t), 40.0 + 18 * math.cos(turn + 0.9 * t)) for t in range(3)])

    def step(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                c = np.stack([batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in "yx"], axis=1)
                places, seen, merged = T.match_centres(c, fixed, GATE)
                columns = [[batch.column("scan")[i].as_py()] * 3, [batch.column("step")[i].as_py()] * 3, np.arange(3, dtype=np.int32), places[:, 0], places[:, 1], seen, merged]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=T.TRACK_NAMES)

    return _tidy(centres(spark, d).mapInArrow(step, T.TRACK))


def _tidy(rows):
    return rows.select("scan", "step", "target", tidy(F.col("y")).alias("y"), tidy(F.col("x")).alias("x"), "observed", "merged")


AHEAD = "[" + ", ".join(f"[q[{t}][1] + s[{t}][1], q[{t}][2] + s[{t}][2]]" for t in (1, 2, 3)) + "]"


def _track_sql() -> str:
    moved = "[" + ", ".join(f"[places[{t}][1] - q[{t}][1], places[{t}][2] - q[{t}][2]]" for t in (1, 2, 3)) + "]"
    ahead = f"(SELECT tr.scan, way, off + 1 AS off, q, {AHEAD} AS p, e3.c FROM tr JOIN e3 ON e3.scan = tr.scan AND e3.step = {ANCHOR} + way * (off + 1))"
    return f"""WITH RECURSIVE {_centres_sql()}, tr AS (
SELECT scan, way, 0::bigint AS off, places AS q, [[0.0::double, 0.0], [0.0, 0.0], [0.0, 0.0]] AS s, [1, 1, 1] AS share FROM an, (VALUES (-1), (1)) w(way)
UNION ALL SELECT scan, way, off, places, {moved}, share FROM (SELECT *, {PLACES} AS places FROM {_match_sql(ahead)}))
SELECT scan, {ANCHOR} + way * off AS step, t::int - 1 AS target, {R('q[t][1]')} AS y, {R('q[t][2]')} AS x, share[t] = 1 AS observed, share[t] > 1 AS merged FROM tr, range(1, 4) r(t) WHERE off > 0 OR way > 0"""


@query("bead_tracks", _track_sql())
def _(spark, d):
    return _tidy(T.track(centres(spark, d), anchors(spark, d), T.Tracker(gate=GATE)))


@query("bead_tracks_filled", None)
def _(spark, d):
    """Unobserved places by a periodic cubic spline, null for targets seen too rarely; held against a dense solution in the tests."""
    return _tidy(T.fill_periodic(T.track(centres(spark, d), anchors(spark, d), T.Tracker(gate=GATE)), VIEWS, strict=False))


NY, NX = 48, 72


def planes(spark, d):
    """(z, data): images of three beads each, brighter or dimmer by the row's values."""
    beads = [(*_path(F.col("step"), t), 1.0 - 2 * F.abs(F.col("e")[7 + t])) for t in range(3)]
    y, x, a = (F.array(*(bead[k] + (F.col("e")[2 * t + k] if k < 2 else 0.0) for t, bead in enumerate(beads))) for k in range(3))

    def draw(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                y, x, a = (batch.column(c)[i].values.to_numpy(zero_copy_only=False)[:, None] for c in "yxa")
                image = (a * np.exp(-((np.arange(NY) - y) ** 2) / 2)).T @ np.exp(-((np.arange(NX) - x) ** 2) / 2)
                yield pa.RecordBatch.from_arrays([batch.column("z").slice(i, 1), pa.array([image.ravel()])], names=["z", "data"])

    return _rows(spark, d).select(F.col("vec_id").alias("z"), y.alias("y"), x.alias("x"), a.alias("a")).mapInArrow(draw, "z long, data array<double>")


@query("bead_pixel_tracks", None)
def _(spark, d):
    """Pixels of every image owned by the nearest prediction; held against a plain loop in the tests."""
    pixels = T.foreground(planes(spark, d), NY, NX, 0.3).withColumn("scan", F.floor(F.col("z") / VIEWS)).withColumn("step", F.col("z") % VIEWS)
    return _tidy(T.track(pixels, anchors(spark, d), T.Tracker(gate=GATE, pixels=True, least=2, bridge=2, size=(NY, NX))))

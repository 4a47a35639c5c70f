"""Beads followed through the views of a scan: from an anchor view outward in both directions.

A view is one row of foreground pixels or of components' centres. A direction of a scan is a sequence of
rows that arrive sorted; a task carries the targets' last two places and holds one batch of views, however
long the scan is. Scans and their directions are independent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelbase.operators.tiles import labels

#: Views of one target that must be seen before the others are filled in.
VISIBLE = 8
#: Distances of pixels to targets held at once.
CELLS = 1 << 20


def assign(cost: np.ndarray) -> np.ndarray:
    """The column of each row in the cheapest one-to-one assignment; at least as many columns as rows.

    Rows are added one at a time along a cheapest augmenting path, prices keep reduced costs at 0 or more.
    """
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    row_price, price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        reach, before = np.full(m, np.inf), np.full(m, -1)
        done, row, at, base = np.zeros(m, bool), start, -1, 0.0
        while True:
            through = base + cost[row] - row_price[row] - price
            better = ~done & (through < reach)
            reach[better], before[better] = through[better], at
            at = int(np.argmin(np.where(done, np.inf, reach)))
            base, done[at] = reach[at], True
            if owner[at] < 0:
                break
            row = owner[at]
        inside = np.flatnonzero(done & (owner >= 0))
        row_price[owner[inside]] += base - reach[inside]
        row_price[start] += base
        price[done] -= base - reach[done]
        while at >= 0:
            last = before[at]
            owner[at] = owner[last] if last >= 0 else start
            at = last
    out = np.empty(n, dtype=int)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def match_centres(centres: np.ndarray, predicted: np.ndarray, gate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, seen, merged) of targets among components' centres (n, 2).

    With a component for every target each gets its own, at least total squared distance. With fewer, components
    may serve several targets, so each target takes the nearest one (ties: the first); targets that share one
    within the gate are merged. A target without a centre of its own within the gate keeps its prediction.
    """
    n, count = len(predicted), len(centres)
    places, seen, merged = predicted.copy(), np.zeros(n, bool), np.zeros(n, bool)
    if not count:
        return places, seen, merged
    squared = ((predicted[:, None] - centres[None]) ** 2).sum(axis=2)
    own = assign(squared) if count >= n else squared.argmin(axis=1)
    near = squared[np.arange(n), own] <= gate * gate
    sharing = np.bincount(own[near], minlength=count)
    seen = near & (sharing[own] == 1)
    merged = near & (sharing[own] > 1)
    places[seen] = centres[own[seen]]
    return places, seen, merged


def match_pixels(pixels: np.ndarray, weight: np.ndarray, component: np.ndarray, predicted: np.ndarray, gate: float, least: int, size: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, seen, merged) of targets among foreground pixels (n, 2).

    A pixel belongs to the nearest prediction (ties: the first) if that lies within the gate; a target's place is
    the weighted mean of its pixels, ``least`` of them at least. Targets are merged when the foreground pixels nearest to
    their rounded predictions (ties: the first pixel) are of one component and within the gate; predictions that round to a place
    outside ``size`` take no part in that.
    """
    n = len(predicted)
    places, seen, merged = predicted.copy(), np.zeros(n, bool), np.zeros(n, bool)
    known = np.isfinite(predicted).all(axis=1)
    if not len(pixels) or not known.any():
        return places, seen, merged
    owner, far = np.empty(len(pixels), int), np.empty(len(pixels))
    for a in range(0, len(pixels), max(1, CELLS // n)):
        b = a + max(1, CELLS // n)
        squared = np.where(known, ((pixels[a:b, None] - predicted[None]) ** 2).sum(axis=2), np.inf)
        owner[a:b], far[a:b] = squared.argmin(axis=1), squared.min(axis=1)
    mine = far <= gate * gate
    sums = [np.bincount(owner[mine], weights=w, minlength=n) for w in (weight[mine], *(weight[mine] * pixels[mine, k] for k in (0, 1)))]
    seen = np.bincount(owner[mine], minlength=n) >= least
    places[seen] = np.stack([sums[1][seen] / sums[0][seen], sums[2][seen] / sums[0][seen]], axis=1)
    home = np.full(n, -1)
    for k in np.flatnonzero(known):
        place = np.rint(predicted[k])
        if size and not ((place >= 0) & (place < size)).all():
            continue
        nearest = ((pixels - place) ** 2).sum(axis=1).argmin()
        if ((pixels[nearest] - predicted[k]) ** 2).sum() <= gate * gate:
            home[k] = component[nearest]
    for c in np.unique(home[home >= 0]):
        if (home == c).sum() > 1:
            merged |= home == c
    return places, seen, merged


@dataclass(frozen=True)
class Tracker:
    """``pixels``: views hold foreground pixels, else centres. ``least``: pixels of a target.

    ``bridge``: views in a row that a target may be neither seen nor merged before it is given up (None: any number).
    ``size``: (ny, nx) outside which a prediction is given up (None: anywhere).
    """

    gate: float
    pixels: bool = False
    least: int = 1
    bridge: int | None = None
    size: tuple[int, int] | None = None


TRACK = "scan long, step long, target int, y double, x double, observed boolean, merged boolean"
VIEW = ("y", "x", "weight", "component")


def foreground(planes: DataFrame, ny: int, nx: int, threshold: float) -> DataFrame:
    """(z, y, x, weight, component arrays): pixels of planes (z, data) above ``threshold``, one row a plane, in row-major order.

    Weights are value - threshold, 1e-6 at least; components as in ``tiles.components``. A plane without any has empty arrays.
    """

    def step(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("data")[i].values.to_numpy(zero_copy_only=False).reshape(1, ny, nx)
                hit = data > threshold
                _, y, x = np.nonzero(hit)
                columns = [y, x, np.maximum(data[0, y, x] - threshold, 1e-6), labels(hit)[0, y, x]]
                yield pa.RecordBatch.from_arrays([batch.column("z").slice(i, 1), *(pa.array([np.asarray(c, float if k < 3 else np.int64)]) for k, c in enumerate(columns))], names=["z", *VIEW])

    return planes.select(F.col("z").cast("long").alias("z"), "data").mapInArrow(step, "z long, y array<double>, x array<double>, weight array<double>, component array<long>")


def track(views: DataFrame, anchors: DataFrame, how: Tracker) -> DataFrame:
    """``TRACK`` of the targets of every scan in every view.

    ``views`` (scan, step, y, x, weight, component: arrays; without the last two where views hold centres) has a
    row for each view, with empty or null arrays if nothing was found. ``anchors`` (scan, step, y, x: arrays) names the targets'
    places in one view of each scan, two of a scan stop the query. Targets move on by their last step; a view that is missing stretches
    it. Of several rows of a view one counts; places with a null are passed over. Scans without an anchor give no rows,
    anchors of scans without views give the anchor's. ``observed`` is measured; other targets, merged or not, rest on their
    prediction, and are null once given up. One direction of a scan is one task's work, since each
    view needs the one before, but not its memory.
    """
    empty = [F.lit(None).cast("array<long>" if c == "component" else "array<double>").alias(c) for c in VIEW]
    held = [F.col(c).cast("array<long>" if c == "component" else "array<double>").alias(c) if how.pixels or c in "yx" else empty[k] for k, c in enumerate(VIEW)]
    start = anchors.select(F.col("scan").cast("long").alias("scan"), F.col("step").cast("long").alias("anchor"), *held[:2])
    body = views.select(F.col("scan").cast("long").alias("scan"), F.col("step").cast("long").alias("step"), *held).join(start.select("scan", "anchor"), "scan")
    body = body.where("step <> anchor").select("scan", F.signum(F.col("step") - F.col("anchor")).cast("int").alias("way"), F.abs(F.col("step") - F.col("anchor")).alias("off"), "anchor", *VIEW)
    start = start.select("scan", F.explode(F.array(F.lit(-1), F.lit(1))).alias("way"), F.lit(0).cast("long").alias("off"), "anchor", "y", "x", *empty[2:])
    rows = body.unionByName(start).repartition("scan", "way").sortWithinPartitions("scan", "way", "off")

    def run(batches):
        key, last, off, speed, lost, active = None, None, 0, None, None, None
        for batch in batches:
            out = [[] for _ in range(7)]
            for i in range(batch.num_rows):
                scan, way, here, anchor = (batch.column(c)[i].as_py() for c in ("scan", "way", "off", "anchor"))
                y, x, weight, component = (np.asarray([] if batch.column(c)[i].values is None else batch.column(c)[i].values.to_numpy(zero_copy_only=False)) for c in VIEW)
                places = np.stack([y, x], axis=1).astype(float)
                ok = np.isfinite(places).all(axis=1)
                if here:
                    places = places[ok]
                    if here == off:
                        continue
                if here == 0:
                    if key == (scan, way):
                        raise ValueError(f"scan {scan} has two anchors")
                    key, last, off, speed = (scan, way), places, 0, np.zeros_like(places)
                    lost, active = np.zeros(len(places), int), np.ones(len(places), bool)
                    seen, merged = active.copy(), np.zeros(len(places), bool)
                    if way < 0:
                        continue  # the other direction tells of it
                else:
                    ahead = last + (here - off) * speed
                    inside = active.copy()
                    if how.size:
                        inside &= ((ahead >= 0) & (ahead < how.size)).all(axis=1)
                    if how.pixels:  # targets on their way out still own the pixels near them
                        found, seen, merged = match_pixels(places, weight[ok], component[ok], ahead, how.gate, how.least, how.size)
                        seen, merged = seen & inside, merged & inside
                    else:
                        found, seen, merged = ahead.copy(), np.zeros(len(last), bool), np.zeros(len(last), bool)
                        on = np.flatnonzero(inside)
                        if len(on):
                            found[on], seen[on], merged[on] = match_centres(places, ahead[on], how.gate)
                    lost = np.where(seen | merged, 0, lost + 1)
                    active = inside & ((lost <= how.bridge) if how.bridge is not None else True)
                    found[~active] = np.nan
                    seen, merged = seen & active, merged & active
                    speed, last, off = (found - last) / (here - off), found, here
                n = len(last)
                values = [np.full(n, scan), np.full(n, anchor + way * here), np.arange(n), last[:, 0], last[:, 1], seen, merged]
                for column, v in zip(out, values, strict=True):
                    column.append(v)
            if out[0]:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_())
                columns = [np.concatenate(c) for c in out]
                yield pa.RecordBatch.from_arrays([pa.array(c, t, mask=np.isnan(c) if t == pa.float64() else None) for c, t in zip(columns, types, strict=True)], names=TRACK_NAMES)

    return rows.mapInArrow(run, TRACK)


TRACK_NAMES = ["scan", "step", "target", "y", "x", "observed", "merged"]


def spline_slopes(t: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Slopes at the knots of the cubic spline through (n, k) values whose first and last two pieces are one cubic each; n > 3."""
    h = np.diff(t)[:, None]
    d = np.diff(values, axis=0) / h
    low, main, high = h[1:], 2 * (h[1:] + h[:-1]), h[:-1]
    a, b = h[0] + h[1], h[-1] + h[-2]
    first = ((h[0] + 2 * a) * h[1] * d[0] + h[0] ** 2 * d[1]) / a
    final = (h[-1] ** 2 * d[-2] + (2 * b + h[-1]) * h[-2] * d[-1]) / b
    right = np.concatenate([first[None], 3 * (h[1:] * d[:-1] + h[:-1] * d[1:]), final[None]])
    lower = np.concatenate([[[0.0]], low, [b]])[:, 0]
    diagonal = np.concatenate([[h[1]], main, [h[-2]]])[:, 0]
    upper = np.concatenate([[a], high, [[0.0]]])[:, 0]
    for i in range(1, len(t)):
        w = lower[i] / diagonal[i - 1]
        diagonal[i] -= w * upper[i - 1]
        right[i] -= w * right[i - 1]
    out = np.empty_like(right)
    out[-1] = right[-1] / diagonal[-1]
    for i in range(len(t) - 2, -1, -1):
        out[i] = (right[i] - upper[i] * out[i + 1]) / diagonal[i]
    return out


def periodic_spline(t: np.ndarray, values: np.ndarray, period: float, at: np.ndarray) -> np.ndarray:
    """The cubic spline through three periods of (n, k) values at ``t``, read at ``at`` within the middle one."""
    knots = np.concatenate([t - period, t, t + period])
    y = np.tile(values, (3, 1))
    m = spline_slopes(knots, y)
    i = np.clip(np.searchsorted(knots, at, "right") - 1, 0, len(knots) - 2)
    h = (knots[i + 1] - knots[i])[:, None]
    f = (at - knots[i])[:, None] / h
    g = 1 - f
    return g * g * ((1 + 2 * f) * y[i] + f * h * m[i]) + f * f * ((1 + 2 * g) * y[i + 1] - g * h * m[i + 1])


def fill_periodic(tracks: DataFrame, period: int, strict: bool = True) -> DataFrame:
    """``tracks`` (``TRACK``) with unobserved places from a periodic cubic spline through the observed ones.

    Observed places stay. A group is one target of one scan (24 bytes a view). A target seen in fewer than
    ``VISIBLE`` views, unless in all, stops the query; if not ``strict`` its unobserved places are null.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("step")
        seen = table.column("observed").to_numpy()
        if seen.all():
            return table
        few = seen.sum() < VISIBLE
        if few and strict:
            raise ValueError(f"target {table.column('target')[0]} of scan {table.column('scan')[0]} is seen in too few views")
        step = table.column("step").to_numpy().astype(float)
        places = np.stack([table.column(c).to_numpy().astype(float) for c in "yx"], axis=1)
        places[~seen] = np.nan if few else periodic_spline(step[seen], places[seen], period, step[~seen])
        for k, c in enumerate("yx"):
            table = table.set_column(table.schema.get_field_index(c), c, pa.array(places[:, k], mask=np.isnan(places[:, k])))
        return table

    return tracks.select(*TRACK_NAMES).groupBy("scan", "target").applyInArrow(run, TRACK)

"""Assignment, tracking and periodic filling against brute force."""

import math
from itertools import permutations

import numpy as np
import pytest

from voxelbase.plans import tracks as T
from voxelbase.queries import beads

RNG = np.random.default_rng(11)
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n,m", [(1, 1), (2, 5), (4, 4), (5, 7)])
def test_assignment_is_the_cheapest_of_all(n, m):
    for k in range(60):
        cost = RNG.integers(0, 6, (n, m)).astype(float) if k % 2 else RNG.normal(size=(n, m))
        own = T.assign(cost)
        assert len(set(own)) == n
        assert cost[range(n), own].sum() == pytest.approx(min(cost[range(n), list(p)].sum() for p in permutations(range(m), n)))


def test_assignment_refuses_more_rows_than_columns():
    with pytest.raises(ValueError):
        T.assign(np.zeros((3, 2)))


def test_merged_blobs_and_gate():
    predicted = np.array([[0.0, 0.0], [0.0, 4.0], [50.0, 50.0], [90.0, 0.0]])
    centres = np.array([[0.0, 2.0], [51.0, 50.0], [300.0, 300.0]])
    places, seen, merged = T.match_centres(centres, predicted, 25.0)
    assert seen.tolist() == [False, False, True, False] and merged.tolist() == [True, True, False, False]
    np.testing.assert_array_equal(places, [[0, 0], [0, 4], [51, 50], [90, 0]])
    for nothing in (np.zeros((0, 2)), np.full((1, 2), 1e6)):
        places, seen, merged = T.match_centres(nothing, predicted, 25.0)
        assert not seen.any() and not merged.any() and (places == predicted).all()


def brute_pixels(pixels, weight, component, predicted, gate, least):
    """Pixel by pixel and target by target."""
    sums = [[0.0, 0.0, 0.0, 0] for _ in predicted]
    for (y, x), w in zip(pixels, weight, strict=True):
        gaps = [math.hypot(y - a, x - b) if math.isfinite(a) else math.inf for a, b in predicted]
        k = gaps.index(min(gaps))
        if gaps[k] <= gate:
            sums[k] = [sums[k][0] + w, sums[k][1] + w * y, sums[k][2] + w * x, sums[k][3] + 1]
    home = []
    for a, b in predicted:
        if not math.isfinite(a):
            home.append(None)
            continue
        near = min(range(len(pixels)), key=lambda i: (pixels[i][0] - round(a)) ** 2 + (pixels[i][1] - round(b)) ** 2)  # noqa: B023
        home.append(component[near] if math.hypot(pixels[near][0] - a, pixels[near][1] - b) <= gate else None)
    seen = [s[3] >= least for s in sums]
    places = [(s[1] / s[0], s[2] / s[0]) if ok else p for s, ok, p in zip(sums, seen, predicted, strict=True)]
    return places, seen, [h is not None and home.count(h) > 1 for h in home]


@pytest.mark.parametrize("cells", [4, 1 << 20])
def test_pixels_equal_a_plain_loop(monkeypatch, cells):
    monkeypatch.setattr(T, "CELLS", cells)
    for _ in range(30):
        pixels = np.unique(RNG.integers(0, 30, (40, 2)), axis=0).astype(float)
        weight, component = RNG.uniform(0.1, 1, len(pixels)), RNG.integers(0, 6, len(pixels))
        predicted = RNG.uniform(0, 30, (4, 2))
        predicted[3] = np.nan
        got = T.match_pixels(pixels, weight, component, predicted, 4.0, 3)
        want = brute_pixels(pixels.tolist(), weight.tolist(), component.tolist(), [tuple(p) for p in predicted], 4.0, 3)
        np.testing.assert_allclose(got[0], np.array(want[0]))
        assert got[1].tolist() == want[1] and got[2].tolist() == want[2]


def test_foreground_of_planes(spark):
    planes = spark.createDataFrame([(3, [0.0, 0.9, 0.0, 0.0, 0.0, 0.8, 0.7, 0.0, 0.0]), (4, [0.0] * 9)], "z long, data array<double>")
    rows = {r.z: r for r in T.foreground(planes, 3, 3, 0.5).collect()}
    assert rows[3].y == [0, 1, 2] and rows[3].x == [1, 2, 0] and rows[3].component == [1, 1, 6]
    assert rows[3].weight == pytest.approx([0.4, 0.3, 0.2]) and rows[4].y == []


def views(spark, rows):
    return spark.createDataFrame(rows, "scan long, step long, y array<double>, x array<double>")


def test_tracks_both_ways_with_gaps_and_repeats(spark):
    """A target at (step, 2 step): step 4 isn't there, step 6 has no centres, step 5 comes twice, step 1 holds a null place."""
    at = {s: ([float(s)], [2.0 * s]) for s in range(9) if s != 4}
    at[6], at[1] = (None, None), ([1.0, None], [2.0, 3.0])
    rows = [(1, s, *p) for s, p in at.items()] + [(1, 5, *at[5]), (9, 0, [0.0], [0.0])]
    anchors = spark.createDataFrame([(1, 2, [2.0], [4.0], "x"), (7, 0, [5.0], [5.0], "y")], "scan long, step long, y array<double>, x array<double>, target string")
    got = sorted((r.scan, r.step, r.y, r.x, r.observed, r.merged) for r in T.track(views(spark, rows), anchors, T.Tracker(gate=3.0)).collect())
    assert got == [(1, s, float(s), 2.0 * s, s != 6, False) for s in at if s in range(9)] + [(7, 0, 5.0, 5.0, True, False)]


def test_given_up_and_merged(spark):
    rows = [(1, s, [0.0, 10.0] if s < 3 else [0.0], [0.0, 0.0] if s < 3 else [0.0]) for s in range(6)]
    anchors = views(spark, [(1, 0, [0.0, 10.0], [0.0, 0.0])])
    got = {(r.step, r.target): (r.y, r.observed, r.merged) for r in T.track(views(spark, rows), anchors, T.Tracker(gate=4.0, bridge=1)).collect()}
    assert got[3, 1] == (10.0, False, False) and got[4, 1] == got[5, 1] == (None, False, False)
    assert all(got[s, 0] == (0.0, True, False) for s in range(6))
    both = [(1, s, [0.0] if s else [0.0, 2.0], [0.0] if s else [0.0, 0.0]) for s in range(3)]
    got = T.track(views(spark, both), views(spark, [(1, 0, [0.0, 2.0], [0.0, 0.0])]), T.Tracker(gate=4.0, bridge=0)).where("step > 0").collect()
    assert len(got) == 4 and all(r.merged and not r.observed for r in got)


def test_two_anchors_stop_and_empty_tables(spark):
    one = views(spark, [(1, 0, [0.0], [0.0])])
    with pytest.raises(Exception, match="two anchors"):
        T.track(one, one.unionAll(one), T.Tracker(gate=1.0)).collect()
    assert T.track(one.limit(0), one.limit(0), T.Tracker(gate=1.0)).count() == 0
    assert T.fill_periodic(T.track(one.limit(0), one.limit(0), T.Tracker(gate=1.0)), 10).count() == 0


def dense_spline(t, v, at):
    """Second derivatives from a full linear system; third derivatives agree at the second and the last but one knot."""
    n, h = len(t), np.diff(t)
    a, r = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1] / 6, (h[i - 1] + h[i]) / 3, h[i] / 6
        r[i] = (v[i + 1] - v[i]) / h[i] - (v[i] - v[i - 1]) / h[i - 1]
    a[0, :3] = -1 / h[0], 1 / h[0] + 1 / h[1], -1 / h[1]
    a[-1, -3:] = -1 / h[-2], 1 / h[-2] + 1 / h[-1], -1 / h[-1]
    m = np.linalg.solve(a, r)
    i = np.searchsorted(t, at) - 1
    lo, hi = t[i + 1] - at, at - t[i]
    return (m[i] * lo**3 + m[i + 1] * hi**3) / (6 * h[i]) + (v[i] / h[i] - m[i] * h[i] / 6) * lo + (v[i + 1] / h[i] - m[i + 1] * h[i] / 6) * hi


def test_spline_equals_a_dense_solution():
    t = np.sort(RNG.choice(40, 13, replace=False)).astype(float)
    gaps = np.setdiff1d(np.arange(40.0), t)
    values = RNG.normal(size=(13, 2))
    got = T.periodic_spline(t, values, 40, gaps)
    knots = np.concatenate([t - 40, t, t + 40])
    for k in (0, 1):
        np.testing.assert_allclose(got[:, k], dense_spline(knots, np.tile(values[:, k], 3), gaps), atol=1e-9)


def test_filled_tracks_of_the_tables(spark):
    """Whole query: observed places stay, the others equal the dense spline through them."""
    tracks = beads.QUERIES["bead_tracks"](spark, SF).toPandas().sort_values(["scan", "target", "step"])
    filled = beads.QUERIES["bead_tracks_filled"](spark, SF).toPandas().sort_values(["scan", "target", "step"])
    checked = 0
    for (a, own), (b, new) in zip(tracks.groupby(["scan", "target"]), filled.groupby(["scan", "target"]), strict=True):
        assert a == b and len(own) == len(new) == beads.VIEWS
        seen = own.observed.to_numpy()
        t = own.step.to_numpy(float)
        knots = np.concatenate([t[seen] - 50, t[seen], t[seen] + 50])
        for c in "yx":
            v = own[c].to_numpy(float)
            want = v.copy()
            want[~seen] = dense_spline(knots, np.tile(v[seen], 3), t[~seen])
            np.testing.assert_allclose(new[c].to_numpy(float), want, atol=1e-4)
        checked += (~seen).sum()
    assert checked > 50 and tracks.merged.any()


def test_too_few_views_stop(spark):
    rows = spark.createDataFrame([(1, s, 0, 1.0, 1.0, s < 7, False) for s in range(9)], T.TRACK)
    with pytest.raises(Exception, match="too few views"):
        T.fill_periodic(rows, 9).collect()
    assert [r.y for r in T.fill_periodic(rows, 9, strict=False).orderBy("step").collect()] == [1.0] * 7 + [None] * 2
    assert T.fill_periodic(rows.where("step < 7"), 9).count() == 7


def test_pixel_tracks_of_the_tables(spark):
    """Whole query against a sequential loop over the images in numpy."""
    got = {(r.scan, r.step, r.target): r for r in beads.QUERIES["bead_pixel_tracks"](spark, SF).collect()}
    images = {r.z: np.array(r.data).reshape(beads.NY, beads.NX) for r in beads.planes(spark, SF).collect()}
    starts = {r.scan: np.stack([r.y, r.x], axis=1) for r in beads.anchors(spark, SF).collect()}
    assert len(got) == 3 * len(images)
    for scan, start in starts.items():
        for way in (-1, 1):
            last, before, lost, active = start, None, np.zeros(3, int), np.ones(3, bool)
            step = beads.ANCHOR + way
            while 0 <= step < beads.VIEWS:
                image = images[scan * beads.VIEWS + step]
                ahead = last if before is None else 2 * last - before
                inside = active & ((ahead >= 0) & (ahead < (beads.NY, beads.NX))).all(axis=1)
                hit = np.argwhere(image > 0.3)
                label = _flood(image > 0.3)
                places, seen, merged = brute_pixels(hit.tolist(), [max(image[y, x] - 0.3, 1e-6) for y, x in hit], [label[y, x] for y, x in hit], [tuple(p) for p in ahead], beads.GATE, 2)
                seen, merged = np.array(seen) & inside, np.array(merged) & inside
                lost = np.where(seen | merged, 0, lost + 1)
                active = inside & (lost <= 2)
                before, last = last, np.where(active[:, None], np.array(places), np.nan)
                for k in range(3):
                    r = got[scan, step, k]
                    assert (r.observed, r.merged) == (seen[k] and active[k], merged[k] and active[k])
                    np.testing.assert_allclose([np.nan if r.y is None else r.y, np.nan if r.x is None else r.x], last[k], atol=1e-5)
                step += way


def _flood(hit):
    """Component of each pixel by flooding from its first pixel."""
    label = np.full(hit.shape, -1)
    for start in map(tuple, np.argwhere(hit)):
        if label[start] >= 0:
            continue
        name, todo = start[0] * hit.shape[1] + start[1], [start]
        label[start] = name
        while todo:
            y, x = todo.pop()
            for b in range(max(0, y - 1), min(hit.shape[0], y + 2)):
                for a in range(max(0, x - 1), min(hit.shape[1], x + 2)):
                    if hit[b, a] and label[b, a] < 0:
                        label[b, a] = name
                        todo.append((b, a))
    return label

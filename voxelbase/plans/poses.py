"""Cameras of many views: matrices by view, their parts, and one joint least-squares fit of all poses.

A view's points reach the solvers as sums: products of moved and scaled points for its own matrix, normal blocks
of chunks of its points for the joint fit. There each view's six pose unknowns are eliminated from its own blocks
(Schur complement), so what is summed over views, and all that the driver sees, is the small system of the
unknowns that views share. Equal points are one point with a weight, so a view of any size spreads over chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelbase.functions.scratch import settle

POINT = ("x", "y", "z", "u", "v")
HELD = (*POINT, "w")
#: Points in a chunk and in a task, about, and the bytes of poses that are broadcast to chunks at most.
CHUNK, TASK, SENT = 4096, 1 << 17, 32 << 20


def _points(points: DataFrame) -> DataFrame:
    """(view, x, y, z, u, v, w: times): distinct points; those with a null or a value that isn't finite are left out."""
    rows = points.select(F.col("view").cast("long").alias("view"), *(F.col(c).cast("double").alias(c) for c in POINT)).where("view IS NOT NULL")
    for c in POINT:
        rows = rows.where(F.abs(F.col(c)) < float("inf"))
    return rows.groupBy("view", *POINT).agg(F.count(F.lit(1)).cast("double").alias("w"))


def _middles(rows: DataFrame) -> DataFrame:
    """(view, n, distinct, mean of each coordinate, spread of places and of images)."""
    w = F.col("w")
    mean = lambda e: F.sum(w * e) / F.sum(w)
    first = rows.groupBy("view").agg(F.sum("w").cast("int").alias("n"), F.count(F.lit(1)).alias("distinct"), *(mean(F.col(c)).alias(f"m{c}") for c in POINT))
    off = lambda names: sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in names), F.lit(0.0))
    second = rows.join(first, "view").groupBy("view").agg(F.sqrt(mean(off("xyz"))).alias("s3"), F.sqrt(mean(off("uv"))).alias("s2"))
    return first.join(second, "view")


def _row(batch: pa.RecordBatch, i: int, names) -> list[np.ndarray]:
    return [batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in names]


PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]


def _camera_matrix(sums: np.ndarray, mean: np.ndarray, s3: float, s2: float) -> np.ndarray:
    """The 3 x 4 matrix (unit norm, points in front) from a view's products of (x, y, z, 1) with 1, u, v and u^2 + v^2."""
    one, u, v, both = (np.zeros((4, 4)) for _ in range(4))
    for m, values in zip((one, u, v, both), sums.reshape(4, -1), strict=True):
        for (i, j), value in zip(PAIRS, values, strict=True):
            m[i, j] = m[j, i] = value
    zero = np.zeros((4, 4))
    values, vectors = np.linalg.eigh(np.block([[one, zero, -u], [zero, one, -v], [-u, -v, both]]))
    if values[1] <= 1e-12 * values[-1]:
        raise ValueError("points of a view lie in a plane or are too few")
    world, image = np.diag([1 / s3] * 3 + [1.0]), np.diag([s2, s2, 1.0])
    world[:3, 3], image[:2, 2] = -mean[:3] / s3, mean[3:]
    p = image @ vectors[:, 0].reshape(3, 4) @ world
    p /= np.linalg.norm(p)
    return -p if p[2, :3] @ mean[:3] + p[2, 3] < 0 else p


def split_camera(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """K (upper, positive diagonal, last 1), R (a rotation) and t with p ~ K [R t]; p of any scale and sign."""
    m = p[:, :3]
    if np.linalg.det(m) < 0:
        p, m = -p, -m
    flip = np.eye(3)[::-1]
    q, r = np.linalg.qr((flip @ m).T)
    k, rot = flip @ r.T @ flip, flip @ q.T
    sign = np.diag(np.sign(np.diag(k)))
    k, rot = k @ sign, sign @ rot
    return k / k[2, 2], rot, np.linalg.solve(k, p[:, 3])


CAMERA = "view long, p array<double>, n int, fu double, fv double, skew double, cu double, cv double, rotation array<double>, translation array<double>"


def _camera(view, p: np.ndarray, n: int) -> dict:
    k, rot, t = split_camera(p)
    return {"view": view, "p": p.ravel(), "n": n, "fu": k[0, 0], "fv": k[1, 1], "skew": k[0, 1], "cu": k[0, 2], "cv": k[1, 2], "rotation": rot.ravel(), "translation": t}


_LIST = pa.list_(pa.float64())
_CAMERA = pa.schema([("view", pa.int64()), ("p", _LIST), ("n", pa.int32()), *((c, pa.float64()) for c in ("fu", "fv", "skew", "cu", "cv")), ("rotation", _LIST), ("translation", _LIST)])


def split_cameras(matrices: DataFrame) -> DataFrame:
    """``CAMERA`` of (view, p: 12 numbers of any scale); n is 0. A matrix whose left part is singular stops the query."""

    def run(batches):
        for batch in batches:
            rows = [_camera(batch.column("view")[i].as_py(), _row(batch, i, ["p"])[0].reshape(3, 4), 0) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_pylist(rows, schema=_CAMERA)

    return matrices.select(F.col("view").cast("long").alias("view"), F.col("p").cast("array<double>").alias("p")).mapInArrow(run, CAMERA)


def cameras(points: DataFrame) -> DataFrame:
    """``CAMERA`` of every view of points (view, x, y, z, u, v) on its own, by the direct linear transform.

    Two grouped passes: means and spreads, then forty sums of products of moved and scaled points, whose least eigenvector is the
    answer. Views with fewer than six distinct points give no row; points that all lie in a plane stop the query.
    """
    return _cameras(_points(points))


def _cameras(rows: DataFrame) -> DataFrame:
    middles = _middles(rows).where("distinct >= 6")
    scale = {c: F.col("s3" if c in "xyz" else "s2") for c in POINT}
    m = {c: (F.col(c) - F.col(f"m{c}")) / F.nullif(scale[c], F.lit(0.0)) for c in POINT}
    c = [m["x"], m["y"], m["z"], F.lit(1.0)]
    factors = [F.lit(1.0), m["u"], m["v"], m["u"] * m["u"] + m["v"] * m["v"]]
    sums = F.array(*(F.sum(F.col("w") * f * c[i] * c[j]) for f in factors for i, j in PAIRS))
    keep = [*(f"m{k}" for k in POINT), "s3", "s2", "n"]
    products = rows.join(middles, "view").groupBy("view").agg(sums.alias("sums"), *(F.first(k).alias(k) for k in keep))

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                *mean, s3, s2, n = (batch.column(k)[i].as_py() for k in keep)
                if not (s3 > 0 and s2 > 0):
                    raise ValueError("points of a view lie in a plane or are too few")
                out.append(_camera(batch.column("view")[i].as_py(), _camera_matrix(_row(batch, i, ["sums"])[0], np.array(mean), s3, s2), n))
            yield pa.RecordBatch.from_pylist(out, schema=_CAMERA)

    return products.mapInArrow(run, CAMERA)


def rotation(w: np.ndarray) -> np.ndarray:
    """The rotation about ``w`` by its length."""
    a = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    return np.eye(3) + k * np.sinc(a / np.pi) + k @ k * 0.5 * np.sinc(a / (2 * np.pi)) ** 2


#: Steps of one unit of each unknown: turn (3), shift (3); focal length and principal point.
POSE_SCALE = np.array([1e-2] * 3 + [1.0] * 3)
SHARED_SCALE = np.array([1.0, 1.0, 1.0])


@dataclass(frozen=True)
class Fit:
    iterations: int = 50
    damping: float = 1e-3
    #: Rest where the cost falls by less, or steps are shorter in scaled unknowns.
    least_gain: float = 1e-12
    least_step: float = 1e-10


def system(shared: np.ndarray, pose: np.ndarray, points: list[np.ndarray]):
    """Normal blocks of points (x, y, z, u, v, times) of a view: pose x pose, pose x shared, shared x shared, both gradients, and half the squared residuals.

    ``shared`` is (f, cu, cv); ``pose`` holds the rotation's nine numbers and the shift. A point at or behind the source costs infinity.
    """
    x, y, z, u, v, weight = points
    r, t = pose[:9].reshape(3, 3), pose[9:]
    turned = np.c_[x, y, z] @ r.T
    c = turned + t
    f, cu, cv = shared
    if (c[:, 2] <= 0).any():
        return np.zeros((6, 6)), np.zeros((6, 3)), np.zeros((3, 3)), np.zeros(6), np.zeros(3), np.inf
    a, b, w = c[:, 0] / c[:, 2], c[:, 1] / c[:, 2], f / c[:, 2]
    e = np.r_[f * a + cu - u, f * b + cv - v]
    o = np.zeros_like(a)
    du, dv = np.c_[w, o, -w * a], np.c_[o, w, -w * b]
    shift = np.r_[du, dv]
    turn = np.r_[np.cross(turned, du), np.cross(turned, dv)]
    j = np.c_[turn, shift] * POSE_SCALE
    k = np.r_[np.c_[a, o + 1, o], np.c_[b, o, o + 1]] * SHARED_SCALE
    w2 = np.r_[weight, weight][:, None]
    return j.T @ (w2 * j), j.T @ (w2 * k), k.T @ (w2 * k), j.T @ (w2[:, 0] * e), k.T @ (w2[:, 0] * e), 0.5 * float(w2[:, 0] @ (e * e))


def _damped(m: np.ndarray, damping: float) -> np.ndarray:
    return m + np.diag(damping * (np.abs(np.diag(m)) + 1))


def reduced(blocks, damping: float) -> np.ndarray:
    """A view's share of the shared unknowns' system once its pose is eliminated: 9 numbers, 3 of the right side, the shared diagonal, the cost."""
    a, b, c, g, h, cost = blocks
    inner = np.linalg.solve(_damped(a, damping), np.c_[b, g])
    return np.r_[(c - b.T @ inner[:, :3]).ravel(), h - b.T @ inner[:, 3], np.diag(c), cost]


def moved(pose: np.ndarray, blocks, step: np.ndarray, damping: float) -> tuple[np.ndarray, float]:
    """The pose after its part of the step, and that part's squared length in scaled unknowns."""
    a, b, _, g, _, _ = blocks
    d = -np.linalg.solve(_damped(a, damping), g + b @ step)
    turn, shift = d[:3] * POSE_SCALE[:3], d[3:] * POSE_SCALE[3:]
    r, _, q = np.linalg.svd(rotation(turn) @ pose[:9].reshape(3, 3))  # keeps rounding from adding up
    return np.r_[(r @ q).ravel(), pose[9:] + shift], float(d @ d)


SIZES = ((6, 6), (6, 3), (3, 3), (6,), (3,), ())
NUMBERS = sum(int(np.prod(shape)) for shape in SIZES)
REFUSED, TAKEN = 8.0, 0.35
STATE = "view long, n int, pose array<double>, blocks array<double>, next array<double>, ahead array<double>, sums array<double>"
STATE_NAMES = ["view", "n", "pose", "blocks", "next", "ahead", "sums"]


def _flat(blocks) -> np.ndarray:
    return np.concatenate([np.ravel(b) for b in blocks])


def _blocks(flat: np.ndarray) -> list:
    ends = np.cumsum([int(np.prod(shape)) for shape in SIZES])[:-1]
    return [part.reshape(shape) for part, shape in zip(np.split(flat, ends), SIZES, strict=True)]


def _tasks(views: DataFrame) -> int:
    """Partitions of chunks: an Arrow batch may be as large as a partition, so their size is fixed and their number grows."""
    return max(views.sparkSession.sparkContext.defaultParallelism, -(-(views.agg(F.sum("distinct")).first()[0] or 0) // TASK))


def _chunks(rows: DataFrame, views: DataFrame, tasks: int) -> DataFrame:
    """(view, x, y, z, u, v, w: arrays): the views' points in chunks of about ``CHUNK``, in ``tasks`` partitions."""
    salt = F.pmod(F.xxhash64(*POINT), F.ceil(F.col("distinct") / CHUNK))
    dealt = rows.join(views.select("view", "distinct"), "view").withColumn("salt", salt).repartition(tasks, "view", "salt")
    packed = dealt.groupBy("view", "salt").agg(F.collect_list(F.struct(*HELD)).alias("q"))
    return packed.select("view", *(F.col("q")[c].alias(c) for c in HELD))


def _ahead(chunks: DataFrame, views: DataFrame, shared: np.ndarray, few: bool, tasks: int) -> DataFrame:
    """(view, ahead): normal blocks of every view at its ``next`` pose, summed over its chunks."""

    def run(batches):
        for batch in batches:
            out = [_flat(system(shared, _row(batch, i, ["next"])[0], _row(batch, i, HELD))) for i in range(batch.num_rows)]
            if out:
                flat = pa.array(np.concatenate(out))
                yield pa.RecordBatch.from_arrays([batch.column("view"), pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, NUMBERS, dtype=np.int32), flat)], names=["view", "part"])

    poses = views.select("view", "next")
    met = chunks.join(F.broadcast(poses), "view") if few else chunks.repartition(tasks, "view").join(poses.repartition(tasks, "view"), "view")
    parts = met.mapInArrow(run, "view long, part array<double>")
    return parts.groupBy("view").agg(F.array(*(F.sum(F.col("part")[k]) for k in range(NUMBERS))).alias("ahead"))


def joint_poses(points: DataFrame, fit: Fit = Fit()) -> tuple[DataFrame, dict]:
    """(view, n, rotation, translation, cost) of all views under one focal length and principal point, and the fit's figures.

    Levenberg-Marquardt from each view's own camera and the views' medians. One pass over the points an iteration: it weighs the
    step and gives the blocks there, from which the shared system is made anew whether the step is taken or refused. Poses go
    to the chunks by broadcast while they are below ``SENT`` bytes, else by a join. Views with fewer than six distinct points are left
    out; without any view the result is empty.
    """
    rows = settle(_points(points))
    own = settle(_cameras(rows).select("view", "n", "fu", "fv", "cu", "cv", F.concat("rotation", "translation").alias("pose")))
    count, *middle = own.agg(F.count(F.lit(1)), *(F.percentile(c, F.lit(0.5)) for c in (F.col("fu") / 2 + F.col("fv") / 2, F.col("cu"), F.col("cv")))).first()
    nothing = F.array().cast("array<double>")
    if not count:
        empty = own.select("view", "n", F.slice("pose", 1, 9).alias("rotation"), F.slice("pose", 10, 3).alias("translation"), F.col("fu").alias("cost"))
        return empty, {"iterations": 0, "shared": None, "cost": 0.0, "converged": True}
    few = count * 200 <= SENT
    sizes = rows.groupBy("view").agg(F.count(F.lit(1)).alias("distinct")).join(own.select("view"), "view", "left_semi")
    tasks = _tasks(sizes)
    chunks = settle(_chunks(rows, sizes, tasks))

    def weigh(views: DataFrame, shared: np.ndarray, damping: float) -> tuple[DataFrame, np.ndarray]:
        """Views with their blocks ahead, and the sums: shared system if the step is taken, if it is refused, squared step."""

        def run(batches):
            for batch in batches:
                out = []
                for i in range(batch.num_rows):
                    blocks, ahead, step = _row(batch, i, ["blocks", "ahead", "sums"])
                    there = _blocks(ahead)
                    good = reduced(there, max(1e-12, damping * TAKEN)) if np.isfinite(there[5]) else np.full(16, np.inf)
                    old = reduced(_blocks(blocks), min(1e12, damping * REFUSED)) if len(blocks) else np.zeros(16)
                    out.append(np.r_[good, old, step])
                if out:
                    flat = pa.array(np.concatenate(out))
                    sums = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, 33, dtype=np.int32), flat)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in STATE_NAMES[:-1]), sums], names=STATE_NAMES)

        full = views.join(_ahead(chunks, views, shared, few, tasks), "view").select(*STATE_NAMES)
        full = settle(full.mapInArrow(run, STATE))
        return full, np.array(full.agg(*(F.sum(F.col("sums")[k]) for k in range(33))).first(), float)

    shared, damping = np.array(middle, float), fit.damping
    start = own.select("view", "n", "pose", nothing.alias("blocks"), F.col("pose").alias("next"), F.array(F.lit(0.0)).alias("sums"))
    views, sums = weigh(start, shared, damping / TAKEN)
    total, cost, taken, iterations, converged = sums[:16], float(sums[15]), True, 0, False
    for _ in range(fit.iterations):
        step = -np.linalg.solve(total[:9].reshape(3, 3) + np.diag(damping * (np.abs(total[12:15]) + 1)), total[9:12])
        trial = shared + step * SHARED_SCALE

        def go(batches, step=step, damping=damping, taken=taken):
            for batch in batches:
                out = [[], [], [], []]
                for i in range(batch.num_rows):
                    pose, blocks = _row(batch, i, ["next", "ahead"] if taken else ["pose", "blocks"])
                    there, length = moved(pose, _blocks(blocks), step, damping)
                    for column, value in zip(out, (pose, blocks, there, [length]), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column("view"), batch.column("n"), *(pa.array(c, _LIST) for c in out)], names=["view", "n", "pose", "blocks", "next", "sums"])

        moving = settle(views.mapInArrow(go, "view long, n int, pose array<double>, blocks array<double>, next array<double>, sums array<double>"))
        views, sums = weigh(moving, trial, damping)
        taken = bool(sums[15] < cost)
        if not taken:
            damping, total = min(1e12, damping * REFUSED), sums[16:32]
            if damping >= 1e12:
                break
            continue
        iterations += 1
        gain, length = cost - float(sums[15]), float(np.sqrt(sums[32] + step @ step))
        shared, cost, total, damping = trial, float(sums[15]), sums[:16], max(1e-12, damping * TAKEN)
        converged = gain < fit.least_gain or length < fit.least_step * (1 + float(np.linalg.norm(shared / SHARED_SCALE)))
        if converged:
            break
    pose, blocks = (F.col(c) for c in (("next", "ahead") if taken else ("pose", "blocks")))
    result = views.select("view", "n", F.slice(pose, 1, 9).alias("rotation"), F.slice(pose, 10, 3).alias("translation"), blocks[NUMBERS - 1].alias("cost"))
    return result, {"iterations": iterations, "shared": shared.tolist(), "cost": cost, "converged": converged}


MONOMIALS = [(i, j) for i in range(5) for j in range(5 - i)]
ELLIPSE = "n long, cy double, cx double, major double, minor double, angle double"


def ellipses(points: DataFrame, key: str) -> DataFrame:
    """(key, n, centre, half axes, angle of the major axis in [0, pi)) of points (key, x, y), by the direct fit that can only give ellipses.

    Two grouped passes: means and spreads, then sums of products up to the fourth order of moved and scaled points; the
    constrained eigenproblem of three unknowns is solved for each group's sums. Groups of fewer than six points, or on a line,
    give nulls; a circle's angle is 0.
    """
    seen = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    means = seen.groupBy(key).agg(F.avg("x").alias("__mx"), F.avg("y").alias("__my"), F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("__s"))
    scaled = seen.select(key, F.col("x").alias("__x"), F.col("y").alias("__y")).join(means, key)
    x, y = ((F.col(f"__{c}") - F.col(f"__m{c}")) / F.nullif(F.col("__s"), F.lit(0.0)) for c in "xy")
    sums = [(F.sum(F.pow(x, F.lit(float(i))) * F.pow(y, F.lit(float(j)))) if i + j else F.count(F.lit(1)).cast("double")).alias(f"__{i}{j}") for i, j in MONOMIALS]
    moments = scaled.groupBy(key).agg(F.first("__mx").alias("__mx"), F.first("__my").alias("__my"), F.first("__s").alias("__s"), *sums)

    def solve(batches):
        for batch in batches:
            out = [_ellipse(*(batch.column(c)[i].as_py() for c in ("__mx", "__my", "__s")), {m: batch.column(f"__{m[0]}{m[1]}")[i].as_py() for m in MONOMIALS}) for i in range(batch.num_rows)]
            columns = [pa.array([r[k] for r in out], pa.int64() if k == 0 else pa.float64()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names=[key, "n", "cy", "cx", "major", "minor", "angle"])

    kind = points.schema[key].dataType.simpleString()
    return moments.mapInArrow(solve, f"`{key}` {kind}, {ELLIPSE}")


def _ellipse(mx: float, my: float, s: float, m: dict) -> tuple:
    n = int(m[0, 0])
    none = (n, None, None, None, None, None)
    if n < 6 or not s:
        return none
    square, line = [(2, 0), (1, 1), (0, 2)], [(1, 0), (0, 1), (0, 0)]
    block = lambda a, b: np.array([[m[p[0] + q[0], p[1] + q[1]] for q in b] for p in a])
    s1, s2, s3 = block(square, square), block(square, line), block(line, line)
    if np.linalg.cond(s3) > 1e12:
        return none
    back = -np.linalg.solve(s3, s2.T)
    reducedm = s1 + s2 @ back
    values, vectors = np.linalg.eig(np.array([reducedm[2] / 2, -reducedm[1], reducedm[0] / 2]))
    vectors = vectors.real
    fits = 4 * vectors[0] * vectors[2] - vectors[1] ** 2
    if not (fits > 0).any():
        return none
    quad = vectors[:, np.flatnonzero(fits > 0)[np.argmin(np.abs(values.real[fits > 0]))]]
    a, b, c = quad
    d, e, f = back @ quad
    det = 4 * a * c - b * b
    x0, y0 = (b * e - 2 * c * d) / det, (b * d - 2 * a * e) / det
    level = -(f + (d * x0 + e * y0) / 2)
    spread, axes = np.linalg.eigh(np.array([[a, b / 2], [b / 2, c]]) / level)
    if not (spread > 0).all():
        return none
    major, minor = 1 / np.sqrt(spread)
    angle = 0.0 if major - minor < 1e-9 * major else float(np.arctan2(axes[1, 0], axes[0, 0]) % np.pi)
    return n, my + s * y0, mx + s * x0, s * major, s * minor, angle

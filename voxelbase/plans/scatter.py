"""Scatter by mixtures of kernels, and the solvers that take it off.

A frame is one row of pixels, so frames are independent and a plan is a map over rows; a task
holds one frame at a time. Every pixel is a source whose strength and kernel follow from its
transmission: the source is shared between the two nearest attenuation nodes, each node's sources
are convolved with that node's radial kernel, and the nodes are added before the way back from the
spectra. Convolutions go by blocks of the frame with the kernel's reach around them, so memory is
bounded by block and reach however many nodes there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxelbase.operators.lookup import pchip_slopes

#: Pixels of a block's side, kernels' reach apart.
BLOCK = 512
#: Kernel spectra that a task keeps, in bytes; beyond them they are made anew for each block.
KEPT = 256 << 20
#: Least primary, as a share of air.
FLOOR = 1e-8
TINY = float(np.finfo(np.float64).tiny)
FLOAT_TINY = float(np.finfo(np.float32).tiny)


@dataclass(frozen=True)
class Kernels:
    """A calibrated scatter model on a detector of (ny, nx) pixels of (dv, du) mm.

    ``nodes`` are attenuations (rising), ``density[k]`` the kernel of node k per mm^2 at ``radii``. ``amplitude``
    and ``water`` (equivalent thickness) are curves over attenuation. ``segments`` above 0 takes the mid-points
    of so many equal pieces as nodes instead.
    """

    ny: int
    nx: int
    dv: float
    du: float
    nodes: tuple[float, ...]
    radii: tuple[float, ...]
    density: tuple[tuple[float, ...], ...]
    amplitude: tuple[tuple[float, float], ...]
    water: tuple[tuple[float, float], ...]
    support_v: float
    support_u: float
    t_max: float = 1.0
    gamma: float = 0.0
    sigma: float = 0.0
    edge_scale: float = 1.0
    edge_ramp: float = 1.0
    segments: int = 0

    def __post_init__(self):
        for name, xs in (("nodes", self.nodes), ("radii", self.radii), ("amplitude", [a for a, _ in self.amplitude]), ("water", [a for a, _ in self.water])):
            if len(xs) < 2 or any(b <= a for a, b in zip(xs, xs[1:], strict=False)):
                raise ValueError(f"{name} must increase and have two values at least")
        if len(self.density) != len(self.nodes) or any(len(row) != len(self.radii) for row in self.density):
            raise ValueError("density must have a row a node and a value a radius")
        if min(self.ny, self.nx) < 1 or min(self.dv, self.du, self.support_v, self.support_u, self.edge_ramp) <= 0:
            raise ValueError("sizes, pitches, supports and the ramp must be positive")

    def basis(self) -> np.ndarray:
        """Attenuations between which sources are shared."""
        if self.segments <= 0:
            return np.array(self.nodes)
        n = max(2, self.segments)
        return self.nodes[0] + (np.arange(n) + 0.5) * (self.nodes[-1] - self.nodes[0]) / n

    def reach(self) -> tuple[int, int]:
        """Pixels that a kernel reaches along v and u; never far beyond the frame."""
        one = lambda n, d, s: max(1, math.ceil(min(s, max((n - 1) * d, d)) / d))
        return one(self.ny, self.dv, self.support_v), one(self.nx, self.du, self.support_u)

    def kernel(self, attenuation: float) -> np.ndarray:
        """The kernel over its whole reach, in shares of a pixel. Mass beyond the reach is lost, not spread over the rest."""
        rv, ru = self.reach()
        v, u = np.arange(-rv, rv + 1)[:, None] * self.dv, np.arange(-ru, ru + 1) * self.du
        density = np.array(self.density)
        rows = np.array([np.interp(attenuation, self.nodes, column) for column in density.T])
        k = np.interp(np.hypot(v, u), self.radii, rows, right=0.0) * self.dv * self.du
        if not (np.isfinite(k).all() and k.sum() > 0):
            raise ValueError("a kernel must have a finite mass above 0")
        return k


def _smooth(n: int) -> int:
    """The least product of 2, 3 and 5 that is at least n."""
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


def gaussian(pitch: float, sigma: float) -> np.ndarray:
    """Weights of whole pixels out to four sigma, with sum 1."""
    r = max(1, math.ceil(4 * sigma / pitch))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) * pitch / sigma) ** 2)
    return w / w.sum()


def _along(x: np.ndarray, w: np.ndarray, axis: int) -> np.ndarray:
    r, n = len(w) // 2, x.shape[axis]
    wide = np.pad(x, [(r, r) if a == axis else (0, 0) for a in range(2)], mode="edge")
    return sum(f * np.take(wide, np.arange(k, k + n), axis) for k, f in enumerate(w))


def edge_window(mask: np.ndarray, model: Kernels) -> np.ndarray:
    """Sources near the object's edge count less: 0 outside, ``edge_scale`` at the edge, 1 from a squared distance of ``edge_ramp`` mm^2 on.

    Distances beyond the ramp don't matter, so rows out to it are enough: a pass along u, then one along v.
    """
    far = np.inf
    u = np.arange(mask.shape[1], dtype=float)
    left = np.maximum.accumulate(np.where(mask, -far, u), axis=1)
    right = np.minimum.accumulate(np.where(mask, far, u)[:, ::-1], axis=1)[:, ::-1]
    row = (np.minimum(u - left, right - u) * model.du) ** 2
    best = row.copy()
    for k in range(1, min(math.ceil(math.sqrt(model.edge_ramp) / model.dv), mask.shape[0] - 1) + 1):
        step = (k * model.dv) ** 2
        np.minimum(best[k:], row[:-k] + step, out=best[k:])
        np.minimum(best[:-k], row[k:] + step, out=best[:-k])
    return np.where(mask, model.edge_scale + (1 - model.edge_scale) * np.minimum(best / model.edge_ramp, 1.0), 0.0)


def predictor(model: Kernels) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """primary, air, edge window (ny, nx each) -> scatter."""
    basis, (rv, ru) = model.basis(), model.reach()
    bv, bu = min(BLOCK, model.ny), min(BLOCK, model.nx)
    size = _smooth(bv + 2 * rv), _smooth(bu + 2 * ru)

    def spectrum(k: int) -> np.ndarray:
        return np.fft.rfft2(model.kernel(float(basis[k])), size)

    if len(basis) * size[0] * (size[1] // 2 + 1) * 16 <= KEPT:
        spectrum = cache(spectrum)
    amplitude, water = np.array(model.amplitude), np.array(model.water)
    slopes = np.array(pchip_slopes(list(model.water)))

    def convolve(source: np.ndarray, lower: np.ndarray, part: np.ndarray) -> np.ndarray:
        wide = np.zeros((model.ny + 2 * rv, model.nx + 2 * ru))
        for y in range(0, model.ny, bv):
            for x in range(0, model.nx, bu):
                at = slice(y, y + bv), slice(x, x + bu)
                s, low, up = source[at], lower[at], part[at]
                if not s.any():
                    continue
                total = 0.0
                for k in range(len(basis)):
                    own = s * (np.where(low == k, 1 - up, 0.0) + np.where(low + 1 == k, up, 0.0))
                    if own.any():
                        total = total + np.fft.rfft2(own, size) * spectrum(k)
                h, w = s.shape[0] + 2 * rv, s.shape[1] + 2 * ru
                wide[y : y + h, x : x + w] += np.fft.irfft2(total, size)[:h, :w]
        return wide[rv : rv + model.ny, ru : ru + model.nx]

    def thickness(t: np.ndarray) -> np.ndarray:
        x = np.clip(-np.log(np.clip(t, FLOAT_TINY, 1.0)), water[0, 0], water[-1, 0])
        i = np.clip(np.searchsorted(water[:, 0], x, "right") - 1, 0, len(water) - 2)
        h = water[i + 1, 0] - water[i, 0]
        f = (x - water[i, 0]) / h
        g = 1 - f
        w = (1 + 2 * f) * g * g * water[i, 1] + f * f * (3 - 2 * f) * water[i + 1, 1] + h * f * g * (g * slopes[i] - f * slopes[i + 1])
        return _along(_along(w, gaussian(model.du, model.sigma), 1), gaussian(model.dv, model.sigma), 0) if model.sigma > 0 else w

    def predict(primary: np.ndarray, air: np.ndarray, edge: np.ndarray) -> np.ndarray:
        if not (np.isfinite(primary).all() and np.isfinite(air).all() and (primary >= 0).all()):
            raise ValueError("scatter needs a finite primary of at least 0 and finite air")
        t = np.divide(primary, air, out=np.ones_like(primary), where=air > 0)
        seen = np.clip(t, TINY, 1.0)
        x = -np.log(seen)
        strength = np.interp(x, amplitude[:, 0], amplitude[:, 1])
        thin = x < amplitude[0, 0]
        strength[thin] = model.t_max * amplitude[0, 1] * x[thin] / amplitude[0, 0] / seen[thin]
        if not (np.isfinite(strength).all() and (strength >= 0).all()):
            raise ValueError("amplitudes must be finite and at least 0")
        source = np.where(seen < 1, primary * strength * edge, 0.0)
        place = np.clip(x, basis[0], basis[-1])
        lower = np.clip(np.searchsorted(basis, place, "right") - 1, 0, len(basis) - 2)
        part = (place - basis[lower]) / (basis[lower + 1] - basis[lower])
        plain = convolve(source, lower, part)
        if not model.gamma:
            return plain
        w = thickness(t)
        out = (1 - model.gamma * w) * plain + model.gamma * convolve(source * w, lower, part)
        return np.where((out < 0) & (out > -1e-6 * max(1.0, np.abs(out).max(initial=0.0))), 0.0, out)

    return predict


def _frames(batch: pa.RecordBatch, model: Kernels) -> Iterator[tuple]:
    """(view, data, air) row by row; a frame of another size, or with a null or a value that isn't finite, stops the query."""
    for i in range(batch.num_rows):
        both = []
        for name in ("data", "air"):
            values = batch.column(name)[i].values
            flat = np.array([]) if values is None else values.to_numpy(zero_copy_only=False).astype(float)
            if len(flat) != model.ny * model.nx or not np.isfinite(flat).all():
                raise ValueError(f"{name} must hold {model.ny * model.nx} finite values")
            both.append(flat.reshape(model.ny, model.nx))
        yield batch.column("view")[i], *both


def _mask(data: np.ndarray, air: np.ndarray, below: float) -> np.ndarray:
    return data < below * air


def scatter(frames: DataFrame, model: Kernels, below: float) -> DataFrame:
    """(view, scatter): the scatter that frames (view, data: primary, air) make. Sources lie where the transmission is under ``below``."""

    def run(batches):
        predict = predictor(model)
        for batch in batches:
            for view, data, air in _frames(batch, model):
                out = predict(data, air, edge_window(_mask(data, air, below), model))
                yield pa.RecordBatch.from_arrays([pa.array([view.as_py()], pa.int64()), pa.array([out.ravel()])], names=["view", "scatter"])

    return _map(frames, run, "view long, scatter array<double>")


def _map(frames: DataFrame, run: Callable, schema: str) -> DataFrame:
    return frames.selectExpr("cast(view as long) AS view", "cast(data as array<double>) AS data", "cast(air as array<double>) AS air").mapInArrow(run, schema)


def fixed_scatter(frames: DataFrame, model: Kernels, below: float, rounds: int, damping: float, scale: float = 1.0) -> DataFrame:
    """(view, primary): so many damped steps towards measured - scale * scatter(primary), which stays above 1e-8 of air."""

    def run(batches):
        predict = predictor(model)
        for batch in batches:
            for view, data, air in _frames(batch, model):
                edge, primary = edge_window(_mask(data, air, below), model), data
                for _ in range(rounds):
                    aim = np.maximum(air * FLOOR, data - scale * np.maximum(predict(primary, air, edge), 0.0))
                    primary = (1 - damping) * primary + damping * aim
                yield pa.RecordBatch.from_arrays([pa.array([view.as_py()], pa.int64()), pa.array([primary.ravel()])], names=["view", "primary"])

    return _map(frames, run, "view long, primary array<double>")


@dataclass(frozen=True)
class Damping:
    """How the adaptive solver steps: the ceiling decays by ``decay`` a step, steps grow by a quarter and halve when refused."""

    iterations: int = 8
    first: float = 0.8
    least: float = 0.1
    decay: float = 1.0
    #: Share of the way to the floor that a pixel may go in one step.
    margin: float = 0.9
    #: Transmission below which a frame's low quantile is reported as a risk.
    quantile: float = 0.01
    risk: float = 0.05

    def __post_init__(self):
        if not (self.iterations > 0 and 0 < self.least <= self.first <= 1 and 0 < self.decay <= 1 and 0 < self.margin < 1 and 0 < self.quantile <= 1 and 0 < self.risk < 1):
            raise ValueError("damping out of range")


REPORT = "view long, primary array<double>, iterations int, predictions int, rejected int, limited int, damping double, residual double, change double, low double, risk boolean, status string"


def adaptive_scatter(frames: DataFrame, model: Kernels, below: float, how: Damping = Damping(), scale: float = 1.0) -> DataFrame:
    """Frames (view, data: measured, air) with scatter taken off, and how each was solved (``REPORT``).

    A step goes along measured - primary - scale * scatter(primary) and is taken if the residual's norm doesn't
    rise; no pixel may go past a share of its way to the floor. ``status``: completed, stalled (least step refused) or
    positivity_stalled (a pixel on the floor would have to go lower). ``low`` is a quantile of transmission inside the object,
    1 without object. Measured values under the floor, and air of 0 or less, stop the query.
    """

    def run(batches):
        predict = predictor(model)
        for batch in batches:
            for view, data, air in _frames(batch, model):
                if (air <= 0).any() or (data < air * FLOOR).any():
                    raise ValueError("adaptive scatter needs air above 0 and measured values above the floor")
                mask = _mask(data, air, below)
                primary, figures = _solve(data, air, predict, edge_window(mask, model), how, scale)
                inside = np.sort((data / air)[mask])
                low = float(inside[int(how.quantile * (len(inside) - 1))]) if len(inside) else 1.0
                row = {"view": view.as_py(), "primary": primary.ravel(), **figures, "low": low, "risk": bool(len(inside)) and low < how.risk}
                yield pa.RecordBatch.from_pylist([row], schema=ARROW)

    return _map(frames, run, REPORT)


ARROW = pa.schema(
    [("view", pa.int64()), ("primary", pa.list_(pa.float64()))]
    + [(n, pa.int32()) for n in ("iterations", "predictions", "rejected", "limited")]
    + [(n, pa.float64()) for n in ("damping", "residual", "change", "low")]
    + [("risk", pa.bool_()), ("status", pa.string())]
)


def _solve(data: np.ndarray, air: np.ndarray, predict: Callable, edge: np.ndarray, how: Damping, scale: float) -> tuple[np.ndarray, dict]:
    floor, norm = air * FLOOR, lambda x: math.sqrt(float((x * x).sum()))

    def measure(primary: np.ndarray):
        """The way to go, its norm against the signal's, and the step at which the first pixel would come too near the floor."""
        way = data - primary - scale * np.maximum(predict(primary, air, edge), 0.0)
        down = way < 0
        bound = np.min(how.margin * np.maximum(primary[down] - floor[down], 0.0) / -way[down], initial=1.0)
        return way, norm(way) / max(norm(data), 1e-150), float(bound)

    primary = data
    way, residual, bound = measure(primary)
    change, damping = 0.0, how.first
    counts = {"iterations": 0, "predictions": 1, "rejected": 0, "limited": 0}
    status = "completed"
    while counts["iterations"] < how.iterations and status == "completed":
        ceiling = how.first * how.decay ** counts["iterations"]
        wished = min(ceiling, damping * 1.25) if counts["iterations"] else ceiling
        damping = min(wished, bound)
        counts["limited"] += damping < wished
        if damping <= 0:
            status = "positivity_stalled"
            break
        least = min(how.least, damping)
        while True:
            trial = primary + damping * way
            found = measure(trial)
            counts["predictions"] += 1
            if found[1] <= residual:
                change = norm(trial - primary) / max(norm(primary), 1e-150)
                primary, (way, residual, bound) = trial, found
                counts["iterations"] += 1
                break
            counts["rejected"] += 1
            if damping <= least:
                status = "stalled"
                break
            damping = max(least, damping / 2)
    return primary, counts | {"damping": damping, "residual": residual, "change": change, "status": status}

"""Projections onto convex sets with total variation: data steps, then steps down the image's variation.

ASD-POCS takes the first descent's length from the first data step and shortens it whenever
descent moves the volume by more than the data do while readings are still off; PCSD takes it
from the residual. Edges may be spared by weights that fall off with the difference.
Subsets make the ordered forms, one view each the SART forms. The driver sees norms only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelbase.functions.scratch import settle
from voxelbase.operators.geometry import Scan
from voxelbase.operators.projector import Grid

from . import fdk
from .solve import algebraic, axpy, bounded, inner, norm2, residual, zeros


@dataclass(frozen=True)
class Pocs:
    kind: str = "asd"  # or "pcsd"
    iterations: int = 20
    relax: float = 1.0
    relax_decay: float = 0.99
    least_relax: float = 0.005
    descents: int = 20  # steps down the variation after each data step
    length: float = 0.002  # of a descent, as a share of the first data step
    length_decay: float = 0.95
    most_ratio: float = 0.95  # of descent to data step, above which descents get shorter
    most_error: float = 0.0  # of the residual's norm (PCSD: of its square) that is good enough
    eps: float = 1e-8
    edge: float = 0.0  # differences of this size count exp(-1); 0: all count whole
    bregman: float = 0.0  # share of the residual added back to the readings
    bregman_every: int = 5


@dataclass
class Report:
    iterations: int = 0
    stopped: str = "iterations"
    steps: list[dict[str, float]] = field(default_factory=list)


def variation_gradient(x: DataFrame, grid: Grid, eps: float = 1e-8, edge: float = 0.0) -> DataFrame:
    """(voxel_id, value): of the sum of norms (plus ``eps``) of differences to the voxels before, 0 at the grid's start."""
    i = F.col("voxel_id")
    axes = {"dx": (i % grid.nx, grid.nx, 1), "dy": (F.floor(i / grid.nx) % grid.ny, grid.ny, grid.nx), "dz": (F.floor(i / (grid.nx * grid.ny)), grid.nz, grid.nx * grid.ny)}
    sent = [F.when(place < n - 1, F.struct((i + k).alias("to"), F.lit(name).alias("axis"))) for name, (place, n, k) in axes.items()]
    before = x.select(F.explode(F.filter(F.array(*sent), lambda t: t.isNotNull())).alias("s"), F.col("value").alias("own"))
    before = before.groupBy(F.col("s.to").alias("voxel_id")).agg(*(F.max(F.when(F.col("s.axis") == n, F.col("own"))).alias(n) for n in axes))
    rows = x.join(before, "voxel_id", "left").select("voxel_id", *(F.coalesce(F.col("value") - F.col(n), F.lit(0.0)).alias(n) for n in axes))
    weight = (lambda c: F.exp(-(F.col(c) / edge) ** 2)) if edge else (lambda c: F.lit(1.0))
    rows = rows.select("voxel_id", *(F.col(n) for n in axes), *(weight(n).alias(f"w{n}") for n in axes))
    size = F.sqrt(sum((F.col(f"w{n}") * F.col(n) * F.col(n) for n in axes), F.lit(0.0))) + F.lit(eps)
    each = [F.col(f"w{n}") * F.col(n) / size for n in axes]
    flux = [F.struct((i - k).alias("to"), (-f).alias("f")) for f, (_, _, k) in zip(each, axes.values(), strict=True)] + [F.struct(i.alias("to"), (each[0] + each[1] + each[2]).alias("f"))]
    sums = rows.select(F.explode(F.array(*flux)).alias("s")).groupBy(F.col("s.to").alias("voxel_id")).agg(F.sum("s.f").alias("value"))
    return sums.join(x.select("voxel_id"), "voxel_id", "left_semi")


def descended(x: DataFrame, grid: Grid, length: float, rounds: int, eps: float = 1e-8, edge: float = 0.0) -> DataFrame:
    """``rounds`` steps of ``length`` each straight down the variation; a flat volume stays."""
    for _ in range(rounds):
        g = settle(variation_gradient(x, grid, eps, edge))
        size = norm2(g) ** 0.5
        if size <= eps:
            break
        x = settle(axpy(x, -length / size, g, "voxel_id"))
    return x


def reconstruct(matrix: DataFrame, b: DataFrame, grid: Grid, p: Pocs, subsets: Callable[[Column], Column] | None = None, n_subsets: int = 1, low: float | None = 0.0, x0: DataFrame | None = None) -> tuple[DataFrame, Report]:
    """The volume (voxel_id, value), and what each outer step did; stops on a small relaxation, or once descent only undoes what data steps do and readings are met."""
    if p.kind not in ("asd", "pcsd"):
        raise ValueError("kind is asd or pcsd")
    x, report, relax, length, first = settle(x0 if x0 is not None else zeros(matrix)), Report(), p.relax, 0.0, 1.0
    for k in range(p.iterations):
        start = x
        off = norm2(residual(matrix, b, x)) ** 0.5 if p.kind == "pcsd" else 0.0
        if p.kind == "asd" or off * off > p.most_error:
            x = algebraic(matrix, b, 1, relax, subsets=subsets, n_subsets=n_subsets, low=low, x0=x)
        error = norm2(residual(matrix, b, x)) ** 0.5
        moved = settle(axpy(x, -1.0, start, "voxel_id"))
        data = norm2(moved) ** 0.5
        if p.kind == "pcsd":
            step = 1.0 if k == 0 else off / max(first, 1e-6)
            first = error if k == 0 else first
        else:
            length = p.length * data if k == 0 else length
            step = length
        before = x
        x = settle(bounded(descended(x, grid, step, p.descents, p.eps, p.edge), low, None))
        turned = settle(axpy(x, -1.0, before, "voxel_id"))
        descent = norm2(turned) ** 0.5
        cosine = inner(turned, moved, "voxel_id") / max(descent * data, 1e-30)
        if p.kind == "asd" and descent > p.most_ratio * data and error > p.most_error:
            length *= p.length_decay
        relax *= p.relax_decay
        report.iterations = k + 1
        report.steps.append({"error": error, "data": data, "descent": descent, "cosine": cosine, "step": step})
        if p.bregman and (k + 1) % p.bregman_every == 0:
            b = settle(axpy(b, p.bregman, residual(matrix, b, x), "ray_id"))
        if cosine < -0.99 and error <= p.most_error:
            report.stopped = "readings"
            break
        if relax < p.least_relax:
            report.stopped = "relaxation"
            break
    return x, report


def fdk_start(pixels: DataFrame, geometry: DataFrame, scan: Scan, grid: Grid, low: float | None = 0.0) -> DataFrame:
    """The analytic volume of (view, v, u, value), bounded from below, to start from."""
    return settle(bounded(fdk.reconstruct(pixels, geometry, scan, grid), low, None))


def good_enough(matrix: DataFrame, b: DataFrame, x: DataFrame) -> float:
    """A fifth of the residual's norm of the analytic volume: the error to ask for where none is known."""
    return 0.2 * norm2(residual(matrix, b, x)) ** 0.5

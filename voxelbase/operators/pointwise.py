"""Row-wise transforms of projections: intensity maps, beam hardening, weights, predicates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelbase.functions.scalar import clamp, horner

TINY = 1.1754943508222875e-38


def energy_restore(p: Column, air: Column) -> Column:
    """Energy of a log projection; null where air is not positive or the value not finite."""
    e = air * F.exp(-p)
    return F.when((air > 0) & ~F.isnan(e) & (F.abs(e) != float("inf")), e)


def log_convert(energy: Column, air: Column) -> Column:
    return -F.log(F.greatest(energy / air, F.lit(TINY)))


def transmission_to_log(t: Column) -> Column:
    return -F.log(F.greatest(t, F.lit(1e-8)))


def display_log(signal: Column, reference: Column) -> Column:
    """The log of a signal for display, bounded at 1e-30 of its reference."""
    return -F.log(F.greatest(signal / F.greatest(reference, F.lit(1e-30)), F.lit(1e-30)))


def object_mask(energy: Column, air: Column, threshold: float) -> Column:
    return -F.log(F.greatest(energy / air, F.lit(1e-30))) > threshold


def guided_residual(original: Column, predicted: Column, air: Column, scale: float) -> Column:
    return F.greatest(air * 1e-8, original - scale * F.greatest(F.lit(0.0), predicted))


def polynomial_bhc(p: Column, coefficients: list[float], low: float, high: float) -> Column:
    return horner(clamp(p, low, high), coefficients)


def empirical_bhc(p: Column, path: Column, a: float, b: float, scale: float) -> Column:
    q = path / F.lit(scale)
    return F.when(q < 0, F.lit(float("nan"))).otherwise(p + a * q * q + b * p * q)


def ideal_bone_correction(p: Column, lengths: list[Column], mu_mono: list[float], spectrum: list[tuple[float, list[float]]], water: list[float]) -> Column:
    """p + mono - W(poly), where poly is the spectral log of the same paths."""
    mono = sum((l * m for l, m in zip(lengths, mu_mono, strict=True)), F.lit(0.0))
    poly = -F.log(sum((w * F.exp(-sum((l * m for l, m in zip(lengths, mu, strict=True)), F.lit(0.0))) for w, mu in spectrum), F.lit(0.0)))
    return p + mono - horner(poly, water)


def cosine_weight(u: Column, v: Column, nu: int, nv: int, du: float, dv: float, sod: float, sdd: float) -> Column:
    x, y = (u - F.lit((nu - 1) / 2)) * du, (v - F.lit((nv - 1) / 2)) * dv
    return F.lit(sdd) / F.sqrt(x * x + y * y + sdd * sdd) * F.lit(sdd / (2 * sod))


def parker_weight(beta: Column, gamma: Column, fan: float, scan: float) -> Column:
    """Short-scan redundancy weight; beta counts from the start, gamma is the ray's signed fan angle."""
    q = F.lit(math.pi / 4)
    rise = F.pow(F.sin(q * beta / (fan + gamma)), 2.0)
    fall = F.pow(F.sin(q * (math.pi + 2 * fan - beta) / (fan - gamma)), 2.0)
    w = F.when(beta <= 0, 0.0).when(beta < 2 * (fan + gamma), rise).when(beta <= math.pi + 2 * gamma, 1.0).when(beta < math.pi + 2 * fan, fall).otherwise(0.0)
    return w * F.lit(scan / math.pi)


def helical_redundancy(q: Column, flat: float) -> Column:
    """1 within ``flat`` of the detector's middle, then a cosine edge to 0 at 1."""
    a = F.abs(q)
    return F.when(a < flat, 1.0).when(a < 1, F.pow(F.cos(F.lit(math.pi / 2) * (a - flat) / (1 - flat)), 2.0)).otherwise(0.0)


def das(signal: Column, noise: Column, gain: float, offset: float, saturation: float, lsb: float) -> Column:
    e = signal * gain + offset + noise
    e = F.least(e, F.lit(saturation)) if saturation > 0 else e
    e = F.rint(e / lsb) * lsb if lsb > 0 else e
    return e / gain


def classify(x: Column, thresholds: list[float]) -> Column:
    """The number of thresholds at or below x (equality: upper class); null for NaN."""
    out = F.lit(0)
    for t in thresholds:
        out = out + F.when(x >= t, 1).otherwise(0)
    return F.when(~F.isnan(x), out)


def detector_efficiency(entrance: Column, sensor: Column, cosine: Column) -> Column:
    return F.exp(-entrance / cosine) * (1 - F.exp(-sensor / cosine))


def scatter_amplitude(t: Column, x: Column, x0: float, a0: float, t_max: float, inner: Column) -> Column:
    """Below x0 the thin-object rule, above it the table's value."""
    return F.when(x < x0, F.lit(t_max * a0) * x / x0 / t).otherwise(inner)


def vector_algebra(x: Column, y: Column, k: float) -> dict[str, Column]:
    """The element-wise steps that solvers use."""
    eps = 1e-8
    return {
        "residual": y - x,
        "update": x + k * y / (F.abs(x) + eps),
        "bounded": clamp(x, 0.0, 1.0),
        "inverse": F.when(F.abs(x) > eps, 1 / x).otherwise(0.0),
        "product": x * y,
        "addmul": x + k * x * y,
        "axpy": k * x + y,
    }

"""Scalar column functions: filter windows, special functions, intensity maps, counter-based noise."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def horner(x: Column, coefficients: list[float]) -> Column:
    """A polynomial with ascending coefficients."""
    return reduce(lambda acc, c: acc * x + F.lit(float(c)), reversed(coefficients[:-1]), F.lit(float(coefficients[-1])))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


# The published polynomial approximations of the Bessel function I0.
I0_SMALL = [1.0, 3.5156229, 3.0899424, 1.2067492, 0.2659732, 0.0360768, 0.0045813]
I0_LARGE = [0.39894228, 0.01328592, 0.00225319, -0.00157565, 0.00916281, -0.02057706, 0.02635537, -0.01647633, 0.00392377]


def bessel_i0(x: Column) -> Column:
    a = F.abs(x)
    small = horner((a / 3.75) * (a / 3.75), I0_SMALL)
    large = F.exp(a) / F.sqrt(a) * horner(F.lit(3.75) / a, I0_LARGE)
    return F.when(a < 3.75, small).otherwise(large)


def sinc(x: Column) -> Column:
    return F.when(F.abs(x) < 1e-12, F.lit(1.0)).otherwise(F.sin(F.lit(math.pi) * x) / (F.lit(math.pi) * x))


def window(kind: str, x: Column, order: int = 2, beta: float = 5.0, taper: float = 0.5) -> Column:
    """An apodisation window on x = f / cutoff in [0, 1]; 0 beyond."""
    pi = F.lit(math.pi)
    edge = F.lit(taper / 2)
    forms = {
        "ram_lak": lambda: F.lit(1.0),
        "shepp_logan": lambda: sinc(x / 2),
        "cosine": lambda: F.cos(pi * x / 2),
        "hann": lambda: 0.5 * (1 + F.cos(pi * x)),
        "hamming": lambda: 0.54 + 0.46 * F.cos(pi * x),
        "blackman": lambda: 0.42 + 0.5 * F.cos(pi * x) + 0.08 * F.cos(2 * pi * x),
        "butterworth": lambda: 1 / (1 + F.pow(x, F.lit(2.0 * order))),
        "kaiser": lambda: bessel_i0(F.lit(beta) * F.sqrt(F.greatest(1 - (2 * x - 1) * (2 * x - 1), F.lit(0.0)))) / bessel_i0(F.lit(beta)),
        "tukey": lambda: F.when(x < edge, 0.5 * (1 + F.cos(pi * (x / edge - 1)))).when(x > 1 - edge, 0.5 * (1 + F.cos(pi * ((x - 1) / edge + 1)))).otherwise(1.0),
    }
    return F.when(x.between(0.0, 1.0), forms[kind]()).otherwise(0.0)


def ramp_kernel(k: Column) -> Column:
    """The discrete ramp of unit spacing at integer offset k."""
    return F.when(k == 0, F.lit(0.25)).when(k % 2 == 0, F.lit(0.0)).otherwise(-1.0 / (F.lit(math.pi**2) * k * k))


def hash32(x: Column) -> Column:
    """A 32-bit mixing hash of a long in [0, 2^32): the counter-based generator's core."""
    mask = F.lit(0xFFFFFFFF)
    x = x.bitwiseXOR(F.shiftright(x, 16))
    x = (x * F.lit(0x7FEB352D)).bitwiseAND(mask)
    x = x.bitwiseXOR(F.shiftright(x, 15))
    x = _times(x, 0x846CA68B)
    return x.bitwiseXOR(F.shiftright(x, 16))


def _times(x: Column, m: int) -> Column:
    """x * m modulo 2^32 where the product passes 63 bits: by halves of m."""
    low, high = m & 0xFFFF, m >> 16
    mask = F.lit(0xFFFFFFFF)
    return ((x * F.lit(low)) + F.shiftleft((x * F.lit(high)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(mask)


def uniform24(h: Column) -> Column:
    return h.bitwiseAND(F.lit(0xFFFFFF)) / F.lit(float(1 << 24))


def mu_to_hu(mu: Column, mu_water: float, mu_air: float = 0.0, hu_water: float = 0.0, hu_air: float = -1000.0) -> Column:
    scale = (hu_water - hu_air) / (mu_water - mu_air)
    return mu * F.lit(scale) + F.lit(hu_air - scale * mu_air)


def hu_to_mu(hu: Column, mu_water: float, mu_air: float = 0.0, hu_water: float = 0.0, hu_air: float = -1000.0) -> Column:
    scale = (hu_water - hu_air) / (mu_water - mu_air)
    return (hu - F.lit(hu_air - scale * mu_air)) / F.lit(scale)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def simpson(values: Column, step: float) -> Column:
    """Simpson's rule over an array of an odd number of values, ``step`` apart."""
    last = F.size(values) - 1
    weighted = F.transform(values, lambda x, i: x * F.when((i == 0) | (i == last), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0))
    return F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x) * step / 3


def voxel_place(point: Column, grid) -> list[Column]:
    """A point's place in voxels from the first voxel's centre, by axis."""
    return [(point[a] - F.lit(e)) / F.lit(s) - 0.5 for a, s, e in zip("xyz", grid.voxel, grid.edge, strict=True)]


# 3-vectors are structs of x, y, z.
def vec(x, y, z) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def scaled(a: Column, k) -> Column:
    return vec(a["x"] * k, a["y"] * k, a["z"] * k)


def plus(a: Column, b: Column) -> Column:
    return vec(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def minus(a: Column, b: Column) -> Column:
    return vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def rotate_z(a: Column, angle: Column) -> Column:
    c, s = F.cos(angle), F.sin(angle)
    return vec(c * a["x"] - s * a["y"], s * a["x"] + c * a["y"], a["z"])


def rodrigues(a: Column, axis: Column, angle: Column) -> Column:
    """``a`` turned about a unit axis."""
    c, s = F.cos(angle), F.sin(angle)
    return plus(plus(scaled(a, c), scaled(cross(axis, a), s)), scaled(axis, dot(axis, a) * (1 - c)))

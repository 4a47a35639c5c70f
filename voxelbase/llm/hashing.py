"""Vectorised polynomial hashes of substrings, for use inside Arrow tasks.

Two independent lanes modulo 2^64 with random byte tables and random odd bases;
a substring's hash is a difference of prefix sums times an inverse power.
"""

from __future__ import annotations

from functools import cache

import numpy as np

U = np.uint64


@cache
def _lane(lane: int) -> tuple[np.ndarray, int]:
    rng = np.random.Generator(np.random.PCG64(0x5EED0 + lane))
    return rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1), int(rng.integers(0, 2**62)) * 4 + 3


@cache
def _powers(lane: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = _lane(lane)[1]
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(size, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x *= U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


class Substrings:
    """Hashes of any substrings of one buffer, by their starts and ends."""

    def __init__(self, data: np.ndarray, lane: int):
        size = 1 << max(16, int(len(data)).bit_length())
        power, self.inverse = _powers(lane, size)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_lane(lane)[0][data] * power[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + length)

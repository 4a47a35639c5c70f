"""Frames made of columns of neighbouring frames, in blocks of views with a halo.

Each column of a target view is a weighted sum of columns of views at fixed distances, so a
block of consecutive targets needs the views of its own span and a halo. Frames are sent to
the few blocks that need them; a full circle wraps round.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Target views in a block, at least.
BLOCK = 64
SCHEMA = "view long, data array<double>"


@dataclass(frozen=True, eq=False)
class Gather:
    views: int
    rows: int
    columns: int
    corners: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # views after the target, source column, weight; each by target column
    lead: int = 0
    period: int | None = None  # views of a full circle
    least: int = field(default_factory=lambda: BLOCK)

    @property
    def low(self) -> int:
        return self.lead + min(int(after.min()) for after, _, _ in self.corners)

    @property
    def high(self) -> int:
        return self.lead + max(int(after.max()) for after, _, _ in self.corners)

    @property
    def size(self) -> int:
        return max(self.least, self.high - self.low)

    @property
    def blocks(self) -> int:
        return -(-self.views // self.size)

    def targets(self, block: int) -> tuple[int, int]:
        return block * self.size, min((block + 1) * self.size, self.views)

    def sources(self, block: int) -> np.ndarray:
        """The views that a block's targets reach, from the first on; on a circle modulo the turn."""
        first, last = self.targets(block)
        at = np.arange(first + self.low, last + self.high)
        return at % self.period if self.period else at

    def needed(self, block: int) -> int:
        """How many views that is."""
        first, last = self.targets(block)
        span = last - first + self.high - self.low
        return min(span, self.period) if self.period else span

    def made(self, block: int, found: dict[int, np.ndarray]) -> list[tuple[int, np.ndarray]]:
        """(view, data) of a block's targets from its frames by view; views that lack count as 0."""
        first, last = self.targets(block)
        raw = np.zeros((last - first + self.high - self.low, self.rows, self.columns))
        for i, view in enumerate(self.sources(block).tolist()):
            if view in found:
                raw[i] = found[view].reshape(self.rows, self.columns)
        at = np.arange(last - first)[:, None] + self.lead - self.low
        out = sum(raw[at + after, :, column] * weight[:, None] for after, column, weight in self.corners)  # (views, columns, rows)
        return [(first + i, x.T.ravel()) for i, x in enumerate(out)]

    def made_from(self, first: int, last: int, chunk: int, frames) -> np.ndarray:
        """The frames (targets, pixels) of targets first to last - 1; ``frames`` gives (views, frames) of a chunk of ``chunk`` views, one chunk at a time."""
        target = np.arange(first, last)[:, None] + self.lead
        at = [target + after[None, :] for after, _, _ in self.corners]
        at = [a % self.period for a in at] if self.period else at
        found = [np.zeros((*a.shape, self.rows)) for a in at]
        for k in np.unique(np.concatenate([np.unique(a // chunk) for a in at])).tolist():
            got = frames(k)
            if got is None:
                continue
            whole = np.zeros((chunk, self.rows, self.columns))
            whole[got[0] - k * chunk] = got[1].reshape(-1, self.rows, self.columns)
            for a, (_, column, _), values in zip(at, self.corners, found, strict=True):
                i, j = np.nonzero(a // chunk == k)
                values[i, j] = whole[a[i, j] - k * chunk, :, column[j]]
        out = sum(values * weight[None, :, None] for values, (_, _, weight) in zip(found, self.corners, strict=True))
        return out.transpose(0, 2, 1).reshape(last - first, -1)

    def blocks_of(self, view: Column) -> Column:
        """The blocks that need a frame."""
        parts = []
        for turn in (-self.period, 0, self.period) if self.period else (0,):
            at = view + turn
            begin = F.greatest(F.lit(0), F.ceil((at - (self.high + self.size - 1)) / self.size).cast("long"))
            end = F.least(F.lit(self.blocks - 1), F.floor((at - self.low) / self.size).cast("long"))
            near = F.when(begin <= end, F.sequence(begin, end)).otherwise(F.array().cast("array<long>"))
            parts.append(F.filter(near, self._needs(at)))
        return F.array_distinct(F.concat(*parts))

    def _needs(self, at: Column):
        return lambda k: (at >= k * self.size + self.low) & (at < F.least((k + 1) * self.size, F.lit(self.views)) + self.high)

    def dealt(self, frames: DataFrame) -> DataFrame:
        return frames.select("view", "data", F.explode(self.blocks_of(F.col("view"))).alias("block"))

    def run(self, frames: DataFrame) -> DataFrame:
        """(view, data) of the targets."""

        def one(key, table):
            found = {v: d.values.to_numpy(zero_copy_only=False) for v, d in zip(table.column("view").to_pylist(), table.column("data"), strict=True)}
            views, data = zip(*self.made(key[0].as_py(), found), strict=True)
            return pa.table({"view": pa.array(views, pa.int64()), "data": pa.array(data, pa.list_(pa.float64()))})

        return self.dealt(frames).groupBy("block").applyInArrow(one, SCHEMA)

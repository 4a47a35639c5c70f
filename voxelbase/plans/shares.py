"""Volumes added up from shares: arrays over slabs of voxels that tasks give off for their views.

A slab's shares are added in two levels, first ``SALTS`` groups of them, then the groups, so
no task meets all shares of a long scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Voxels in a slab, at least a plane, and groups of a slab's shares.
SLAB, SALTS = 1 << 19, 64
SCHEMA = "slab long, part long, share array<double>"


def slab_depth(grid, most: int | None = None) -> int:
    """Planes in a slab."""
    return max(1, min(grid.nz, SLAB // (grid.nx * grid.ny), most or grid.nz))


def share(slab: int, part: int, values: np.ndarray) -> pa.RecordBatch:
    values = np.ascontiguousarray(values, dtype=np.float64).ravel()
    data = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
    return pa.RecordBatch.from_arrays([pa.array([slab], pa.int64()), pa.array([part], pa.int64()), data], names=["slab", "part", "share"])


def _total(table: pa.Table) -> np.ndarray:
    total = None
    for chunk in table.column("share").chunks:
        for values in chunk:
            own = values.values.to_numpy(zero_copy_only=False)
            total = own.copy() if total is None else np.add(total, own, out=total)
    return total


def add_shares(shares: DataFrame, size: int) -> DataFrame:
    """(voxel_id, value) of ``shares`` (slab, part, share); slabs hold ``size`` voxels, the last may be shorter."""

    def some(key, table):
        return pa.Table.from_batches([share(key[0].as_py(), 0, _total(table))])

    def whole(key, table):
        total, base = _total(table), key[0].as_py() * size
        return pa.table({"voxel_id": pa.array(np.arange(base, base + len(total))), "value": pa.array(total)})

    fewer = shares.groupBy("slab", F.pmod("part", F.lit(SALTS)).alias("salt")).applyInArrow(some, SCHEMA)
    return fewer.groupBy("slab").applyInArrow(whole, "voxel_id long, value double")


def zero_shares(spark, grid, depth: int) -> DataFrame:
    """A share of zeros for every slab, so that voxels no view meets are in the volume too."""
    plane = grid.nx * grid.ny

    def run(batches):
        for batch in batches:
            for slab in batch.column("id").to_pylist():
                yield share(slab, 0, np.zeros(plane * min(depth, grid.nz - slab * depth)))

    return spark.range(-(-grid.nz // depth)).mapInArrow(run, SCHEMA)

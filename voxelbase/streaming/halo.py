"""Streams of frames whose targets need neighbouring views: keyed state for each block of targets.

A frame goes to the blocks that need it; a block holds its frames, packed by chunks of views, until the last has
come, gives off its targets by runs of ``BLOCK`` and lets go. Frames may come in packets of any size and in any
order, round the circle too; a frame sent again replaces itself, and one for a block
that is done is passed over. State lives in the query's checkpoint, so a restart goes on where
the last batch ended.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from voxelbase.functions import packs
from voxelbase.plans.halo import BLOCK, SCHEMA, Gather

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Blocks(StatefulProcessor):
    def __init__(self, gather: Gather):
        self.gather = gather

    def init(self, handle):
        self.pending = handle.getMapState("pending", "chunk long", packs.SCHEMA)
        self.packs = packs.Packs(self.pending, BLOCK)
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timers):
        block, held = int(key[0]), self.count.get()[0] if self.count.exists() else 0
        for part in rows:
            if held < 0:
                continue
            for chunk, new in self.packs.dealt(part["view"].to_numpy(dtype=np.int64), part["data"].to_numpy()).items():
                old = self.packs.get(chunk)
                views, data = self.packs.merged(old, new)
                held += len(views) - (0 if old is None else len(old[0]))
                self.packs.put(chunk, views, data)
        if held == self.gather.needed(block):
            first, last = self.gather.targets(block)
            for begin in range(first, last, BLOCK):  # what is held at once doesn't grow with the block
                end = min(begin + BLOCK, last)
                yield pd.DataFrame({"view": np.arange(begin, end), "data": list(self.gather.made_from(begin, end, BLOCK, self.packs.get))})
            self.pending.clear()
            self.count.update((-1,))
        elif held >= 0:
            self.count.update((int(held),))

    def close(self):
        pass


def gathered(frames: DataFrame, gather: Gather) -> DataFrame:
    """The stream (view, data) of targets of a stream of frames."""
    return gather.dealt(frames).groupBy("block").transformWithStateInPandas(_Blocks(gather), SCHEMA, "append", "none")


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that keyed state needs, for queries started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def reconstruct(targets: DataFrame, project, parts: str, checkpoint: str) -> None:
    """Run a stream of targets to its present end; ``project`` turns a batch of them into a partial volume, kept by batch."""

    def one(batch: DataFrame, number: int) -> None:
        project(batch).where("value <> 0").write.mode("overwrite").parquet(f"{parts}/batch={number}")

    with keyed_state(targets.sparkSession):
        targets.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def volume(spark: SparkSession, parts: str) -> DataFrame:
    return spark.read.schema("voxel_id long, value double, batch long").parquet(parts).groupBy("voxel_id").agg(F.sum("value").alias("value"))

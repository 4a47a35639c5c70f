"""Detector afterglow with any number of exponential traps, exact over a whole scan and over streams.

A trap takes a share of each frame's signal, gives part of it back during the exposure and
decays between exposures, so a pixel's trap is an affine recurrence over frames. Whole
scans are cut into chunks of frames: each chunk's effect on a trap is a gain and an offset,
these pairs are scanned over chunks in blocks of pixels, and the recurrence then runs
inside the chunks, all at once. No history is cut off. Streams carry the same state.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from voxelbase.functions import packs
from voxelbase.functions.packs import Packs

SCHEMA = "view long, data array<double>"
#: Frames in a chunk, and pixels whose pairs one task scans.
CHUNK, PIXELS = 64, 1 << 14


@dataclass(frozen=True)
class Traps:
    """``share`` of the signal is trapped, split by ``weights`` over traps of time constants ``taus`` (ms)."""

    share: float
    weights: tuple[float, ...]
    taus: tuple[float, ...]
    exposure: float
    frame: float
    steady: bool = False  # start as after many frames like the first; else empty

    def __post_init__(self):
        if not (0 <= self.share <= 1 and len(self.weights) == len(self.taus) and all(t > 0 for t in self.taus) and 0 < self.exposure <= self.frame):
            raise ValueError("traps need a share of 0 to 1, a weight for each time constant and an exposure within the frame")

    @property
    def _decays(self) -> tuple[np.ndarray, np.ndarray]:
        tau = np.array(self.taus)[:, None]
        return np.exp(-self.exposure / tau), np.exp(-(self.frame - self.exposure) / tau)

    @property
    def gain(self) -> np.ndarray:
        """What a frame leaves of a trap's content, (traps, 1)."""
        a, b = self._decays
        return a * b

    @property
    def intake(self) -> np.ndarray:
        """What a frame's unit signal leaves in a trap."""
        a, b = self._decays
        return self.share * np.array(self.weights)[:, None] * np.array(self.taus)[:, None] * (1 - a) / self.exposure * b

    @property
    def given(self) -> np.ndarray:
        """What a trap's content gives to a frame."""
        return 1 - self._decays[0]

    @property
    def prompt(self) -> float:
        """What a frame has of its own signal."""
        w, tau = np.array(self.weights), np.array(self.taus)
        return float(1 - self.share + (self.share * w * (1 - tau * self.given[:, 0] / self.exposure)).sum())

    def start(self, first: np.ndarray) -> np.ndarray:
        """The traps (traps, pixels) before the first frame."""
        return self.intake / np.maximum(1 - self.gain, 1e-6) * first if self.steady else np.zeros((len(self.taus), len(first)))

    def run(self, frames: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The frames (n, pixels) as read out, and the traps after them."""
        out = np.empty_like(frames)
        for i, signal in enumerate(frames):
            out[i] = self.prompt * signal + (state * self.given).sum(axis=0)
            state = state * self.gain + self.intake * signal
        return out, state


def _frames(table) -> tuple[list[int], np.ndarray]:
    views = table.column("view").to_pylist()
    order = np.argsort(views, kind="stable")
    data = np.stack([x.values.to_numpy(zero_copy_only=False) for x in table.column("data")])
    return [views[i] for i in order], data[order]


def afterglow(frames: DataFrame, traps: Traps) -> DataFrame:
    """(view, data) of frames (view, data) of equal size, one step of time each in order of view."""
    frames = frames.select(F.col("view").cast("long").alias("view"), "data").withColumn("chunk", F.floor(F.col("view") / CHUNK))
    first = frames.agg(F.min("chunk")).first()[0]
    n = len(traps.taus)

    def pairs(key, table):
        _, data = _frames(table)
        chunk = key[0].as_py()
        _, state = traps.run(data, traps.start(data[0]) if chunk == first else np.zeros((n, data.shape[1])))
        blocks = range(0, data.shape[1], PIXELS)
        return pa.table({"chunk": [chunk] * len(blocks), "block": list(range(len(blocks))), "steps": [len(data)] * len(blocks), "offset": pa.array([state[:, i : i + PIXELS].ravel() for i in blocks], pa.list_(pa.float64()))})

    def scan(key, table):
        rows = sorted(zip(table.column("chunk").to_pylist(), table.column("steps").to_pylist(), table.column("offset"), strict=True), key=lambda r: r[0])
        state, out = 0.0, []
        for _, steps, offset in rows:
            out.append(np.ravel(state) if len(out) else np.zeros(len(offset.values)))
            state = state * traps.gain**steps + offset.values.to_numpy(zero_copy_only=False).reshape(n, -1)
        return pa.table({"chunk": [r[0] for r in rows], "block": [key[0].as_py()] * len(rows), "state": pa.array(out, pa.list_(pa.float64()))})

    def read(key, own, states):
        views, data = _frames(own)
        parts = [x.values.to_numpy(zero_copy_only=False).reshape(n, -1) for _, x in sorted(zip(states.column("block").to_pylist(), states.column("state"), strict=True), key=lambda r: r[0])]
        state = traps.start(data[0]) if key[0].as_py() == first else np.concatenate(parts, axis=1)
        out, _ = traps.run(data, state)
        return pa.table({"view": pa.array(views, pa.int64()), "data": pa.array(list(out), pa.list_(pa.float64()))})

    offsets = frames.groupBy("chunk").applyInArrow(pairs, "chunk long, block long, steps long, offset array<double>")
    states = offsets.groupBy("block").applyInArrow(scan, "chunk long, block long, state array<double>")
    return frames.groupBy("chunk").cogroup(states.groupBy("chunk")).applyInArrow(read, SCHEMA)


class _Detector(StatefulProcessor):
    """The traps of one scan; frames wait for those before them, packed by chunks of ``CHUNK`` views."""

    def __init__(self, traps: Traps):
        self.traps = traps

    def init(self, handle):
        self.state = handle.getValueState("traps", "next long, content array<double>")
        self.early = handle.getMapState("early", "chunk long", packs.SCHEMA)
        self.packs = Packs(self.early, CHUNK)

    def handleInputRows(self, key, rows, timers):
        at, content = (self.state.get() if self.state.exists() else (0, None))
        state = None if content is None else np.asarray(content, dtype=np.float64).reshape(len(self.traps.taus), -1)
        for part in rows:
            views = part["view"].to_numpy(dtype=np.int64)
            late = views >= at
            chunks = self.packs.dealt(views[late], part["data"].to_numpy()[late])
            begin, out = at, []
            while True:  # chunk by chunk, as far as no frame lacks
                chunk = at // CHUNK
                new, held = chunks.pop(chunk, None), self.packs.get(chunk)
                if new is None and held is None:
                    break
                views, data = self.packs.merged(held, new)
                first = int(np.searchsorted(views, at))
                n = int((views[first:] == at + np.arange(len(views) - first)).sum())
                if n:
                    if state is None:
                        state = self.traps.start(data[first])
                    done, state = self.traps.run(data[first : first + n], state)
                    out.append(done)
                    at += n
                left = first + n
                if left == len(views):
                    if held is not None:
                        self.early.removeKey((chunk,))
                elif new is not None or n:
                    self.packs.put(chunk, views[left:], data[left:])
                if at // CHUNK == chunk:
                    break
            for chunk, new in chunks.items():
                views, data = self.packs.merged(self.packs.get(chunk), new)
                self.packs.put(chunk, views, data)
            if out:
                self.state.update((int(at), state.ravel().tolist()))
                yield pd.DataFrame({"scan": key[0], "view": np.arange(begin, at), "data": list(np.concatenate(out))})

    def close(self):
        pass


def afterglow_stream(frames: DataFrame, traps: Traps) -> DataFrame:
    """The stream (scan, view, data) of a stream of frames, views from 0 on; a scan's air and object frames are scans of their own.

    A frame ahead of its turn waits in the state; one sent again is passed over. Needs ``streaming.halo.keyed_state``.
    """
    return frames.groupBy("scan").transformWithStateInPandas(_Detector(traps), f"scan string, {SCHEMA}", "append", "none")

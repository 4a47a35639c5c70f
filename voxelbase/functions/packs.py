"""Frames in keyed state, packed by chunks of views: a few state calls for each chunk instead of some for each frame."""

from __future__ import annotations

import numpy as np

SCHEMA = "views binary, data binary"


class Packs:
    """Frames of equal size by view in a map state with keys ``chunk long`` and values ``SCHEMA``."""

    def __init__(self, state, chunk: int):
        self.state, self.chunk = state, chunk

    def get(self, chunk: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(views, frames) of a chunk in order, or nothing."""
        if not self.state.containsKey((chunk,)):
            return None
        views, data = (bytes(x) for x in self.state.getValue((chunk,)))
        views = np.frombuffer(views, dtype=np.int64)
        return views, np.frombuffer(data, dtype=np.float64).reshape(len(views), -1)

    def put(self, chunk: int, views: np.ndarray, data: np.ndarray) -> None:
        self.state.updateValue((chunk,), (views.tobytes(), data.tobytes()))

    def dealt(self, views: np.ndarray, data) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Frames by chunk."""
        order, out = np.argsort(views, kind="stable"), {}
        for some in np.split(order, np.flatnonzero(np.diff(views[order] // self.chunk)) + 1) if len(order) else []:
            out[int(views[some[0]] // self.chunk)] = (views[some], np.stack([np.asarray(data[i], dtype=np.float64) for i in some]))
        return out

    @staticmethod
    def merged(held, new) -> tuple[np.ndarray, np.ndarray]:
        """Views in order with their frames; of those sent again the latest."""
        parts = [p for p in (held, new) if p is not None]
        views, data = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(views, kind="stable")
        order = order[np.append(np.diff(views[order]) > 0, True)]
        return views[order], data[order]

"""Afterglow against a loop over all frames: chunks, blocks, slow decays, both starts, streams."""

import numpy as np
import pandas as pd
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelbase.operators import traps
from voxelbase.operators.traps import Traps, _Detector, afterglow, afterglow_stream
from voxelbase.streaming.halo import keyed_state

SCHEMA = "view long, data array<double>"


def loop(frames, t):
    """Trap by trap and frame by frame, as the charge flows: intake and release over the exposure, decay over the readout."""
    held, out = None, []
    for signal in frames:
        if held is None:
            held = [np.zeros_like(signal) for _ in t.taus]
            if t.steady:  # what very many frames like the first leave
                for k, (w, tau) in enumerate(zip(t.weights, t.taus)):
                    e, r = np.exp(-t.exposure / tau), np.exp(-(t.frame - t.exposure) / tau)
                    held[k] = r * t.share * w * tau * (1 - e) / t.exposure / (1 - e * r) * signal
        seen = (1 - t.share) * signal
        for k, (w, tau) in enumerate(zip(t.weights, t.taus)):
            e = np.exp(-t.exposure / tau)
            taken = t.share * w * signal
            seen = seen + held[k] * (1 - e) + taken * (1 - tau * (1 - e) / t.exposure)
            held[k] = (held[k] * e + taken * tau * (1 - e) / t.exposure) * np.exp(-(t.frame - t.exposure) / tau)
        out.append(seen)
    return np.array(out)


@pytest.mark.parametrize("steady", [False, True])
def test_whole_scan_equals_the_loop(spark, monkeypatch, steady):
    monkeypatch.setattr(traps, "CHUNK", 16)
    t = Traps(0.08, (0.5, 0.3, 0.2), (2.0, 50.0, 20_000.0), 7.0, 16.0, steady)
    frames = np.random.default_rng(3).random((90, 30)) + 0.1
    rows = [(i + 5, f.tolist()) for i, f in enumerate(frames)]
    got = {r.view: r.data for r in afterglow(spark.createDataFrame(rows, SCHEMA).repartition(5), t).collect()}
    want = loop(frames, t)
    assert sorted(got) == list(range(5, 95)) and max(np.abs(np.array(got[i + 5]) - want[i]).max() for i in range(90)) < 1e-12
    assert abs(want[60:] - loop(frames[40:], t)[20:]).max() > 1e-4  # what a history cut off at 20 frames would lose


def test_energy_is_kept(spark):
    t = Traps(0.1, (1.0,), (30.0,), 10.0, 20.0)
    rows = [(0, [1.0])] + [(i, [0.0]) for i in range(1, 200)]
    total = afterglow(spark.createDataFrame(rows, SCHEMA), t).agg(F.sum(F.col("data")[0])).first()[0]
    assert 0.9 < total < 1.0  # what decays between exposures is not read out


def test_faults_are_refused():
    for wrong in ((1.2, (1.0,), (1.0,), 1.0, 2.0), (0.1, (1.0, 2.0), (1.0,), 1.0, 2.0), (0.1, (1.0,), (0.0,), 1.0, 2.0), (0.1, (1.0,), (1.0,), 3.0, 2.0)):
        with pytest.raises(ValueError):
            Traps(*wrong)


def test_streams_of_signal_and_air_keep_their_own_traps(spark, tmp_path):
    """Frames out of order and twice, over three runs from one checkpoint."""
    t, rng, path = Traps(0.08, (0.6, 0.4), (5.0, 900.0), 7.0, 16.0, True), np.random.default_rng(8), str(tmp_path)
    scans = {"object": rng.random((40, 6)), "air": rng.random((25, 6)) + 2}
    schema = f"scan string, {SCHEMA}"
    for views in ([3, 1, 0, 2, 8, 9], [4, 6, 5, 7, 2, 10, 30], [*range(11, 40)]):
        rows = [(s, v, f[v].tolist()) for s, f in scans.items() for v in views if v < len(f)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{path}/in")
        with keyed_state(spark):
            afterglow_stream(stream, t).writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/out/batch={n}")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = {(r.scan, r.view): r.data for r in spark.read.schema(schema).parquet(f"{path}/out").collect()}
    assert len(got) == 65
    for s, f in scans.items():
        assert max(np.abs(np.array(got[s, i]) - x).max() for i, x in enumerate(loop(f, t))) < 1e-12


class _Store:
    """State as a dictionary that counts the calls that would leave the worker."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getValueState(self, name, *schemas):  # noqa: N802
        return self

    getMapState = getValueState

    def exists(self):
        return None in self.held

    def get(self):
        return self.held[None]

    def update(self, value):
        self.held[None] = value

    def containsKey(self, key):  # noqa: N802
        self.calls += 1
        return key in self.held

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.held[key]

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self.held[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        del self.held[key]


def test_waiting_frames_are_kept_by_chunks():
    """Odd frames first, then even ones with some sent again: a few state calls for each 64 frames, not for each frame."""
    t, rng = Traps(0.08, (0.6, 0.4), (5.0, 900.0), 7.0, 16.0, True), np.random.default_rng(9)
    frames, store = rng.random((2000, 3)), _Store()
    detector, out = _Detector(t), []
    detector.init(store)
    for views in (range(1, 2000, 2), [*range(999, 0, -2), *range(1000, 2000, 2)], range(0, 1000, 2), [5, 1998]):
        part = pd.DataFrame({"view": list(views), "data": [frames[v] for v in views]})
        out += [b for b in detector.handleInputRows(("object",), iter([part.iloc[:300], part.iloc[300:]]), None)]
    got = pd.concat(out)
    assert got["view"].tolist() == list(range(2000)) and np.abs(np.stack(got["data"]) - loop(frames, t)).max() < 1e-12
    assert set(store.held) == {None} and store.calls < 600

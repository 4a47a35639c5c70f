"""RAW float32 stacks as a Spark data source: fixed-size frames, one view after another.

    spark.dataSource.register(RawFloat32)
    spark.read.format("raw_float32").option("frame", 64).load(path)
    frames.write.format("raw_float32").mode("append").save(path)

Each partition reads its range of views with one seek through Arrow's file
systems; a folder's files are stacks of their own, numbered by name. The size
must be a whole number of frames, and every value finite.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

BATCH = 256


def _open(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Views(InputPartition):
    def __init__(self, path: str, first: int, count: int, base: int):
        self.path, self.first, self.count, self.base = path, first, count, base


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.frame = options["path"], int(options["frame"])
        self.views = int(options.get("views_per_partition", 4096))

    def partitions(self):
        fs, path = _open(self.path)
        info = fs.get_file_info(path)
        files = [info] if info.is_file else sorted((f for f in fs.get_file_info(pafs.FileSelector(path)) if f.is_file and f.path.endswith(".raw")), key=lambda f: f.path)
        out, base = [], 0
        for f in files:
            if f.size % (4 * self.frame):
                raise ValueError(f"{f.path}: {f.size} bytes are not whole frames of {self.frame} values")
            n = f.size // (4 * self.frame)
            out += [Views(f.path, i, min(self.views, n - i), base) for i in range(0, n, self.views)]
            base += n
        return out

    def read(self, part: Views):
        fs, _ = _open(self.path)
        with fs.open_input_file(part.path) as f:
            for i in range(part.first, part.first + part.count, BATCH):
                n = min(BATCH, part.first + part.count - i)
                f.seek(4 * self.frame * i)
                data = np.frombuffer(f.read(4 * self.frame * n), dtype="<f4")
                if not np.isfinite(data).all():
                    raise ValueError(f"{part.path}: values that are not finite near view {i}")
                offsets = pa.array(np.arange(0, len(data) + 1, self.frame), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.base + i, part.base + i + n)), pa.ListArray.from_arrays(offsets, pa.array(data, pa.float32()))], names=["view", "data"])


class Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class Writer(DataSourceArrowWriter):
    """One file per task, named by its first view; a failed task's file is overwritten by its next attempt."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, batches):
        fs, path = _open(self.path)
        fs.create_dir(path, recursive=True)
        f, name = None, ""
        for b in batches:
            for view, data in zip(b.column("view").to_pylist(), b.column("data"), strict=True):
                if f is None:
                    name = f"{path}/{view:012d}.raw"
                    f = fs.open_output_stream(name)
                f.write(data.values.to_numpy().astype("<f4").tobytes())
        if f:
            f.close()
        return Written(name)

    def commit(self, messages):
        pass

    def abort(self, messages):
        fs, _ = _open(self.path)
        for m in messages:
            if m and m.path:
                fs.delete_file(m.path)


class RawFloat32(DataSource):
    @classmethod
    def name(cls):
        return "raw_float32"

    def schema(self):
        return "view long, data array<float>"

    def reader(self, schema):
        return Reader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options)

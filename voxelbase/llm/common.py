"""What the corpus operators share: scratch tables, bounded Bloom filters, components.

Scratch tables live below ``spark.checkpoint.dir``, the folder that the cluster
shares, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits in one block of a filter: Spark's bitmap aggregate makes 4 KB blocks.
BLOCK_BITS = 32768
#: Largest filter that is broadcast, in bits (32 MB); a fuller filter lets more rows through.
MAX_FILTER_BITS = 1 << 28
#: Slots that a task holds before it sends them off.
BUFFER_SLOTS = 1 << 22


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; one of this machine only where the session names none and runs on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="voxelbase-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """At most ``rows`` rows in an Arrow batch, for steps that run inside and have wide rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(df: DataFrame) -> None:
    """Delete the scratch tables behind a materialised frame that nothing reads again."""
    root = scratch_root(df.sparkSession)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            delete_path(df.sparkSession, folder)


def carried(docs: DataFrame, used: tuple[str, ...], run) -> DataFrame:
    """``run(docs)`` with all columns but ``used`` under names that nothing inside uses or misreads, given back after.

    So further columns pass through whatever their names: with dots, clashing or twice.
    """
    inner = [c if c in used and c not in docs.columns[:i] else f"carried{i}_" for i, c in enumerate(docs.columns)]
    out, outer = run(docs.toDF(*inner)), dict(zip(inner, docs.columns, strict=True))
    return out.toDF(*(outer.get(c, c) for c in out.columns))


def filter_bits(rows: int, per_row: int = 16, most: int = MAX_FILTER_BITS) -> int:
    """A power of two near ``per_row`` bits a row, at most ``most``."""
    return min(most, max(BLOCK_BITS, 1 << math.ceil(math.log2(max(2, rows * per_row)))))


def _slots(key: Column, bits: int) -> list[Column]:
    """Two places of one block of the filter."""
    h = F.xxhash64(key)
    block = F.floor(F.pmod(h, F.lit(bits)) / BLOCK_BITS) * BLOCK_BITS
    return [F.pmod(h, F.lit(bits)), block + F.pmod(F.xxhash64(h, F.lit(1)), F.lit(BLOCK_BITS))]


def _task_slots(batches):
    """The slots that this task's rows hit, by block: once at least and twice at least, as sorted lists, or bitmaps where those are shorter.

    A task gives off what it has after ``BUFFER_SLOTS`` slots, so its memory is bounded; a slot hit in two portions counts as hit twice when they meet.
    """
    held, size = [], 0

    def portion():
        slots = np.sort(np.concatenate(held))
        once = slots[np.r_[True, slots[1:] != slots[:-1]]]
        twice = slots[1:][slots[1:] == slots[:-1]]
        twice = twice[np.r_[True, twice[1:] != twice[:-1]]] if len(twice) else twice
        blocks = np.unique(once // BLOCK_BITS)
        cut = lambda x: np.split(x, np.searchsorted(x, blocks[1:] * BLOCK_BITS))
        packed = [[_pack(x - b * BLOCK_BITS) for b, x in zip(blocks, cut(y), strict=True)] for y in (once, twice)]
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *(pa.array(x, pa.binary()) for x in packed)], names=["block", "once", "twice"])

    for batch in batches:
        held += [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(batch.num_columns)]
        size += batch.num_columns * batch.num_rows
        if size >= BUFFER_SLOTS:
            yield portion()
            held, size = [], 0
    if size:
        yield portion()


def _pack(slots: np.ndarray) -> bytes:
    """Places in one block: two bytes each, or the whole bitmap where that is shorter."""
    if 2 * len(slots) < BLOCK_BITS // 8:
        return slots.astype("<u2").tobytes()
    return np.packbits(np.bincount(slots, minlength=BLOCK_BITS).astype(bool), bitorder="little").tobytes()


def _places(packed: bytes) -> np.ndarray:
    if len(packed) < BLOCK_BITS // 8:
        return np.frombuffer(packed, dtype="<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, dtype=np.uint8), bitorder="little"))


def _merge(repeated: bool):
    def run(key, table):
        hits = np.zeros(BLOCK_BITS, dtype=np.uint8)
        for name in ("once", "twice"):
            for packed in table.column(name):
                hits[_places(packed.as_py())] = np.minimum(hits[_places(packed.as_py())] + 1, 2) if name == "once" else 2
        bitmap = np.packbits(hits > repeated, bitorder="little").tobytes()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bitmap": pa.array([bitmap], pa.binary())})

    return run


def build_filter(rows: DataFrame, key: str, bits: int, repeated: bool = False) -> DataFrame:
    """A Bloom filter of two probes as a written table (block, bitmap) of at most bits / 8 bytes.

    ``repeated``: only slots that two rows or more have hit are set, so the filter
    answers "may occur again" instead of "may occur". Rows don't shuffle: each
    task sends the places its rows hit, two bytes each at most, to their block.
    """
    slots = rows.select(*(s.alias(f"s{i}") for i, s in enumerate(_slots(F.col(key), bits))))
    parts = slots.mapInArrow(_task_slots, "block long, once binary, twice binary")
    return materialize(parts.groupBy("block").applyInArrow(_merge(repeated), "block long, bitmap binary"), "filter")


def test_filter(rows: DataFrame, key: str, table: DataFrame, bits: int, out: str = "maybe") -> DataFrame:
    """Add the boolean column ``out``: whether the filter may hold the row's key. No shuffle of rows.

    Both probes lie in one block, so one join with the broadcast filter answers.
    """
    names = rows.columns
    slots = _slots(F.col(key), bits)
    block = F.broadcast(table.select(F.col("block").alias("__block"), F.col("bitmap").alias("__bitmap")))  # MAX_FILTER_BITS / 8 bytes at most
    rows = rows.withColumns({f"__s{i}": s for i, s in enumerate(slots)}).join(block, F.expr(f"__s0 div {BLOCK_BITS} = __block"), "left")
    found = F.lit(True)
    for i in range(len(slots)):
        byte = f"conv(hex(substring(__bitmap, cast((__s{i} % {BLOCK_BITS}) div 8 as int) + 1, 1)), 16, 10)"
        found = found & F.coalesce(F.expr(f"(shiftright(cast({byte} as int), cast(__s{i} % 8 as int)) & 1) = 1"), F.lit(False))
    return rows.select(*(F.col(f"`{c}`") for c in names), found.alias(out))


def join_spread(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` (``total`` of them) joined with ``table`` (one row a key, ``n``: rows of that key), hot keys without a shuffle.

    A key is hot if it has more than a quarter of a task's even share, so at most four
    times the number of shuffle partitions are hot: these alone are broadcast.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = total / (4 * parts)
    hot = F.broadcast(table.where(F.col(n) > limit))
    rest = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(n) <= limit), key)
    return rows.join(hot, key).unionByName(rest)


def without_ids(docs: DataFrame, drop: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose key is in ``drop``; null keys stay.

    A bounded filter of the dropped keys is broadcast; only rows it may hold meet
    ``drop`` in a shuffled anti-join, the others pass straight through.
    """
    drop = materialize(drop.select(F.col(key).alias("__key")).where("__key is not null").distinct(), "drop")
    bits = filter_bits(drop.count())
    split = test_filter(docs, key, build_filter(drop, "__key", bits), bits, "__maybe")
    rest = split.where("__maybe").join(drop, F.col(key) == F.col("__key"), "left_anti")
    return split.where("not __maybe").unionByName(rest).select(*docs.columns)


def only_ids(docs: DataFrame, keep: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key is in ``keep`` (distinct ids), most others left out before the shuffle."""
    bits = filter_bits(keep.count())
    split = test_filter(docs, key, build_filter(keep, key, bits), bits, "__maybe")
    keys = keep.select(F.col(key).alias("__key"))
    return split.where("__maybe").join(keys, F.col(key) == F.col("__key"), "left_semi").select(*docs.columns)


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: then each v is its component's smallest id."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) links to (id, component): the smallest id reachable, for every id in a link.

    Alternating large-star and small-star steps until stars are left. Links stay in
    tables; the driver only learns whether any is no star yet. Each join reads two written tables, so
    adaptive execution may split the rows of a hub.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if _is_star_forest(e):
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v")))
        small = materialize(small.distinct(), "edges")
        for x in (e, low, large, low2):
            release(x)
        e = small
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


#: The bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"

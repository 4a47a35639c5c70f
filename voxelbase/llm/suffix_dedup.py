"""Operator 3, removal of repeated substrings by recursive naming and induction.

A byte goes if a string of ``width`` bytes that covers it starts anywhere else
too, in any document. Sorting every suffix through one priority queue is serial,
so the recursion of induced sorting is kept and its queues are Spark's external
sorts and shuffles, which spill to disk:

1. Name. Every window of ``width`` bytes has a smallest gram inside it (the
   sampled suffix it is induced from). Windows in a row with the same anchor
   make a chunk; a chunk's name is the hash of all bytes it spans. Equal names
   mean that all windows in the chunk are repeated. No anchor gram that occurs
   once can hold a repeated window.
2. Recurse. Chunks that share an anchor gram but not a name fall into blocks of
   ``BLOCK`` windows at fixed offsets from the anchor, each with the bytes common
   to its windows (a repeat needs them equal) and the bytes of all of them (equal:
   all repeated).
3. Induce. Blocks left open are settled window by window.

Of equal names one occurrence goes down a level as evidence for the rest, so hot
passages shrink to one row a level. Names are 128 bits in levels 1 to 3: the
anchor's and the span's hash are of independent lanes. Joins carry names, never
pairs of occurrences.

Null texts count as empty; texts under ``width`` bytes keep all their bytes. Rows
that are equal in id and text, ids null or not, count as separate occurrences. Long
texts are handled whole, in pieces that overlap. Of equal names all occurrences go
(no tie keeps one). Columns other than doc_id and text are not read. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, build_filter, filter_bits, materialize, test_filter
from .hashing import Substrings, U, mix

WIDTH, GRAM, BLOCK = 400, 32, 32
#: Bytes that a task hashes at once.
PIECE = 1 << 19
POS = U((1 << 24) - 1)


def chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: text number, first and last window, anchor, anchor hash, span hash of each chunk."""
    span = width - gram + 1
    n = len(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if n < width:
        return none
    grams = Substrings(data, 0)
    at = np.arange(n - gram + 1)
    fp = grams(at, at + gram)
    key = (fp & ~POS) | at.astype(np.uint64)
    rows = -(-len(key) // span)
    table = np.full(rows * span, ~U(0), dtype=np.uint64)
    table[: len(key)] = key
    table = table.reshape(rows, span)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - width + 1
    anchor = (np.minimum(after[:windows], before[span - 1 : span - 1 + windows]) & POS).astype(np.int64)
    out = np.zeros(n + 1, dtype=np.int32)
    np.add.at(out, np.maximum(starts, ends - width + 1), 1)
    np.add.at(out, ends, -1)
    at = np.flatnonzero(np.cumsum(out[:windows]) == 0)
    if not len(at):
        return none
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(anchor[at]) != 0)
    first = np.flatnonzero(new)
    lo, hi = at[first], at[np.append(first[1:], len(at)) - 1]
    a = anchor[lo]
    text = np.searchsorted(starts, lo, side="right") - 1
    return text, lo, hi, a, fp[a], Substrings(data, 1)(lo, hi + width)


def _pieces(texts: pa.Array, width: int):
    """Groups of (row, offset, bytes) of at most about PIECE bytes; long texts are cut with an overlap."""
    group, size = [], 0
    for i, t in enumerate(texts):
        b = (t.as_py() or "").encode()
        for s in range(0, max(1, len(b)), PIECE):
            part = b[s : s + PIECE + width - 1]
            if len(part) >= width:
                group.append((i, s, part))
                size += len(part)
                if size >= PIECE:
                    yield group
                    group, size = [], 0
    if group:
        yield group


def _name_chunks(width: int, gram: int):
    def run(batches):
        for batch in batches:
            keys = batch.column("key")
            for group in _pieces(batch.column("text"), width):
                data = np.frombuffer(b"".join(p for _, _, p in group), dtype=np.uint8)
                ends = np.cumsum([len(p) for _, _, p in group])
                starts = np.concatenate([[0], ends[:-1]])
                text, lo, hi, a, core, hull = chunks(data, starts, ends, width, gram)
                if not len(text):
                    continue
                shift = np.array([s for _, s, _ in group])[text] - starts[text]
                row = pa.array(np.array([i for i, _, _ in group])[text])
                yield pa.RecordBatch.from_arrays([keys.take(row), pa.array(core.view(np.int64)), pa.array(hull.view(np.int64)), pa.array(a + shift), pa.array(lo + shift), pa.array(hi + shift)], names=["key", "core", "hull", "a", "lo", "hi"])

    return run


ROWS = "key binary, core long, hull long, a long, lo long, hi long"


def _substring_hashes(b: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Lane-1 hashes of substrings of a text of any length, piece by piece."""
    out = np.zeros(len(start), dtype=np.uint64)
    data = np.frombuffer(b, dtype=np.uint8)
    piece = start // PIECE
    for p in np.unique(piece):
        rows = np.flatnonzero(piece == p)
        base = int(p) * PIECE
        out[rows] = Substrings(data[base : int(end[rows].max())], 1)(start[rows] - base, end[rows] - base)
    return out


def _open_blocks(width: int, block: int):
    """(key, text, rows: [(core, a, lo, hi)]) to blocks of ``block`` windows at fixed offsets from the anchor."""

    def run(batches):
        for batch in batches:
            for key, text, rows in zip(batch.column("key"), batch.column("text"), batch.column("rows"), strict=True):
                b = text.as_py().encode()
                core, a, lo, hi = (rows.values.field(i).to_numpy() for i in range(4))
                first, last = (a - hi) // block, (a - lo) // block
                n = last - first + 1
                r = np.repeat(np.arange(len(a)), n)
                j = first[r] + np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
                near = a[r] - block * j  # the window nearest to the anchor starts here
                far = near - block + 1
                whole = (near <= hi[r]) & (far >= lo[r])
                name = mix(core[r].view(np.uint64) * U(0x9E3779B97F4A7C15) + j.astype(np.uint64))
                inner = mix(name ^ _substring_hashes(b, near, far + width))
                outer = np.zeros(len(r), dtype=np.uint64)
                outer[whole] = _substring_hashes(b, far[whole], near[whole] + width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * len(r), pa.binary()), pa.array(inner.view(np.int64)), pa.array(outer.view(np.int64), mask=~whole), pa.array(a[r]), pa.array(np.maximum(far, lo[r])), pa.array(np.minimum(near, hi[r]))],
                    names=["key", "core", "hull", "a", "lo", "hi"],
                )

    return run


def _settle(rows: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Repeated byte spans among ``rows``, and the rows whose windows are still open.

    Rows with equal (core, hull) are repeated as a whole. Where a core has several
    hulls, one row of each goes on. A row without hull stands for itself.
    """
    bits = filter_bits(rows.count())
    rows = test_filter(rows, "core", build_filter(rows, "core", bits, repeated=True), bits).where("maybe").drop("maybe")
    own = F.xxhash64("key", "lo", F.lit(7))
    rows = materialize(rows.withColumn("whole", F.col("hull").isNotNull()).withColumn("hull", F.coalesce("hull", own)), "named")
    names = materialize(rows.groupBy("core", "hull", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "a", "lo", "hi")).alias("row")), "names")
    twice = materialize(names.where("n > 1 and whole").select("core", "hull"), "twice")
    spans = rows.where("whole").join(twice, ["core", "hull"], "left_semi").select("key", "lo", (F.col("hi") + width).alias("end"))
    several = materialize(names.groupBy("core").agg(F.count(F.lit(1)).alias("hulls")).where("hulls > 1").select("core"), "several")
    left = names.join(several, "core", "left_semi").select("core", "row.key", "row.a", "row.lo", "row.hi")
    return spans, left


def _descend(docs: DataFrame, left: DataFrame, width: int, block: int) -> DataFrame:
    per_text = materialize(left.groupBy("key").agg(F.collect_list(F.struct("core", "a", "lo", "hi")).alias("rows")), "open")
    bits = filter_bits(per_text.count())
    texts = test_filter(docs, "key", build_filter(per_text, "key", bits), bits).where("maybe").drop("maybe")
    with arrow_rows(docs.sparkSession, 500):
        return materialize(texts.join(per_text, "key").select("key", "text", "rows").mapInArrow(_open_blocks(width, block), ROWS), "blocks")


def _cut(batches):
    for batch in batches:
        ids, size, gone, runs, sha = batch.column("doc_id"), [], [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            b = text.as_py().encode()
            pairs = sorted((x["lo"], x["end"]) for x in spans.as_py() or ())
            merged: list[list[int]] = []
            for lo, end in pairs:
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([lo, end])
            h, at = hashlib.sha256(), 0
            for lo, end in merged:
                h.update(b[at:lo])
                at = end
            h.update(b[at:])
            size.append(len(b))
            gone.append(sum(e - s for s, e in merged))
            runs.append(len(merged))
            sha.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key of 128 bits of both."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.unhex(F.substring(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text).cast("binary"), 256), 1, 32))
    return docs.select(F.col("doc_id"), text.alias("text"), key.alias("key"))


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(key, lo, end): spans made of windows that start elsewhere too. They may overlap."""
    with arrow_rows(docs.sparkSession, 1000):
        rows = materialize(docs.where(F.octet_length("text") >= width).select("key", "text").mapInArrow(_name_chunks(width, gram), ROWS), "chunks")
    spans, left = _settle(rows, width)
    found = [spans]
    for size in (block, 1):
        spans, left = _settle(_descend(docs, left, width, size), width)
        found.append(spans)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = keyed(docs)
    per_text = materialize(repeated_spans(docs, width).distinct().groupBy("key").agg(F.collect_list(F.struct("lo", "end")).alias("spans")), "cuts")
    bits = filter_bits(per_text.count())
    split = test_filter(docs, "key", build_filter(per_text, "key", bits), bits)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    cut = split.where("maybe").join(per_text, "key", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans").mapInArrow(_cut, schema)
    zero = F.lit(0).cast("long")
    whole = split.where("not maybe").select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return cut.unionByName(whole)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))

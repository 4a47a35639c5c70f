"""Operator 11, token ids as flat binary files.

A store is a folder: for each partition a file of unsigned integers (16 bits where the
vocabulary fits, else 32) with the ids of its documents one after another, a file of
64-bit offsets (documents + 1 of them, counted from the file's first id), a file of
64-bit document ids, and one table ``manifest`` with a row for each partition. Files are
in ascending order of documents; where a file begins in the whole stream, its base, is a
prefix sum over the manifest, so no task waits for another to write.

Documents are dealt by ranges of (doc_id, digest of the text, row), so a repeated id is
spread too; a task encodes its documents where they land and writes as it goes. Files are
named by task attempt and the manifest names those of the attempts that ended well, so a
lost executor leaves at most files that nothing reads. Reading maps the files into memory
(a folder that this machine can't map is read in ranges) and never holds more than a
block of a document.

Encoding takes the library's ids of each distinct piece of text between places where the
byte-level pre-tokeniser always cuts; any other tokenizer gets whole texts.

Null and empty texts give the end id alone. Rows without an id come last. Rows with
equal ids stand by the digest of their text, repeated rows next to each other, each with
its own place. Texts of any length are encoded whole. Columns other than doc_id and text
are not read. An empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_path

#: Pieces whose ids a worker remembers before it starts afresh.
PIECES_KEPT = 1_000_000
#: Characters of text encoded at a time, and ids held at a time when reading.
TEXT_BLOCK, ID_BLOCK = 4_000_000, 1 << 20
MANIFEST = "part int, ids string, offsets string, docs string, width int, n_docs long, n_null long, n_ids long"
#: Text cut where a byte-level pre-tokeniser always cuts, with the blank before a word: runs of ASCII letters before another ASCII
#: character, lone marks and line feeds between such runs, and whatever stands up to the next blank with a letter or digit.
_PIECES = re.compile(r" ?[A-Za-z]++(?=[\x00-&(-@\[-`{-\x7f]|\Z)|[.,](?= \w)|[.,]?\n(?=[A-Za-z])|(?s: ?[^ ]*+(?: (?!\w)[^ ]*+)*+)").findall
_WORD = re.compile(r" ?[A-Za-z]+").fullmatch


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if "://" not in path else pafs.FileSystem.from_uri(path)


class Encoder:
    """Texts to the bytes of their ids, as the library gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        before = spec.get("pre_tokenizer") or {}
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\A[A-Za-z]|[ .,\n]", t["content"]) for t in spec["added_tokens"])
        self.in_pieces = plain and not spec.get("normalizer") and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        self.model, self.known = self.tokenizer.model, {"": b""}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        """ASCII words are one unit to the pre-tokeniser, so they go to the library's model at once; the rest goes through all of it."""
        words = [p for p in pieces if _WORD(p)]
        for w in words:  # the byte-level alphabet writes a blank as G with a dot
            self.known[w] = np.array([t.id for t in self.model.tokenize(w.replace(" ", "\u0120"))], dtype=self.kind).tobytes()
        rest = list(pieces.difference(words))
        for i in range(0, len(rest), 50_000):
            self.known.update(zip(rest[i : i + 50_000], self._ids(rest[i : i + 50_000]), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.in_pieces:
            return self._ids(texts)
        pieces = [_PIECES(t) for t in texts]
        new = set().union(*pieces).difference(self.known)
        if len(self.known) + len(new) > PIECES_KEPT:
            self.known = {"": b""}
            new = set().union(*pieces).difference(self.known)
        self._learn(new)
        return [b"".join(map(self.known.__getitem__, own)) for own in pieces]


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process, which keeps its pieces from task to task."""
    return Encoder(path)


def _blocks(texts: list[str]):
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= TEXT_BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _writer(tokenizer: str, root: str, end_id: int):
    def run(batches):
        context, encode, names, out = TaskContext.get(), encoder(tokenizer), [], None
        fs, folder = _place(root)
        end, docs, nulls, at = np.array([end_id], dtype=encode.kind).tobytes(), 0, 0, 0
        for batch in batches:
            if out is None:
                names = [f"{context.partitionId():07d}-{context.taskAttemptId()}.{x}" for x in ("ids", "offsets", "docs")]
                out = [fs.open_output_stream(f"{folder}/{n}") for n in names]
                out[1].write(np.zeros(1, dtype="<u8").tobytes())
            ids = batch.column("doc_id")
            docs, nulls = docs + batch.num_rows, nulls + ids.null_count
            out[2].write(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            for texts in _blocks(batch.column("text").to_pylist()):
                done = [x + end for x in encode(texts)]
                ends = at + np.cumsum([len(x) // encode.kind.itemsize for x in done], dtype="<u8")
                out[0].write(b"".join(done))
                out[1].write(ends.astype("<u8").tobytes())
                at = int(ends[-1])
        if out is not None:
            for f in out:
                f.close()
            row = [context.partitionId(), *(f"{root}/{n}" for n in names), encode.kind.itemsize, docs, nulls, at]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    return run


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, parts: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) into a store at ``path``, a folder that executors share."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, folder = _place(f"{path}/files")
    fs.create_dir(folder, recursive=True)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = ["no_id", "doc_id", "hash", "row"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(_writer(tokenizer, f"{path}/files", end_id), MANIFEST).write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row for each partition's files, with ``base``: ids in all files before it. One row a file meets here."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("base", F.coalesce(before, F.lit(0).cast("long")))


class Flat:
    """A flat file of integers: mapped into memory where this machine can, else read in ranges."""

    def __init__(self, path: str, kind):
        self.kind, (fs, place) = np.dtype(kind), _place(path)
        self.local = isinstance(fs, pafs.LocalFileSystem)
        self.file = pa.memory_map(place) if self.local else fs.open_input_file(place)
        self.size = self.file.size() // self.kind.itemsize

    def __getitem__(self, cut: slice) -> np.ndarray:
        start, stop, _ = cut.indices(self.size)
        self.file.seek(start * self.kind.itemsize)
        return np.frombuffer(self.file.read_buffer(max(0, stop - start) * self.kind.itemsize), dtype=self.kind)

    def blocks(self, start: int, stop: int, most: int = ID_BLOCK):
        for i in range(start, stop, most):
            yield self[i : min(stop, i + most)]


def _documents(batches, each, schema):
    """Of every file of the manifest rows, (doc ids, starts, lengths, each(file, start, stop) of every document), some thousand at a time."""
    for batch in batches:
        for own in batch.to_pylist():
            ids, offsets, docs = Flat(own["ids"], f"<u{own['width']}"), Flat(own["offsets"], "<u8"), Flat(own["docs"], "<i8")
            for i in range(0, own["n_docs"], 10_000):
                name = docs[i : min(own["n_docs"], i + 10_000)]
                edge = offsets[i : i + len(name) + 1].astype(np.int64)
                nameless = np.arange(i, i + len(name)) >= own["n_docs"] - own["n_null"]
                out = [each(ids, a, b) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64(), mask=nameless), pa.array(edge[:-1] + own["base"], pa.int64()), pa.array(np.diff(edge), pa.int64()), pa.array(out, schema)], names=["doc_id", "start", "n_tokens", "value"])


def _crc(ids: Flat, start: int, stop: int) -> int:
    crc = 0
    for block in ids.blocks(start, stop):
        crc = zlib.crc32(block.astype("<u4").tobytes(), crc)
    return crc


def _spread(rows: DataFrame) -> DataFrame:
    """The files of a store in tasks of their own."""
    rows = materialize(rows, "manifest")
    return rows.repartition(max(1, min(rows.count(), 100_000)))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per document in the store's order of ids: doc_id, start, n_tokens, ids (as an array)."""
    rows = _spread(manifest(spark, path)).mapInArrow(lambda batches: _documents(batches, lambda ids, a, b: ids[a:b].astype(np.int64), pa.list_(pa.int64())), "doc_id long, start long, n_tokens long, value array<long>")
    return rows.withColumnRenamed("value", "ids")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 of its ids as little-endian unsigned 32-bit integers."""
    rows = _spread(manifest(spark, path)).mapInArrow(lambda batches: _documents(batches, _crc, pa.int64()), "doc_id long, start long, n_tokens long, value long")
    return rows.withColumnRenamed("value", "ids_crc32")


def windows(spark: SparkSession, path: str, length: int) -> DataFrame:
    """The whole stream of ids in training windows of ``length`` (the last may be shorter): window, ids.

    A window that spans files is put together from its parts, of which each file holds one.
    """

    def run(batches):
        for batch in batches:
            for own in batch.to_pylist():
                ids, first = Flat(own["ids"], f"<u{own['width']}"), own["base"] // length
                for w in range(first, -(-(own["base"] + own["n_ids"]) // length)):
                    a = max(0, w * length - own["base"])
                    part = ids[a : min(own["n_ids"], (w + 1) * length - own["base"])]
                    yield pa.RecordBatch.from_arrays([pa.array([w], pa.int64()), pa.array([own["base"] + a], pa.int64()), pa.array([part.astype(np.int64)], pa.list_(pa.int64()))], names=["window", "start", "ids"])

    rows = _spread(manifest(spark, path)).mapInArrow(run, "window long, start long, ids array<long>")
    whole = F.array_sort(F.collect_list(F.struct("start", "ids")))
    return rows.groupBy("window").agg(F.flatten(F.transform(whole, lambda x: x["ids"])).alias("ids"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return checksums(spark, path)

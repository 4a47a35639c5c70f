"""Operator 9, token counts through a digest cache.

The cache is a table (content digest, tokenizer digest, n_tokens). A text's
digest is the SHA-256 of its bytes with runs of blanks made one space, which
these tokenizers' pre-tokenisers treat alike. Texts join the cache; one row of
each digest that is missing is encoded, and its count is appended.

Encoding works on the words between blanks where the tokenizer's own file says
that no token spans a blank: a text's count is then the sum over its words, and a
bounded dictionary in each task keeps the words' counts as the library gave them.
Texts go whole to the library under any other tokenizer.

Null texts count as empty: 0 tokens. Special strings are recognised as the
library does by default. Texts of any length are counted whole; equal texts share
one row of the cache, whatever their ids, and repeated rows each get their row.
Columns other than doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, build_filter, filter_bits, join_spread, materialize, scratch_root, test_filter

TOKEN_LIMIT = 2048
#: Words whose counts a task remembers before it starts afresh.
WORDS_KEPT = 1_000_000
CACHE_SCHEMA = "digest binary, tokenizer binary, n_tokens long"


def tokenizer_digest(path: str) -> bytes:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").digest()


def splits_at_blanks(path: str) -> bool:
    """Whether the file's pre-tokeniser drops blanks before anything else, so that words are encoded one by one."""
    with open(path) as f:
        spec = json.load(f)
    chain = lambda part, inner: [] if part is None else [x for p in part[inner] for x in chain(p, inner)] if part["type"] == "Sequence" else [part]
    first = next(iter(chain(spec.get("pre_tokenizer"), "pretokenizers")), {"type": ""})
    pattern = first.get("pattern", {}).get("Regex", " ")
    words_only = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and not re.search(r"[ .]|\\[WDSPb]|(?<!\^)\\s|\(\?", pattern)
    lone = all(p["type"] in ("NFC", "Lowercase") or (p["type"] == "Replace" and p["pattern"] == {"Regex": "\\s+"} and p["content"] == " ") for p in chain(spec.get("normalizer"), "normalizers"))
    return lone and (words_only or first["type"] == "WhitespaceSplit") and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") for t in spec["added_tokens"])


def word_counter(path: str, words_kept: int = WORDS_KEPT):
    """A function from a text to its number of tokens."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if not splits_at_blanks(path):
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False))
    known: dict[bytes, int] = {}

    def count(text: str) -> int:
        words = text.encode().split()
        new = [w for w in set(words) if w not in known]
        if len(known) + len(new) > words_kept:
            known.clear()
            new = list(set(words))
        for i in range(0, len(new), 10_000):
            some = new[i : i + 10_000]
            known.update(zip(some, (len(e) for e in tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)), strict=True))
        return sum(map(known.__getitem__, words))

    return count


def encode(rows: DataFrame, path: str) -> DataFrame:
    """(digest, text) to (digest, n_tokens)."""

    def run(batches):
        count = word_counter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([count(t.as_py()) for t in b.column("text")], pa.int64())], names=["digest", "n_tokens"])

    return rows.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, path: str, cache: str) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens. ``cache``: a table's path, made where there is none."""
    spark = docs.sparkSession
    version = tokenizer_digest(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.regexp_replace(text, SPACES, " ") if splits_at_blanks(path) else text
    docs = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(own.cast("binary"), 256)).alias("digest"))
    keys = materialize(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "token-key")
    total = keys.count()
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    # Of what is stored, this run's digests alone go further; a filter leaves most others out before the shuffle.
    bits = filter_bits(total)
    mine = test_filter(spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == F.lit(version)), "digest", build_filter(keys, "digest", bits), bits).where("maybe")
    stored = materialize(mine.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "stored")
    # Texts that the filter finds neither stored nor repeated are encoded where they are read.
    taken = build_filter(keys.select("digest").unionByName(stored.select("digest")), "digest", bits, repeated=True)
    split = test_filter(docs.select("digest", "text"), "digest", taken, bits)
    again = split.where("maybe").join(stored, "digest", "left_anti").dropDuplicates(["digest"])
    missing = materialize(encode(split.where("not maybe").drop("maybe").unionByName(again.drop("maybe")), path), "missing")
    missing.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = stored.unionByName(missing)
    sizes = materialize(keys.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).join(counts, "digest"), "counts")
    return join_spread(keys, sizes, "digest", "copies", total).select("doc_id", "n_bytes", "n_tokens")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), f"{scratch_root(spark)}/token-cache")
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)

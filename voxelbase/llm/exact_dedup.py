"""Operator 7, exact deduplication by two Bloom passes.

Pass one reads every text once, keeps (id, digest) and marks the places of a Bloom
filter that two rows or more hit; rows don't shuffle for it, tasks send compressed
places. Pass two tests every digest: rows that the filter does not hold are unique
and pass straight through, only the others shuffle and are grouped on the full
SHA-256. Beyond one filter's capacity the digests fall into residue classes, each
with a filter of its own, so the method holds at any number of rows. Of the rows
that shuffle, a digest with a large share of them joins by broadcast.

Null texts count as empty. Rows without an id can't be kept before rows with
one; equal rows with the same id all say ``kept``. Texts of any length are read
whole. Ties: of equal texts the smallest id stays. Columns other than doc_id and
text are not read by ``exact_groups``; ``drop_copies`` returns them whatever
their names and types. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_FILTER_BITS, SPACES, build_filter, carried, filter_bits, join_spread, materialize, scratch_path, test_filter


def _sha(text: str) -> Column:
    norm = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), _sha(text).alias("sha"))


def mark_repeated(keys: DataFrame, key: str, rows: int, bits_per_row: int = 16, most: int = MAX_FILTER_BITS) -> DataFrame:
    """``keys`` with ``maybe``: whether the two-pass filter can't rule out that ``key`` occurs again.

    Where the rows need more bits than one filter may have, the keys fall into residue
    classes, each with a filter of its own that is broadcast alone, one after another.
    """
    classes = max(1, -(-rows * bits_per_row // most))
    if classes == 1:
        bits = filter_bits(rows, bits_per_row, most)
        return test_filter(keys, key, build_filter(keys, key, bits, repeated=True), bits)
    path = scratch_path(keys.sparkSession, "marked")
    filed = scratch_path(keys.sparkSession, "classes")
    keys.withColumn("__class", F.pmod(F.xxhash64(key, F.lit(2)), F.lit(classes))).write.partitionBy("__class").parquet(filed)
    for c in range(classes):
        own = keys.sparkSession.read.schema(keys.schema).parquet(f"{filed}/__class={c}")
        bits = filter_bits(own.count(), bits_per_row, most)
        test_filter(own, key, build_filter(own, key, bits, repeated=True), bits).write.mode("append").parquet(path)
    return keys.sparkSession.read.schema(keys.schema.add("maybe", "boolean")).parquet(path)


def exact_groups(docs: DataFrame, bits_per_row: int = 16, most: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = materialize(digests(docs), "digest")
    split = mark_repeated(keys, "sha", keys.count(), bits_per_row, most)
    again = materialize(split.where("maybe").drop("maybe"), "again")
    groups = materialize(again.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "group")
    once = split.where("not maybe").select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    rows = once.unionByName(join_spread(again, groups, "sha", "group_size", again.count()).select("doc_id", "sha", "keep_id", "group_size"))
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each text: the smallest id, null ids last, of equal ids the smallest text as it stands, then the first row."""
    return carried(docs, ("doc_id", "text"), _drop_copies)


def _drop_copies(docs: DataFrame) -> DataFrame:
    keyed = docs.withColumns({"__sha": _sha("text"), "__row": F.monotonically_increasing_id()})
    keys = materialize(keyed.select("__sha"), "digest")
    bits = filter_bits(keys.count())
    split = test_filter(keyed, "__sha", build_filter(keys, "__sha", bits, repeated=True), bits, "__maybe")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text", "__row")  # further columns may be of types without an order
    first = split.where("__maybe").groupBy("__sha").agg(F.min_by(F.struct(*docs.columns), order).alias("__first")).select(*(F.col("__first")[c].alias(c) for c in docs.columns))
    return split.where("not __maybe").select(*docs.columns).unionByName(first)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
FROM n
"""

"""Operator 6, a content-addressed WARC archive.

An archive is a folder with two tables: ``payloads`` holds the bytes of each
distinct payload once under its SHA-256, ``headers`` holds for each record the
exact header block and the digest it refers to. Reading checks every stored
payload against its digest; ``reconstruct`` joins the two into the original
record bytes.

Of records with equal payloads of at least ``least`` bytes the one with the
smallest page_id is the response and the others are revisits of it; shorter
payloads are always responses. Null html is an empty payload, a null url an
empty target. Rows without page_id are never chosen before rows with one;
equal page_ids with equal payloads share one type (the tie leaves both as the
response), and repeated rows are records of their own. Payloads of any length are
stored whole. Columns other than page_id, url and html are not read. An empty
table gives an archive without records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import build_filter, filter_bits, join_spread, materialize, scratch_path, test_filter

LEAST_REVISIT_BYTES = 100
CRLF = "\r\n"


def _sha(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def _header(kind: Column, page: Column, url: Column, date: str, digest: Column, stored: Column, refers: Column) -> Column:
    """The header block of a WARC/1.1 record, as text with its closing blank line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    urn = lambda x: F.concat(F.lit("<urn:page:"), x.cast("string"), F.lit(">"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", urn(page)),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex(digest)))),
        F.when(refers.isNotNull(), F.concat(line("WARC-Refers-To", urn(refers)), line("WARC-Profile", F.lit(profile)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", stored.cast("string")),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, date: str = "2025-01-01T00:00:00Z", least: int = LEAST_REVISIT_BYTES) -> None:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", _sha(F.col("payload")))
    keys = materialize(pages.select("page_id", "url", "digest", F.octet_length("payload").alias("n")), "page")
    bits = filter_bits(keys.count())
    seen = build_filter(keys, "digest", bits, repeated=True)

    # Each payload once: digests that can't occur again go straight to the store.
    split = test_filter(pages.select("digest", "payload"), "digest", seen, bits)
    once = split.where("not maybe").unionByName(split.where("maybe").dropDuplicates(["digest"]))
    once.select("digest", "payload").write.mode("append").parquet(f"{path}/payloads")

    keys = test_filter(keys, "digest", seen, bits)
    again = materialize(keys.where("maybe"), "again")
    first = materialize(again.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id")), "first")
    rows = keys.where("not maybe").withColumn("first_id", F.lit(None).cast("long")).unionByName(again.join(first, "digest", "left").select(*again.columns, "first_id"))
    refers = F.when(F.col("first_id") != F.coalesce(F.col("page_id"), F.lit(-1)), F.col("first_id"))
    kind = F.when(refers.isNotNull(), "revisit").otherwise("response")
    stored = F.when(refers.isNotNull(), F.lit(0)).otherwise(F.col("n"))
    header = _header(kind, F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("url"), date, F.col("digest"), stored, refers)
    rows.select("page_id", "digest", header.cast("binary").alias("header")).write.mode("append").parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload, payload_bytes, and ``sound``: whether the bytes still have that digest."""
    stored = spark.read.schema("digest binary, payload binary").parquet(f"{path}/payloads")
    return stored.select("digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), (_sha(F.col("payload")) == F.col("digest")).alias("sound"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The records' header blocks and the fields read from their text."""
    rows = spark.read.schema("page_id long, digest binary, header binary").parquet(f"{path}/headers")
    text = F.col("header").cast("string")
    field = lambda name, value: F.nullif(F.regexp_extract(text, rf"\r\n{name}: {value}\r\n", 1), F.lit(""))
    return rows.select(
        "page_id",
        "digest",
        "header",
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        field("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("payload_digest"),
        field("Content-Length", "([0-9]+)").cast("long").alias("stored_bytes"),
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, its payload found by digest. A damaged payload stops the read."""
    fault = F.raise_error(F.concat(F.lit("stored payload does not match digest "), F.hex("digest")))
    payloads = read_payloads(spark, path)
    payloads = payloads.select("digest", "payload", F.when(F.col("sound"), F.col("payload_bytes")).otherwise(fault.cast("long")).alias("payload_bytes"))
    # A payload that many records share goes to them by broadcast, its bytes never to one task with all its records.
    headers = materialize(read_headers(spark, path), "headers")
    uses = materialize(headers.groupBy("digest").agg(F.count(F.lit(1)).alias("uses")), "uses")
    return join_spread(headers, payloads.join(uses, "digest"), "digest", "uses", headers.count()).drop("uses")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id and the record's exact bytes: header block, stored payload, two line ends."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    rows = records(spark, path)
    return rows.select("page_id", F.concat(F.col("header"), body, F.lit(b"\r\n\r\n")).alias("record"), *(c for c in rows.columns if c not in ("page_id", "payload")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    # The rebuilt record itself is checked: its own length and its header's must agree.
    rows = reconstruct(spark, path)
    whole = F.octet_length("record") == F.octet_length("header") + F.col("stored_bytes") + 4
    fault = F.raise_error(F.concat(F.lit("record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(" has the wrong length")))
    return rows.select("page_id", F.when(whole, F.col("payload_bytes")).otherwise(fault.cast("long")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS s FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS f FROM d)
SELECT page_id, n AS payload_bytes, s AS payload_digest,
       CASE WHEN n >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND f <> page_id THEN f END AS refers_to
FROM m
"""

"""Operator 10, language identification by Bayesian evidence fusion.

Four sources of evidence meet in one posterior over the languages of the
labelled documents:

* the text: likelihoods of letter trigrams, tempered because they overlap;
* the markup: what the page's ``lang`` attribute declares, with a reliability
  estimated by how often declarations and texts agree over all pages;
* the address: the host's suffix, part of the prior's hierarchy;
* the host: expected languages of the host's other pages, smoothed towards its
  suffix, which is smoothed towards all pages. A page never counts in its own
  prior.

Trigram counts come from at most ``SAMPLE`` labelled documents (those with the
smallest hashes; whole texts), and every language of that sample can be named; all
other statistics are grouped aggregates over all pages. Tasks see the table of
trigrams (128 KB a language); pages shuffle as a few numbers, never with their html.

Null html is empty and leaves the prior; a null or odd url is the host "".
Pages of any length are read whole, in time proportional to their length however
their tags are broken. Repeated rows are pages of their own. Of equal posteriors
the language first by name wins. Columns other than page_id, url and html are not
read. Without labelled documents ``lang`` is null. An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_spread, materialize, only_ids

SAMPLE, TRIGRAM_BITS = 20_000, 15
#: Share of a trigram that counts as independent evidence, and the most that a text weighs (nats).
TEMPER, MOST_EVIDENCE = 1 / 3, 40.0
#: Pages' worth of the level above in a suffix's and a host's prior; pseudo-counts of declarations.
SMOOTH_SUFFIX, SMOOTH_HOST, SMOOTH_DECLARED = 50.0, 10.0, 2.0

SIGN = re.compile(r"<(script|style)\b|<!--|<|&#?\w+;", re.I)
CLOSERS = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I), "<!--": re.compile("-->"), "<": re.compile(">")}
#: The first html tag, and what it declares.
HTML_TAG = r"(?is)<html\b[^>]*"
DECLARED = r"""(?is)\slang\s*=\s*["']?([a-z]{2,3})\b"""
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

# Letters fold to lower case, other ASCII signs to a space; bytes above 127 stay.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint32)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the letter trigrams of a whole text; runs of signs count as one space."""
    b = FOLD[np.frombuffer(text.encode("utf-8", "ignore"), dtype=np.uint8)]
    if len(b):
        b = b[(b != 32) | np.concatenate([[True], b[:-1] != 32])]
    if len(b) < 3:
        return np.zeros(0, dtype=np.int64)
    h = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B)) + b[2:] * np.uint32(0xC2B2AE35)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - TRIGRAM_BITS)).astype(np.int64)


def visible(html: str | None) -> str:
    """The text outside tags, scripts, styles, comments and entities; a space stands for each.

    One pass: a closer that isn't found once is not looked for again.
    """
    html = html or ""
    out, at, kept, gone = [], 0, 0, set()
    while found := SIGN.search(html, at):
        start, end = found.span()
        sign = found[0].lower()
        if sign[0] == "<":
            end = -1
            for kind in (sign[1:] if sign[1:] in CLOSERS else sign, "<"):
                if kind not in gone:
                    if closer := CLOSERS[kind].search(html, start + 1):
                        end = closer.end()
                        break
                    gone.add(kind)
        if end < 0:  # no tag after all
            at = start + 1
            continue
        out.append(html[kept:start])
        at = kept = end
    out.append(html[kept:])
    return " ".join(out)


def _count(batches):
    size = 1 << TRIGRAM_BITS
    for batch in batches:
        langs, where = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
        table = np.zeros((len(langs), size), dtype=np.int64)
        for k, t in zip(where, batch.column("text").to_pylist(), strict=True):
            table[k] += np.bincount(trigrams(t or ""), minlength=size)
        k, g = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(langs[k].tolist(), pa.string()), pa.array(g, pa.int64()), pa.array(table[k, g])], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and log likelihoods (languages, 2^TRIGRAM_BITS)."""
    usable = docs.where("doc_id is not null and lang is not null and text is not null")
    ids = materialize(usable.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct(), "sample")
    chosen = only_ids(usable.select("doc_id", "lang", "text"), ids)
    counts = materialize(chosen.select("lang", "text").mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    rows = counts.toPandas()  # bounded by the sample: its trigrams at most, 2^TRIGRAM_BITS a language
    langs = sorted(rows.lang.unique())
    table = np.full((len(langs), 1 << TRIGRAM_BITS), 0.5, dtype=np.float32)
    table[np.searchsorted(langs, rows.lang.to_numpy(dtype=object)), rows.bucket.to_numpy(dtype=np.int64)] += rows.n.to_numpy(dtype=np.float32)
    return langs, np.log(table / table.sum(axis=1, keepdims=True, dtype=float)).astype(np.float32)


def _likelihoods(table: np.ndarray):
    def run(batches):
        for batch in batches:
            out = []
            for html in batch.column("html").to_pylist():
                counts = np.bincount(trigrams(visible(html)), minlength=table.shape[1])
                at = np.flatnonzero(counts)
                ll = table[:, at].astype(float) @ counts[at] * TEMPER
                out.append(np.maximum(ll - ll.max(), -MOST_EVIDENCE).tolist())
            keep = [n for n in batch.schema.names if n != "html"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(out, pa.list_(pa.float64()))], names=[*keep, "ll"])

    return run


def _normal(x):
    """exp of log weights, divided by their sum."""
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, w: a + w))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per page: page_id, lang, confidence, text_lang, declared_lang, host."""
    langs, table = fit(docs)
    none = F.lit(None).cast("string")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    tag = F.regexp_extract(F.coalesce("html", F.lit("")), HTML_TAG, 0)
    declared = F.nullif(F.lower(F.regexp_extract(tag, DECLARED, 1)), F.lit(""))
    if not langs:
        return pages.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"), declared.alias("declared_lang"), host.alias("host"))
    rows = pages.select("page_id", "html", host.alias("host"), declared.alias("declared"))
    schema = "page_id long, host string, declared string, ll array<double>"
    rows = rows.withColumn("page_id", F.col("page_id").cast("long")).mapInArrow(_likelihoods(table), schema)
    names, n = F.array(*map(F.lit, langs)), len(langs)
    # Numbers of one page: its text's posterior, and what it declares (0 where nothing, or no known language).
    rows = rows.withColumn("post", _normal(F.col("ll"))).withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("d", F.coalesce(F.array_position(names, F.col("declared")), F.lit(0)).cast("int"))
    rows = materialize(rows, "evidence")

    sums = lambda prefix: [F.sum(F.col("post")[i]).alias(f"{prefix}{i}") for i in range(n)]
    pack = lambda prefix: F.array(*(F.col(f"{prefix}{i}") for i in range(n)))
    # Over all pages: expected languages, in all and for each declaration. n + 1 rows.
    said = {r.d: np.array([r[f"c{i}"] for i in range(n)]) for r in rows.groupBy("d").agg(*sums("c")).collect()}
    every = sum(said.values()) + 1.0 if said else np.ones(n)
    world = (every / every.sum()).tolist()
    agree = np.array([said.get(d, np.zeros(n)) + SMOOTH_DECLARED * (0.5 / n + 0.5 * (np.arange(n) == d - 1)) for d in range(1, n + 1)])
    agree = np.log(agree / (every + SMOOTH_DECLARED))  # log P(declared d | language)
    says = F.array(F.array(*[F.lit(0.0)] * n), *(F.array(*map(F.lit, row.tolist())) for row in agree))

    by_host = materialize(rows.groupBy("host", "suffix").agg(F.count(F.lit(1)).alias("pages"), *sums("c")).select("host", "suffix", "pages", pack("c").alias("host_sum")), "hosts")
    by_suffix = by_host.groupBy("suffix").agg(F.sum("pages").alias("suffix_pages"), F.count(F.lit(1)).alias("suffix_hosts"), *(F.sum(F.col("host_sum")[i]).alias(f"c{i}") for i in range(n))).select("suffix", "suffix_pages", "suffix_hosts", pack("c").alias("suffix_sum"))
    by_suffix = materialize(by_suffix, "suffixes")
    by_host = materialize(join_spread(by_host, by_suffix, "suffix", "suffix_hosts", by_host.count()).drop("suffix", "suffix_hosts"), "priors")
    rows = join_spread(rows, by_host, "host", "pages", rows.count())
    # Leave the page itself out, then smooth downwards: world, suffix, host.
    own = lambda total, i: F.greatest(F.col(total)[i] - F.col("post")[i], F.lit(0.0))
    suffix = [(own("suffix_sum", i) + SMOOTH_SUFFIX * world[i]) / (F.col("suffix_pages") - 1 + SMOOTH_SUFFIX) for i in range(n)]
    prior = [(own("host_sum", i) + SMOOTH_HOST * suffix[i]) / (F.col("pages") - 1 + SMOOTH_HOST) for i in range(n)]
    fused = F.array(*(F.col("ll")[i] + F.log(prior[i]) + F.element_at(says, F.col("d") + 1)[i] for i in range(n)))
    rows = rows.select("page_id", "declared", "host", "ll", _normal(fused).alias("p"))
    best = lambda x: F.element_at(names, F.array_position(x, F.array_max(x)).cast("int"))
    return rows.select("page_id", best(F.col("p")).alias("lang"), F.array_max("p").alias("confidence"), best(F.col("ll")).alias("text_lang"), F.col("declared").alias("declared_lang"), "host")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))

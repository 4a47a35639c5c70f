"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib

import public_tokenizers
import pytest

import corpus_pipeline as C
from voxelbase.llm import decontaminate, exact_dedup, language_id, mixing, near_dedup, pii, suffix_dedup, token_counts, toxicity, warc
from voxelbase.llm.common import scratch_path

LONG = "lorem ipsum dolor sit amet " * 12_000
ROWS = [(1, None, "a"), (2, "", "a"), (None, "short text of six words here", None), (3, "short text of six words here", "b"), (3, "short text of six words here", "b"), (4, LONG, "b"), (5, LONG, "a"), (6, "you idiot, you moron " * 3, "a")]
#: Names that operators use inside: they must pass through or be left alone.
CLASH = ["sha", "digest", "maybe", "n", "key", "block", "bucket", "id", "rest", "kind", "canon", "score", "n_tokens", "lang", "item_id", "component"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(3)
    return df.selectExpr("*", *(f"'{c}' AS `{c}`" for c in CLASH))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(6, 1, 1), (6, 1, 0), (3, 1, 0), (4, 0, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(0, "short text of six words here"), (1, None), (2, "")], "item_id long, text string")


def operators(spark, labels, bench):
    path = public_tokenizers.path("word_bpe_49k.json")
    return {
        "pii": (lambda d: pii.replace_entities(d), 8),
        "toxicity": (lambda d: toxicity.scored(d, labels), 8),
        "suffix": (lambda d: suffix_dedup.remove_repeats(d), 8),
        "decontaminate": (lambda d: decontaminate.contaminated(d, bench), 3),
        "near": (lambda d: near_dedup.near_groups(d), 8),
        "exact": (lambda d: exact_dedup.exact_groups(d), 8),
        "mixing": (lambda d: mixing.mix(d), 8),
        "mixing_whole": (lambda d: mixing.with_copies(d), 8),
        "tokens": (lambda d: token_counts.count_tokens(d, path, scratch_path(spark, "cache")), 8),
        "drop_exact": (lambda d: exact_dedup.drop_copies(d), 4),
        "drop_near": (lambda d: near_dedup.drop_near_copies(d, 80), 5),
        "drop_leaks": (lambda d: decontaminate.drop_contaminated(d, bench), 5),
    }


@pytest.mark.parametrize("name", ["pii", "toxicity", "suffix", "decontaminate", "near", "exact", "mixing", "mixing_whole", "tokens", "drop_exact", "drop_near", "drop_leaks"])
def test_edges(spark, docs, labels, bench, name):
    run, n = operators(spark, labels, bench)[name]
    out = run(docs)
    rows = out.collect()
    assert len(rows) == n
    if name.startswith("drop") or name == "pii":
        assert out.columns[: len(docs.columns)] == docs.columns and all(r[c] == c for r in rows for c in CLASH)
    empty = run(docs.limit(0))
    assert empty.columns == out.columns and empty.count() == 0


def test_values_on_long_and_repeated_texts(spark, docs):
    cut = {(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert (4, len(LONG), len(LONG), hashlib.sha256(b"").hexdigest()) in cut and (3, 28, 0, hashlib.sha256(b"short text of six words here").hexdigest()) in cut
    groups = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs).collect()}
    assert groups == {(1, 1, 2), (2, 1, 2), (None, 3, 3), (3, 3, 3), (4, 4, 2), (5, 4, 2), (6, 6, 1)}
    near = {(r.doc_id, r.component_id) for r in near_dedup.near_groups(docs).collect()}
    assert (5, 4) in near and (4, 4) in near and (1, 1) in near and (2, 2) in near and (None, None) in near


def test_exact_groups_in_residue_classes(spark, docs):
    """A filter too small for the rows: classes with filters of their own give the same rows."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id % 2500) AS text")
    one = sorted(exact_dedup.exact_groups(docs).collect())
    assert sorted(exact_dedup.exact_groups(docs, most=32768).collect()) == one and sum(r.group_size == 2 for r in one) == 1000


def test_pages(spark):
    rows = [(1, None, None), (2, "http://x.org", ""), (None, "nonsense", "<p>x"), (3, "https://a.b.de/y", "<html lang=de>" + "wort " * 200_000), (3, "https://a.b.de/y", "<html lang=de>" + "wort " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS host", "1 AS d", "'q' AS digest", "'p' AS payload")
    docs = spark.createDataFrame([(1, "wort und satz der sprache", "de"), (2, "word and sentence of speech", "en"), (3, None, "fr"), (None, "x", "es")], "doc_id long, text string, lang string")
    for d in (docs, docs.limit(0)):
        out = language_id.identify(pages, d)
        assert out.count() == 5 and language_id.identify(pages.limit(0), d).count() == 0
    got = {r.page_id: r.lang for r in language_id.identify(pages, docs).collect()}
    assert got[3] == "de"
    for p, n in ((pages, 5), (pages.limit(0), 0)):
        path = scratch_path(spark, "warc")
        warc.write_archive(p, path)
        back = warc.reconstruct(spark, path).collect()
        assert len(back) == n and all(r.record.startswith(b"WARC/1.1\r\n") for r in back)


def test_stages(spark, docs, tmp_path):
    """Every stage and the whole pipeline on the odd rows and on an empty table."""
    labels = spark.createDataFrame([(6, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, "an item that no document holds at all, long enough to be searched in passages")], "item_id long, text string")
    for name, table in (("labels", labels), ("benchmark", bench), ("documents", docs)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in C.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert all(c in out.columns for c in docs.columns) and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        assert all(r["sha"] == "sha" and r["kind"] == "kind" for r in out.select("sha", "kind").collect())
    rows = C.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} >= {3, 4} and all(r.copies >= 1 for r in rows) and {r.text for r in rows} >= {LONG, ROWS[3][1]}

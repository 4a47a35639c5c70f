import hashlib
import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voxelbase.llm import common as C
from voxelbase.llm import exact_dedup as E
from voxelbase.llm import token_counts as T
from voxelbase.llm import warc as W

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def test_exact_groups_with_any_filter(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a  b", "a\tb", "a b", "", None, "x" * 5000, f"u{i}", " a b", "é e"])) for i in range(400)] + [(None, "a b"), (None, "alone"), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACES.sub(" ", t or ""), []).append(i)
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    for most in (C.MAX_FILTER_BITS, C.BLOCK_BITS):
        monkeypatch.setattr(E, "filter_bits", lambda rows, per_row=16, m=most: C.filter_bits(rows, per_row, m))
        assert sorted(map(tuple, E.exact_groups(df).collect()), key=repr) == sorted(want, key=repr)
    assert E.exact_groups(df.limit(0)).count() == 0
    kept = E.drop_copies(df.selectExpr("*", "1 as sha", "2 as maybe"))
    assert kept.columns == ["doc_id", "text", "sha", "maybe"]


def test_filter_never_loses_a_key(spark):
    rows = spark.range(20_000).selectExpr("id as k")
    bits = C.BLOCK_BITS  # far too few
    held = C.build_filter(rows.where("k % 2 = 0"), "k", bits)
    assert C.test_filter(rows.where("k % 2 = 0"), "k", held, bits).where("not maybe").count() == 0
    left = C.without_ids(rows.withColumnRenamed("k", "doc_id"), rows.selectExpr("k as doc_id").where("doc_id % 3 = 0"))
    assert left.count() == 20_000 - 6_667


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 200)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(120)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {i: find(i) for a, b in links if a != b for i in (a, b)}
    got = {r.id: r.component for r in C.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == want
    assert C.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_are_the_library_s(spark, tokenizer, tmp_path):
    odd = ["", None, " ", "a<|endoftext|>b <|startoftext|>", "ΣΑΣ Σ ΌΔΟΣ", "é ́x", "I'm we'll THEY'RE 's", "1234 ５６ ½", "\x1c\x85 tab\tnbsp x y", "日本語テキスト🙂👍🏽", "x" * 20_000, "<|end oftext|>", "Straße İstanbul ﬁ", "word " * 5000]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    df = docs.union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)] + [(None, "a b"), (1, "again")], "doc_id long, text string"))
    cache = str(tmp_path / "cache")
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = df.collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False))) for r in rows), key=repr)
    assert sorted(map(tuple, T.count_tokens(df, path, cache).collect()), key=repr) == want
    size = spark.read.parquet(cache).count()
    assert size == len({SPACES.sub(" ", r.text or "") for r in rows})
    assert sorted(map(tuple, T.count_tokens(df, path, cache).collect()), key=repr) == want
    assert spark.read.parquet(cache).count() == size  # nothing is encoded twice
    assert T.count_tokens(df.limit(0), path, cache).count() == 0


def test_small_memory_of_words(tokenizer):
    count = T.word_counter(public_tokenizers.path("word_bpe_49k.json"), words_kept=3)
    for t in ("a b c d e f", "a b", "g h i j a"):
        assert count(t) == len(tokenizer.encode(t, add_special_tokens=False))


def test_archive_round_trip(spark, tmp_path):
    page = "<html>" + "é" * 80 + "</html>"
    rows = [(3, "http://a/", page), (1, "http://b/\r\nX: y", page), (2, None, page), (4, "u", "short"), (5, "v", "short"), (6, "w", None), (7, "x", ""), (8, "y", "z" * 200_000), (None, "n", page), (9, "r\n\r\nq", "a\r\n\r\nb" * 40)]
    W.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest"), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/payloads").count() == 5
    got = {r.page_id: r for r in W.records(spark, str(tmp_path)).collect()}
    for i, _, html in rows:
        b = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest, bytes(got[i].payload)) == (len(b), hashlib.sha256(b).hexdigest(), b)
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if r.refers_to} == {2: ("revisit", 1), 3: ("revisit", 1), None: ("revisit", 1)}
    for r in W.reconstruct(spark, str(tmp_path)).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and rest[n:] == b"\r\n\r\n" and len(rest) == n + 4
        assert rest[:n] == (bytes(got[r.page_id].payload) if got[r.page_id].record_type == "response" else b"")


def test_damaged_payload_stops_the_read(spark, tmp_path):
    W.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), str(tmp_path))
    spark.createDataFrame([(hashlib.sha256(b"other").digest(), b"wrong")], "digest binary, payload binary").write.mode("append").parquet(f"{tmp_path}/payloads")
    W.write_archive(spark.createDataFrame([(2, "u", "other")], "page_id long, url string, html string"), str(tmp_path))
    with pytest.raises(Exception, match="does not match"):
        W.records(spark, str(tmp_path)).select("payload_bytes").collect()

"""The token store against encoding whole texts: every id, place and checksum, odd rows, other tokenizers."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voxelbase.llm import token_files as T
from voxelbase.llm.common import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(texts, path=PATH):
    return [[*e.ids, 0] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def expected(rows, path=PATH):
    """(doc_id, start, n_tokens, crc) of rows in order of ids."""
    out, at = [], 0
    for (doc, _), ids in zip(rows, whole([t or "" for _, t in rows], path), strict=True):
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_whole_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = T.op11_token_files(spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in got.collect()) == expected(rows)


ODD = [
    "", None, " ", "  two  blanks ", "a\n b\n\nc \n d", "tab\tand nbsp 　wide", "x²3 4²", "café. naïve,\nno.1", "it's 'S'll. We'LL,",
    "<|endoftext|>", "a <|endoftext|> b.<|endoftext|>\n c", "\x1c fs \x85 nel", "你好,世界. \U0001f600 smile", "mark é. x", "a.b,c\nd" * 50, "." * 500, " " * 500, "\n" * 100 + "a", "long " * 100_000, "_x _y __", "1,2.3\n4",
]


def test_pieces_give_the_ids_of_whole_texts():
    texts = [t or "" for t in ODD]
    encode = T.Encoder(PATH)
    assert encode.in_pieces and encode.kind == np.dtype("<u2")
    assert [np.frombuffer(x, "<u2").tolist() + [0] for x in encode(texts)] == whole(texts)


def test_pieces_of_random_text():
    import random

    r, encode = random.Random(3), T.Encoder(PATH)
    marks = " .,\n\t' ²́中\x1c_-9aZéß  "
    texts = ["".join(r.choice(marks) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u2").tolist() + [0] for x in encode(texts)] == whole(texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_store_of_odd_rows(spark, name, monkeypatch):
    monkeypatch.setattr(T, "ID_BLOCK", 64)
    path, store = public_tokenizers.path(name), scratch_path(spark, "store")
    rows = [(i * 3 - 7, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(str(i), *r, "x") for i, r in enumerate(rows)], "start string, doc_id long, text string, ids string").repartition(4)
    T.write_store(df, path, store, parts=5)
    assert sorted(tuple(r) for r in T.checksums(spark, store).collect()) == expected(rows, path)
    stream = [x for ids in whole([t or "" for _, t in rows], path) for x in ids]
    read = sorted(T.read_store(spark, store).collect(), key=lambda r: r.start)
    assert [x for r in read for x in r.ids] == stream and [r.doc_id for r in read] == [d for d, _ in rows]
    cut = sorted(T.windows(spark, store, 1000).collect(), key=lambda r: r.window)
    assert [x for r in cut for x in r.ids] == stream and {len(r.ids) for r in cut[:-1]} == {1000}
    files = T.manifest(spark, store).collect()
    assert len(files) > 1 and sum(f.n_docs for f in files) == len(rows)
    flat = np.concatenate([np.memmap(f.ids.removeprefix("file:"), dtype=f"<u{f.width}") for f in sorted(files, key=lambda f: f.part)])
    assert flat.tolist() == stream


def test_shared_and_null_ids_repeated_rows_empty_table(spark):
    store = scratch_path(spark, "store")
    rows = [(5, "five"), (5, "five"), (5, "other"), (None, "none"), (None, None), (1, "one")] + [(7, "hot")] * 2000
    T.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), PATH, store, parts=4)
    got = sorted((tuple(r) for r in T.checksums(spark, store).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [1, 5, 5, 5] + [7] * 2000 + [None, None]
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got[:-1]]).tolist()
    crc = {r[3] for r in expected([(0, t) for t in ("five", "other", "none", None, "one", "hot")])}
    assert {r[3] for r in got} == crc
    assert max(f.n_docs for f in T.manifest(spark, store).collect()) < 1500  # one id's rows are spread
    empty = scratch_path(spark, "store")
    T.write_store(spark.createDataFrame([], "doc_id long, text string"), PATH, empty)
    assert T.checksums(spark, empty).collect() == [] and T.read_store(spark, empty).collect() == []

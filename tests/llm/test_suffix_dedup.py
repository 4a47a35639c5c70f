import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from voxelbase.llm import suffix_dedup as S

DATA = "/root/testdata/sf0.001/documents.parquet"


def brute(rows, width):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + width] for _, b in texts for s in range(len(b) - width + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for s in range(len(b) - width + 1):
            if seen[b[s : s + width]] > 1:
                gone[s : s + width] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = int(np.sum(gone[:-1] & ~np.concatenate([[False], gone[:-2]]))) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df, width=S.WIDTH):
    return sorted(map(tuple, S.remove_repeats(df, width).collect()), key=repr)


def test_whole_tables_match_brute_force(spark):
    docs = spark.read.parquet(DATA)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], S.WIDTH)
    assert sum(r[2] for r in want) > 0
    assert got(docs) == want


def test_edges_and_pieces(spark, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdé", k=5)) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    shared = text(120)
    rows = [(1, shared), (2, shared), (3, text(30) + shared + text(50)), (4, None), (5, ""), (6, "x" * 1500), (7, "ab" * 600), (8, text(10) + shared[100:560] + text(9)), (9, shared[:399]), (10, "x" * 401), (None, text(90)), (10, "x" * 401), (11, text(3000) + shared[3:470] + text(2000))]
    rows += [(12 + i, shared[: 200 + 17 * i] + text(40)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(S, "PIECE", 1 << 14)
    assert got(df) == brute(rows, S.WIDTH)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []


@pytest.mark.parametrize("width", [64, 100])
def test_other_widths(spark, width):
    rng = random.Random(width)
    base = "".join(rng.choices("abcdefgh ", k=4000))
    rows = [(i, base[(s := rng.randrange(3800)) : s + rng.randrange(300)] + "".join(rng.choices("xyz", k=rng.randrange(90)))) for i in range(60)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), width) == brute(rows, width)

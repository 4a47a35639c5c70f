import math
import random

import numpy as np

import corpus_pipeline as C
from tests.llm.test_near_dedup import brute, shingles
from voxelbase.llm import near_dedup as N


def test_stage_drops_copies_between_80_and_85(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(4000)]
    rows, planted = [], 0
    for i in range(400):
        w = rng.choices(vocab, k=204)  # 200 shingles
        rows.append((2 * i, " ".join(w)))
        for at in range(20, 20 + 40 * (3 + i % 3), 40):  # each change ends five shingles, at both sides of 0.80
            w[at] = f"x{i}"
        w[204 - i % 4 :] = rng.choices(vocab, k=i % 4)
        rows.append((2 * i + 1, " ".join(w)))
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        planted += 0.80 <= len(a & b) / len(a | b) < 0.85
    assert planted > 100
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i for i, _, _, kept in brute(rows, 80) if kept}
    assert {r.doc_id for r in C.without_near_copies(spark, docs, "").collect()} == want
    assert len(want) < len({i for i, _, _, kept in brute(rows, 85) if kept})


def test_stage_on_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {i for i, _, _, kept in brute([(r.doc_id, r.text) for r in docs.collect()], 80) if kept}
    assert {r.doc_id for r in C.without_near_copies(spark, docs, "").collect()} == want


def test_plan_keeps_the_loss():
    assert N.plan(85)[:2] == (32, 6)
    rng = np.random.default_rng(3)
    for percent in (100, 85, 80, 50, 10, 1):
        bands, depth, limit = N.plan(percent)
        s = min(percent, 99) / 100
        assert bands * math.log1p(-(s**depth)) <= math.log(N.LOSS)
        flips = 2 * rng.binomial(bands * depth, 1 - s, 4000)
        count = [int((np.bincount(rng.integers(0, N.SKETCH_BITS, f), minlength=N.SKETCH_BITS) & 1).sum()) for f in flips]
        assert max(count) <= limit <= np.mean(count) + 9 * np.std(count) + 2

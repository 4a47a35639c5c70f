import re

import corpus_pipeline as C
from tests.llm.test_near_dedup import brute as near
from voxelbase.llm import decontaminate as D
from voxelbase.llm import toxicity as T

SF = "/root/testdata/sf0.001"


def test_each_stage_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    gram, w = T.fit(docs, labels)
    frame, left = docs, dict(rows)
    for name, stage in C.STAGES:
        if name == "toxicity":
            left = {i: r for i, r in left.items() if w[0] + sum(a * b for a, b in zip(w[1:], gram.features(r.text), strict=True)) < 0}
        elif name == "exact_dedup":
            seen = {}
            for i in sorted(left):
                seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i].text or ""), i)
            left = {i: left[i] for i in seen.values()}
        elif name == "near_dedup":
            left = {i: left[i] for i, _, _, kept in near([(i, r.text) for i, r in left.items()], C.NEAR_PERCENT) if kept}
        elif name == "decontaminate":
            index = D.Passages([p for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for p in D.passages(r.item_id, r.text)])
            left = {i: r for i, r in left.items() if not D.matches(D.normalise(r.text)[0], index)}
        out = stage(spark, frame, SF)
        got = {r.doc_id: r for r in out.collect()}
        assert set(got) == set(left), name
        if name != "mixing":
            assert out.columns == docs.columns and all(got[i] == rows[i] for i in got)
            frame = C.materialize(out, "test")
    assert 0 < len(left) < len(rows)
    assert {r.doc_id for r in C.run(spark, SF).collect()} == set(left)

"""Ids that different texts share, samples that shared ids would burst, and further columns of any name and type."""

import random

import pytest
from pyspark.sql import functions as F

from voxelbase.llm import decontaminate, exact_dedup, near_dedup, pii, toxicity

RNG = random.Random(11)
WORDS = [" ".join("".join(RNG.choices("abcdefghiklmnorstu", k=6)) for _ in range(60)) for _ in range(4)]
T1, T2, T3, T4 = WORDS


def components(spark, rows, percent=85):
    out = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()), key=repr)


def test_texts_of_one_id_are_one_document(spark):
    rows = components(spark, [(5, T1), (3, T1), (5, T2), (4, T2)])
    assert rows == [(3, 56, 3, True), (4, 56, 3, False), (5, 56, 3, False), (5, 56, 3, False)]


def test_links_of_every_text_of_an_id_count(spark):
    rows = components(spark, [(5, T1), (3, T1), (5, T2), (7, T2 + " more")])
    assert rows == [(3, 56, 3, True), (5, 56, 3, False), (5, 56, 3, False), (7, 57, 3, False)]


def brute(rows, percent):
    """Components of ids by all pairs of rows."""
    sets = []
    for i, (doc, text) in enumerate(rows):
        w = (text or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    low = {d: d for d, _ in rows if d is not None}
    for _ in rows:
        for i, (a, _) in enumerate(rows):
            for j, (b, _) in enumerate(rows):
                if a is not None and b is not None and (a == b or (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]))):
                    low[a] = low[b] = min(low[a], low[b])
    return sorted(((d, len(s), low.get(d), d is None or low[d] == d) for (d, _), s in zip(rows, sets)), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_null_and_repeated_ids_equal_all_pairs(spark, seed):
    r = random.Random(seed)
    texts = [None, "", "two words", T1, T1 + " end", T2, "start " + T2, T3, T4, T3 + " " + T4, T3.upper()]
    rows = [(r.choice([None, *range(12)]), r.choice(texts)) for _ in range(30)]
    assert components(spark, rows) == brute(rows, 85)


def test_sample_of_labels_is_bounded_by_rows(spark):
    docs = spark.range(3000).select((F.col("id") % 100).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(3).alias("quality"), (F.col("id") % 2).cast("int").alias("toxic"))
    rows = toxicity.sampled(docs, labels, 200)
    assert rows.columns == ["text", "toxic"] and rows.count() == 200
    assert toxicity.sampled(docs, labels, 10_000).count() > 2000


ODD = ["__key", "__found", "__text", "__map", "__score", "__row", "__sha", "__maybe", "__null", "a.b", "a`b", "kind", "row", "m"]


@pytest.mark.parametrize("name", ["pii", "toxic", "exact", "near", "leaks"])
def test_columns_of_any_name_and_type_pass(spark, name):
    rows = [(1, f"{T1} Mr. John Smith a.b@example.com 10.1.2.3", "x"), (2, T2, "y"), (2, T3, None), (None, T4, "z"), (5, T2, "w")]
    base = spark.createDataFrame(rows, "doc_id long, text string, source string")
    odd = [F.create_map(F.lit("k"), F.col("source")).alias(c) if c == "m" else F.concat(F.lit(c), F.lit("!"), F.coalesce("source", F.lit("?"))).alias(c) for c in ODD]
    df = base.select("doc_id", "text", *odd, "source", F.lit(1).alias("source"))
    labels = spark.createDataFrame([(6, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, T3)], "item_id long, text string")
    run, n = {
        "pii": (pii.replace_entities, 5),
        "toxic": (lambda d: toxicity.drop_toxic(d, labels), 5),
        "exact": (exact_dedup.drop_copies, 4),
        "near": (lambda d: near_dedup.drop_near_copies(d, 80), 4),
        "leaks": (lambda d: decontaminate.drop_contaminated(d, bench), 4),
    }[name]
    out = run(df)
    assert out.columns[: len(df.columns)] == df.columns
    got = out.toDF(*[f"c{i}" for i in range(len(out.columns))]).collect()
    assert len(got) == n
    for r in got:
        own = r[len(ODD) + 2]
        assert r[len(ODD) + 3] == 1
        for i, c in enumerate(ODD):
            assert r[2 + i] == ({"k": own} if c == "m" else f"{c}!{own or '?'}")

import random

from voxelbase.llm import decontaminate as D

RUN = D.LEAST + D.STRIDE - 1


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghiklmnorstu", k=rng.randrange(2, 9))) for _ in range(n))


def norm(text):
    return "".join(map(chr, D.normalise(text)[0].tolist())).strip()


def test_every_run_of_the_stated_length_is_found(spark):
    rng = random.Random(4)
    items = [(0, prose(rng, 40)), (1, prose(rng, 150)), (2, prose(rng, 15))]
    docs = []
    for _, t in items:  # from each start one run, so a half and two thirds of an item too
        docs += [(len(docs) + i, prose(rng, 12) + " " + t[at : at + RUN] + " " + prose(rng, 12)) for i, at in enumerate(range(0, len(t) - RUN + 1, 7))]
    leaked = len(docs)
    docs += [(leaked + i, prose(rng, 60)) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id for r in D.contaminated(df, bench).collect()} == set(range(leaked))
    assert {r.doc_id for r in D.drop_contaminated(df, bench).collect()} == set(range(leaked, len(docs)))


def test_short_items_match_whole_words_exactly(spark):
    items = [(0, "What is E?"), (1, "the capital city of Elbonia is Mudville"), (2, "!!"), (3, "Qoph"), (4, "six times seven"), (5, "")]
    texts = ["so what IS e, then", "what is ex", "x the capital city of elbonia is Mudville.", "xthe capital city of elbonia is mudville", "the capital city of elbonia is mudvill", "qophs", "a qoph", "sixtimes seven", "six  times, seven", "", None, "!!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = D.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in rows) == [(0, 0, 0), (2, 1, 0), (6, 3, 0), (8, 4, 0)]
    assert all(norm(texts[r.doc_id][r.match_start : r.match_end]) == norm(items[r.item_id][1]) for r in rows)

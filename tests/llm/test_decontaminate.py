import random

import numpy as np

from voxelbase.llm import decontaminate as D


def distance(passage, text):
    """Least edits between a passage and any region of a text, by the whole table."""
    at, text = np.arange(len(text) + 1), np.array(text)
    row = np.zeros(len(text) + 1, dtype=int)
    for i, c in enumerate(passage, 1):
        best = np.append(i, np.minimum(row[:-1] + (text != c), row[1:] + 1))
        row = np.minimum.accumulate(best - at) + at
    return int(row.min())


def brute(docs, items):
    out = set()
    for d, text in docs:
        code, _ = D.normalise(text)
        for item, t in items:
            for i, s, p in D.passages(item, t):
                edits, need = D.budget(len(p))
                e = distance(p.tolist(), code.tolist())
                if e <= edits:
                    out.add((d, i, s, e))
    return out


def mutate(rng, text, n):
    chars = list(text)
    for _ in range(n):
        k = rng.randrange(len(chars))
        chars[k : k + 1] = rng.choice([[], ["z"], [chars[k], "q"]])
    return "".join(chars)


def test_matches_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghiklmnorstué", k=rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(20)) for i in range(5)] + [(5, prose(150)), (6, "short"), (7, None)]
    docs = [(i, prose(15) + ". " + mutate(rng, items[i % 5][1], rng.randrange(0, 14)).upper() + ", " + prose(20)) for i in range(40)]
    docs += [(100, None), (101, ""), (102, items[0][1]), (103, prose(60)), (104, prose(9) + " " + items[5][1][300:780] + " " + prose(9)), (105, items[1][1][:-3]), (106, items[2][1][2:])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id, r.passage_start, r.edits) for r in rows} == brute(docs, items)
    assert {102, 104}.issubset({r.doc_id for r in rows}) and 103 not in {r.doc_id for r in rows}
    text = dict(docs)
    r = next(r for r in rows if r.doc_id == 102)
    assert text[102][r.match_start : r.match_end] == items[0][1]
    assert D.drop_contaminated(df, bench).count() == len(docs) - len({r.doc_id for r in rows})


def test_blocks_give_the_same_rows(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one = sorted(map(tuple, D.contaminated(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_GRAMS", 5000)
    assert one and sorted(map(tuple, D.contaminated(docs, bench).collect())) == one


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, bench).count() == 0
    assert D.contaminated(docs.limit(0), bench).count() == 0


def test_repetitive_text_takes_little_memory():
    """Bands are counted, not pairs of hits: a long text of one syllable against a passage of it."""
    import tracemalloc

    passage = D.normalise("ha " * 40)[0][:-1]
    index = D.Passages([(0, 0, passage), (1, 0, D.normalise("ha " * 20 + "ho " * 20)[0][:-1])])
    text = D.normalise("ha " * 200_000)[0]
    tracemalloc.start()
    found = D.matches(text, index)
    assert tracemalloc.get_traced_memory()[1] < 150e6 and found[0][:2] == (0, 0)
    tracemalloc.stop()


def test_long_items_are_cut_everywhere(spark):
    rng = random.Random(3)
    item = " ".join("".join(rng.choices("abcdefghiklmnorstu", k=6)) for _ in range(3000))
    docs = [(i, f"so {item[at : at + 90]} it goes") for i, at in enumerate(range(0, len(item) - 90, 4999))] + [(99, "nothing of it")]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert {r.doc_id for r in got.collect()} == {i for i, _ in docs if i != 99}

import random

import pytest

from voxelbase.llm import decontaminate, exact_dedup, near_dedup

SCHEMA = "doc_id long, text string, source string"
RNG = random.Random(6)
A, B, LEAK = (" ".join("".join(RNG.choices("abcdefghiklmnorstu", k=6)) for _ in range(60)) for _ in range(3))


def kept(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(
    "drop",
    [
        exact_dedup.drop_copies,
        lambda df: near_dedup.drop_near_copies(df, 80),
    ],
)
def test_copies_with_null_and_shared_ids(spark, drop):
    rows = [(None, A, "x"), (None, A, "y"), (7, A, "z"), (7, A, "z"), (7, B, "b"), (9, B, "b"), (9, LEAK, "u"), (None, LEAK.replace(" ", "  "), "v"), (None, "one of its own", "n")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = kept(drop(df))
    texts = [" ".join(t.split()) for _, t, _ in got]
    assert len(got) == 4 and len(set(texts)) == 4  # one row of each text
    assert (7, A, "z") in got and (7, B, "b") in got and (9, LEAK, "u") in got and (None, "one of its own", "n") in got


@pytest.mark.parametrize(
    "drop",
    [
        exact_dedup.drop_copies,
        lambda df: near_dedup.drop_near_copies(df, 80),
    ],
)
def test_null_ids_alone(spark, drop):
    got = kept(drop(spark.createDataFrame([(None, A, "x"), (None, A, "x"), (None, B, "x")], SCHEMA)))
    assert got == sorted([(None, A, "x"), (None, B, "x")], key=repr)


def test_leaks_with_null_and_shared_ids(spark):
    rows = [(None, "so " + LEAK, "x"), (3, LEAK, "x"), (3, A, "y"), (3, A, "y"), (None, B, "z"), (4, None, "n")]
    bench = spark.createDataFrame([(0, LEAK)], "item_id long, text string")
    got = kept(decontaminate.drop_contaminated(spark.createDataFrame(rows, SCHEMA), bench))
    assert got == sorted([(3, A, "y"), (3, A, "y"), (None, B, "z"), (4, None, "n")], key=repr)

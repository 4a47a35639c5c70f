import math
from collections import defaultdict

import pytest

from voxelbase.llm import mixing as M


def table(spark, sizes, words=10):
    rows, n = [], 0
    for s, k in sizes.items():
        for _ in range(k):
            rows.append((n, " ".join(["w"] * (1 + n % words)), s))
            n += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def spent(rows):
    out = defaultdict(int)
    for r in rows:
        out[r.source] += r.copies * r.n_tokens
    return out


def test_repeat_limit_and_weights(spark):
    df = table(spark, {"a": 900, "b": 90, "c": 30, None: 12})
    rows = M.mix(df, repeats=3.0, block_tokens=200).collect()
    assert len(rows) == 1032 and len({r.doc_id for r in rows}) == 1032
    got, weight = spent(rows), {r.source: r.weight for r in rows}
    assert math.isclose(sum(weight.values()), 1, rel_tol=1e-9)
    total = sum(got.values())
    for s in weight:
        own = sum(r.n_tokens for r in rows if r.source == s)
        assert abs(got[s] - weight[s] * total) <= 12  # one document short at most
        assert got[s] <= 3.0 * own + 1
    assert {r.copies for r in rows if r.source == "a"} == {1}
    assert max(r.copies for r in rows) <= 3
    again = M.mix(df.repartition(7), repeats=3.0, block_tokens=200).collect()
    assert sorted((r.doc_id, r.copies, r.block, r.position) for r in rows) == sorted((r.doc_id, r.copies, r.block, r.position) for r in again)


def test_bisection_meets_targets(spark):
    p = [0.7, 0.2, 0.07, 0.03]
    shares = spark.createDataFrame([(x,) for x in p], "share double")
    h = lambda a: -sum(w * math.log(w) for w in (x**a / sum(y**a for y in p) for x in p))
    a = M.temperature(shares, entropy=1.2)
    assert abs(h(a) - 1.2) < 1e-6
    assert M.temperature(shares, entropy=0.1) == 1.0
    a = M.temperature(shares, repeats=2.0)
    assert abs((0.03 / 0.7) ** (a - 1) - 2.0) < 1e-6
    assert M.temperature(shares, repeats=1000.0) == 0.0


@pytest.mark.parametrize("budget", [100, 40_000])
def test_budgets_follow_the_permutation(spark, budget):
    df = table(spark, {"a": 300, "b": 60})
    rows = M.mix(df, entropy=0.6, repeats=None, budget=budget, block_tokens=64).collect()
    got = spent(rows)
    assert budget - 20 <= sum(got.values()) <= budget
    full = {r.doc_id: r for r in M.mix(df, entropy=0.6, repeats=None, block_tokens=64).collect()}
    for s in ("a", "b"):  # a block that comes before a used one is used as well
        used = {r.position for r in rows if r.source == s}
        low = min((r.copies for r in rows if r.source == s), default=0)
        whole = {d for d, r in full.items() if r.source == s}
        if whole - {r.doc_id for r in rows} and used:
            assert used == set(range(1, max(used) + 1)) or low >= 0


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "x"), (None, "a b", "x"), (3, "a", "x"), (3, "a", "x")], "doc_id long, text string, source string")
    rows = M.mix(df).collect()
    assert len(rows) == 5 and all(r.copies >= 1 for r in rows)
    assert M.mix(df.limit(0)).count() == 0
    assert [r.n_tokens for r in df.select(M.word_count().alias("n_tokens")).collect()] == [0, 0, 2, 1, 1]
    assert M.mix(df.where("doc_id < 3")).count() == 2


@pytest.mark.parametrize("budget", [None, 700, 20_000])
def test_matches_brute_force(spark, budget):
    """Copies of every document against epochs and blocks walked one after another; draws are the operator's own hashes."""
    from pyspark.sql import functions as F

    df = table(spark, {"a": 400, "b": 60, "c": 9, None: 5})
    rows = M.mix(df, repeats=3.0, budget=budget, block_tokens=100).collect()
    got, weight = {r.doc_id: r.copies for r in rows}, {r.source: r.weight for r in rows}
    docs = df.select("doc_id", "source", M.word_count().alias("n"), M._order(M.SEED).alias("key")).collect()
    own = defaultdict(int)
    for r in docs:
        own[r.source] += r.n
    total = sum(own.values())
    a = M.temperature(spark.createDataFrame([(n / total,) for n in own.values()], "share double"), None, 3.0)
    power = {s: (n / total) ** a for s, n in own.items()}
    for s in weight:
        assert math.isclose(weight[s], power[s] / sum(power.values()), rel_tol=1e-9)
    spend = budget if budget else max(own[s] / power[s] for s in own) * sum(power.values())
    want = {}
    turns = {(r.source, r.block): r.turn for r in spark.createDataFrame([(s, b) for s in own for b in range(60)], "source string, block long").withColumn("turn", M._turn(M.SEED)).collect()}
    for s, n in own.items():
        quota = round(spend * power[s] / sum(power.values()))
        epochs, rest = divmod(quota, n)
        blocks = defaultdict(list)
        for r in docs:
            if r.source == s:
                blocks[r.key % -(-n // 100)].append(r)
                want[r.doc_id] = epochs
        for b in sorted(blocks, key=lambda b: (turns[s, b], b)):
            size = sum(r.n for r in blocks[b])
            for r in sorted(blocks[b], key=lambda r: (r.key, r.doc_id)):
                if r.n > rest:
                    break
                rest -= r.n
                want[r.doc_id] += 1
            else:
                continue
            break
    assert got == {d: c for d, c in want.items() if c}


def test_documents_keep_their_columns_and_texts(spark):
    df = table(spark, {"a": 30, "b": 3}).selectExpr("*", "doc_id AS block", "doc_id * 2 AS key", "source AS name", "array(doc_id) AS copies")
    rows = M.with_copies(df, repeats=2.0, block_tokens=20)
    assert rows.columns == ["doc_id", "text", "source", "key", "name", "n_tokens", "copies", "weight", "block"]
    whole = {r.doc_id: r for r in df.collect()}
    assert all(r.text == whole[r.doc_id].text and r.key == 2 * r.doc_id for r in rows.collect()) and rows.count() == 33
    counted = M.with_copies(df.withColumn("t", df.doc_id * 0 + 7), repeats=2.0, tokens="t").collect()
    assert {r.n_tokens for r in counted} == {7}

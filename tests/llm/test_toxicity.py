import zlib

from voxelbase.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def weight(text):
    g = T.Grammar()
    return g.clause(T.WORD.findall(text.lower()))[0]


def test_grammar_weighs_frames():
    assert weight("what an idiot") == T.BARE
    assert weight("you are an idiot") == T.AIMED
    assert weight("he is not an idiot") < weight("what an idiot")
    assert weight("she said you are an idiot") < weight("you are an idiot")
    assert weight("i will kill you") == T.THREATENED
    assert weight("i will not kill you") < T.BARE
    assert weight("kill the process") == 0
    assert weight("a clear day") == 0


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = T.scored(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    ranks = rows.score.rank()
    n1 = int(rows.toxic.sum())
    auc = (ranks[rows.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(rows) - n1))
    print("auc", auc, "accuracy", (rows.predicted == rows.toxic).mean())
    assert auc > 0.94 and (rows.predicted == rows.toxic).mean() > 0.98
    clean = rows[rows.predicted == 1]
    assert (clean.toxic == 1).mean() > 0.98


def test_shape_edges_and_held_out_rule(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "idiot. " * 3), (3, "idiot. " * 3), (None, "you moron, you scum"), (4, "x " * 20_000 + "fine")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = T.scored(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert T.scored(docs.limit(0), labels).count() == 0
    kept = T.drop_toxic(docs.withColumn("score", docs.doc_id), labels)
    assert kept.columns == ["doc_id", "text", "score"] and {r.doc_id for r in kept.collect()} == {1, 2, 4}


def direct(words):
    """A clause's weight by looking back from each word, without a machine."""
    g, total = T.Grammar(), 0.0
    kinds = [g.read(w) for w in words]
    target_free = 0  # words since which no threat is open
    for i, (c, x) in enumerate(kinds):
        back = lambda k, n, i=i: any(kinds[j][0] == k for j in range(max(0, i - n), i))
        hit = 0.0
        if c == T.C_INSULT:
            hit = T.BARE * (T.AIMED if back(T.C_TARGET, 3) else 1)
        elif c == T.C_TARGET:
            if any(kinds[j][0] == T.C_THREAT for j in range(max(target_free, i - T.REACH), i)):
                hit = T.THREATENED
            target_free = i + 1
        hit *= (T.DENIED if back(T.C_NEGATION, 4) else 1) * (T.REPORTED if back(T.C_REPORT, i) else 1)
        total += hit * x
    return total


def test_machine_matches_direct_reading():
    import random

    rng = random.Random(1)
    words = ["idiot", "scum", "kill", "you", "them", "not", "never", "said", "wrote", "the", "blue", "house"]
    g = T.Grammar()
    for _ in range(3000):
        clause = rng.choices(words, k=rng.randrange(0, 14))
        assert abs(g.clause(clause)[0] - direct(clause)) < 1e-9, clause


def test_report_frames_reach_over_a_colon():
    g = T.Grammar()
    said = lambda t: g.features(t)[1]
    assert said("she said: you are an idiot") == said("she said you are an idiot") < said("note: you are an idiot") == said("you are an idiot")
    assert said("you aren’t an idiot") == said("you aren't an idiot") < said("you are an idiot")
    assert said("kill all of you") == said("kill yourself") == T.THREATENED and said("kill the old process") == 0


def test_scores_are_the_model_over_features(spark):
    """The distributed scores against one by one."""
    import math

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    gram, w = T.fit(docs, labels)
    got = {r.doc_id: r.score for r in T.scored(docs, labels).collect()}
    for r in docs.collect():
        z = w[0] + sum(a * b for a, b in zip(w[1:], gram.features(r.text), strict=True))
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9

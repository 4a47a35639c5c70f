import random
import re

from voxelbase.llm import near_dedup as N


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=N.MIN_PERCENT):
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    where = {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    common = {}
    for at in where.values():
        for x in range(len(at)):
            for y in range(x + 1, len(at)):
                common[at[x], at[y]] = common.get((at[x], at[y]), 0) + 1
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            comp[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def got(df):
    return sorted(map(tuple, N.near_groups(df).collect()), key=repr)


def test_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert any(r[0] != r[2] for r in want)
    assert sorted(got(docs)) == want


def test_large_group_chains_and_edges(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    base = rng.choices(vocab, k=150)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "ONE  two"), (5, "one two three"), (6, "É a b c d e"), (7, "é a b c d e")]
    for i in range(150):  # each a change or two from the base, far from each other
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(150)] = f"x{i}"
        rows.append((100 + i, " ".join(w)))
    w = list(rng.choices(vocab, k=150))
    for i in range(40):  # a chain
        w[(i * 7) % 150] = f"c{i}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, " ".join(rng.choices(vocab, k=40))) for i in range(50)]
    rows += [(3000 + i, rows[20][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(got(df)) == brute(rows)


def test_null_ids_repeated_rows_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, None), (5, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string")
    assert got(df) == [(5, 2, 5, True), (5, 2, 5, True), (None, 0, None, True), (None, 2, None, True)]
    assert got(df.limit(0)) == []


def test_words_longer_than_a_piece(monkeypatch):
    monkeypatch.setattr(N, "PIECE", 64)
    text = "a " * 50 + "x" * 300 + " b c d e " + "y" * 10 + " f" * 40 + "z" * 70
    assert len(N.shingle_sets([text, "q", None, text])[0]) == len(shingles(text))

"""The filter audit against its SQL on whole tables and against applying all orders one by one."""

import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from voxelbase.llm import filter_audit as A

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """Every order applied to the rows themselves."""

    def fails(row):
        doc, _, text = row
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        tests = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text))}
        tests["E"] = doc is not None and any(d is not None and d < doc and (t or "") == text for d, _, t in docs)
        return {k for k, v in tests.items() if v}

    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    rows, out = [(r[0], r[1] or "", fails(r)) for r in docs], []
    shapley = Counter()
    for part in {p for _, p, _ in rows}:
        own = [(d, f) for d, p, f in rows if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                hit = [d for d, f in left if c in f]
                left = [(d, f) for d, f in left if c not in f]
                shapley[part, c] += len(hit)
                out.append([part, "".join(order), step, len(left), len(hit), sum(c in f for _, f in own) - len(hit), sum(f == {c} for _, f in own), sum(d in good for d in hit), sum(d in toxic for d in hit)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def got(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def test_whole_query_equals_sql(spark):
    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rows = got(A.op12_filter_audit(spark, sf))
    assert rows == sorted(con.sql(A.ORACLE).select(", ".join(COLUMNS)).fetchall()) and len(rows) == 600 * len({r[0] for r in rows})


@pytest.fixture(scope="module")
def odd():
    many = " ".join(f"w{i}" for i in range(210))
    texts = [None, "", "short", many, many, many + " $", "SHOUT " * 300, many.upper(), "same " * 250, "same " * 250, "a|b", "ÄÖ " * 120, " ".join("abc"), many + "\n", "x " * 200_000]
    docs = [(i * 2, ["en", "de", None, ""][i % 4], t) for i, t in enumerate(texts)] + [(None, "en", many), (None, "en", many), (4, "en", "short"), (4, "en", "short"), (3, "fr", "SHOUT " * 300)]
    return docs, [(4, 1, 0), (4, 0, 1), (6, 1, None), (None, 1, 1), (8, None, 1), (12, 1, 1), (99, 1, 1)]


def test_odd_rows_equal_every_order(spark, odd, monkeypatch):
    docs, labels = odd
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in docs], "doc_id long, lang string, text string, part string, fails string, `a.b` string").repartition(4)
    want = brute(docs, labels)
    label = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert got(A.audit(df, label)) == want
    assert sum(r[5] for r in want) and sum(r[6] for r in want) and sum(r[7] for r in want)


def test_a_repeated_text_with_many_rows(spark):
    docs = [(i, "en", "copy") for i in range(3000)] + [(i, "en", f"own {i}") for i in range(3000, 3100)]
    rows = got(A.audit(spark.createDataFrame(docs, "doc_id long, lang string, text string").repartition(6), spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    first = {r[1][0]: r for r in rows if r[2] == 1}
    assert first["E"][3:7] == (101, 2999, 0, 0) and first["A"][3:7] == (0, 3100, 0, 101)


def test_empty_table(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, lang string, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert got(A.audit(docs, labels)) == []

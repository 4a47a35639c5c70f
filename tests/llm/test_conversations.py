"""Conversation repair against uniform-cost search over audits, whole queries and edges."""

import hashlib
import heapq
import re
import zlib
from collections import defaultdict

import pytest

from voxelbase.llm import conversations as C


def faults(rows):
    """The damage of the contract on (conv_id, turn, role, text), as plain Python."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        out[conv] += []
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind != 0:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in out.items()}


def search(turns, fault):
    """The cheapest audit and repaired turns, of equal costs the least audit: uniform-cost search over whole audits."""
    heap, best = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, i, initials, said = heapq.heappop(heap)
        state = (i, "" if not initials else "s" if initials == "s" else initials[-1])
        if state in best:
            continue
        best[state] = cost
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, said
        for role in ("user", "assistant"):
            if re.fullmatch("s?(ua)*u?", initials + role[0]):
                heapq.heappush(heap, (cost + 5, audit + "I", i, initials + role[0], (*said, f"{role}:")))
        if i < len(turns):
            _, own, text = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, initials, said))
            if fault[i] not in ("blank", "duplicate"):
                more = 5 if fault[i] == "truncated" else 0
                for letter, role, price in (("K", own, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if role and re.fullmatch("s?(ua)*u?", initials + role[0]):
                        heapq.heappush(heap, (cost + price + more, audit + letter, i + 1, initials + role[0], (*said, f"{role}:{text}")))


def expected(rows):
    out = []
    for conv, turns in faults(rows).items():
        fault, seen = [], set()
        for _, role, text in turns:
            words = text.strip(" \t\n\x0b\x0c\r")
            fault.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        cost, audit, said = search(turns, fault)
        out.append((conv, gaps, *(fault.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_whole_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(rows)
    assert got(C.op13_conversation_repair(spark, sf)) == want
    assert sum(r[6] for r in want) > 0 and len({r[7] for r in want}) > 20


@pytest.fixture(scope="module")
def odd():
    import random

    r = random.Random(7)
    said = ["Yes.", "No", " ", "", None, "Why?\n", "Stop! ", "…", "a.b", "\u00a0"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "sage"]
    rows = [(c, r.choice([None, t, t, t, t + 3, -t]), r.choice(roles), r.choice(said)) for c in range(150) for t in range(r.randint(1, 12))]
    rows += [(None, t, "user", f"{t}.") for t in range(5)] + [(900, None, None, None)] * 40 + [(901, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(300)]
    rows += [(902 + c, t, "user", "x") for c in range(30) for t in [next(t for t in range(10_000) if zlib.crc32(f"{902 + c}:{t}".encode()) % 20 == 0)]]  # all of it is dropped
    return rows


@pytest.mark.parametrize("most", [C.MOST_ROWS, 6, 0])
def test_odd_rows_in_tensors_and_streams(spark, odd, most):
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").repartition(5)
    assert got(C.repair(C.damaged(df), most)) == expected(odd)


def test_limit_of_bytes_and_small_gathers(spark, odd, monkeypatch):
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").repartition(5)
    assert got(C.repair(C.damaged(df), most_bytes=20)) == expected(odd)


@pytest.mark.parametrize("most", [C.MOST_ROWS, 2])
def test_turns_are_those_of_the_digest(spark, odd, most):
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    own = defaultdict(list)
    for r in sorted(C.repaired_turns(C.damaged(df), most).collect(), key=lambda r: r.place):
        own[r.conv_id].append(f"{r.role}:{r.text}")
    for r in C.repair(C.damaged(df)).collect():
        assert hashlib.sha256("\n".join(own[r.conv_id]).encode()).hexdigest() == r.repaired_sha256


def test_edges(spark):
    schema = "conv_id string, turn int, role string, text string, fault string, key int, gone boolean"
    empty = C.repair(spark.createDataFrame([], schema).drop("gone"))
    assert empty.collect() == [] and empty.columns == COLUMNS
    long = "word " * 200_000 + "end."
    rows = [("a", 1, "user", long, "f", 1), ("a", 2, "assistant", "Fine.", "f", 2), (" ", 1, "user", "Hm.", None, None), (None, 1, "user", "Hm.", None, None)]
    out = {r.conv_id: r for r in C.repair(spark.createDataFrame(rows, schema.rsplit(",", 1)[0])).collect()}
    assert out["a"].audit == "KK" and out["a"].cost == 0 and out["a"].repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:Fine.".encode()).hexdigest()
    assert out[" "].audit == out[None].audit == "D" and out[None].cost == 2 and len(out) == 3

"""Operator 13, repair of conversations at least cost.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``. Turns may be
kept (cost 0, 5 if truncated), given the role user or assistant (1, and 5 if truncated),
deleted (2; blank turns and duplicates have to be), and empty user or assistant turns
may be put in anywhere (5). States are 0 nothing yet, 1 after a system turn, 2 after user, 3
after assistant; 0 and 3 may end.

Conversations are dealt to tasks by key and there to buckets by length (powers of two).
A bucket is one tensor, time first: backward costs (turns + 1, conversations, states) are
filled turn by turn for all its conversations at once, kept, and the edits then traced
forward for all at once, choosing of the cheapest edits the ASCII-least letter (D, I, K,
R). As each letter leads to one place, that gives the least of the cheapest audits.

A conversation above ``most`` rows or bytes doesn't meet others in a tensor: its turns stream
through two sorted passes. Backward, a pass carries the four costs and notes each turn's
choices, a letter for each state; forward, a pass carries the state and the running
digest. Neither holds more than an Arrow batch, save the audit, which is part of the
result. Its duplicates are found beforehand by grouping digests.

Nulls in any column count as one space. Turns are taken in order, null first; equal turns by
role, then text. Repeated rows are duplicates of the first. An empty role has no
initial and is illegal. Rows without a conv_id are one conversation (apart from one
named by a space). Conversations that lost all rows get zeros, an empty audit and the digest of the empty
string. Texts of any length are read whole. Columns other than conv_id, turn, role and
text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, only_ids, without_ids

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: A conversation above either meets no others in a tensor.
MOST_ROWS, MOST_BYTES = 4096, 1 << 25
#: Rows that a task gathers before it fills tensors.
GATHER_ROWS, GATHER_BYTES = 20_000, 1 << 26
FAR = np.int64(1) << 40
#: State after the next user or assistant turn, and after keeping a turn of initial s, u, a or another (-1: not allowed).
NEXT = np.array([2, 2, 3, 2])
KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
LETTERS = "DIKR"
SPACE = r"\x20\x09-\x0D"
COLUMNS = ["key", "conv_id", "turn", "role", "text", "gone", "initial", "fault"]
#: A row for each conversation, or for each turn of the repaired ones.
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "place long, edit string, role string, text string"


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's faults by crc32 of ``conv_id:turn``; a dropped row stays as a marker with ``gone``, without text."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    text = F.when(fault.isin(0, 1), "").when(fault == 2, F.regexp_replace(named("text"), "[.!?]", "")).otherwise(named("text"))
    role = F.when(fault == 4, "user").otherwise(named("role"))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (fault == 0).alias("gone"), fault.alias("fault"))
    return rows.withColumn("again", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fault", "again")


def _judged(rows: DataFrame) -> DataFrame:
    """``rows`` with ``initial`` (0 s, 1 u, 2 a, 3 other) and ``fault``: 1 blank, 3 truncated, 0 neither."""
    initial = F.substring("role", 1, 1)
    fault = F.when(~F.col("text").rlike(f"[^{SPACE}]"), 1).when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), 3).otherwise(0)
    return rows.withColumns({"initial": F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3), "fault": fault})


def backward_costs(initial: np.ndarray, fault: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Least costs from before each turn to the end, (turns + 1, conversations, states); inputs are (turns, conversations)."""
    turns, many = initial.shape
    costs = np.empty((turns + 1, many, 4), dtype=np.int64)
    costs[turns] = _closed(np.tile(np.array([0, FAR, FAR, 0]), (many, 1)))
    for t in range(turns - 1, -1, -1):
        costs[t] = np.where((t < length)[:, None], _closed(_consumed(costs[t + 1], initial[t], fault[t]).min(axis=2)), costs[t + 1])
    return costs


def _closed(costs: np.ndarray) -> np.ndarray:
    """Costs with inserted turns: no chain of them need pass a state twice."""
    for _ in range(3):
        costs = np.minimum(costs, INSERT + costs[:, NEXT])
    return costs


def _consumed(after: np.ndarray, initial: np.ndarray, fault: np.ndarray) -> np.ndarray:
    """Costs of deleting, keeping and giving a role to a turn, (conversations, states, 3), from the costs after it."""
    stays = (fault == 0) | (fault == 3)
    extra = np.where(stays, np.where(fault == 3, TRUNCATED, 0), FAR)[:, None]
    to = KEEP[:, initial].T
    kept = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), axis=1), FAR) + extra
    return np.stack([after + DELETE, kept, REROLE + after[:, NEXT] + extra], axis=2)


def trace(initial: np.ndarray, fault: np.ndarray, length: np.ndarray, costs: np.ndarray) -> list[np.ndarray]:
    """The edits of all conversations, step by step: of each step the letter's number (-1 where a conversation has ended)."""
    many = initial.shape[1]
    each, at, state, steps = np.arange(many), np.zeros(many, dtype=np.int64), np.zeros(many, dtype=np.int64), []
    padded = [np.vstack([x, np.zeros((1, many), dtype=x.dtype)]) for x in (initial, fault)]
    while True:
        here = costs[at, each, state]
        going = ~((at == length) & ((state == 0) | (state == 3)))
        if not going.any():
            return steps
        after = costs[np.minimum(at + 1, len(costs) - 1), each]
        options = _consumed(after, padded[0][at, each], padded[1][at, each])[each, state]
        options = np.where((at < length)[:, None], options, FAR)
        inserted = INSERT + costs[at, each, NEXT[state]]
        options = np.stack([options[:, 0], inserted, options[:, 1], options[:, 2]], axis=1)
        letter = np.where(going, (options == here[:, None]).argmax(axis=1), -1)
        steps.append(letter)
        to = np.where(letter == 2, KEEP[state, padded[0][at, each]], np.where((letter == 1) | (letter == 3), NEXT[state], state))
        at, state = at + ((letter >= 0) & (letter != 1)), np.where(going, to, state)


ROLES = {2: "user", 3: "assistant"}


def _repaired(edits: str, roles: list[str], texts: list[str]) -> list[tuple[str, str, str]]:
    """The repaired turns as (edit, role, text). Roles put in or changed follow from the state."""
    out, state, i = [], 0, 0
    for e in edits:
        if e != "D":
            state = int(KEEP[state, "sua".find(roles[i][0])] if e == "K" else NEXT[state])
            out.append((e, roles[i] if e == "K" else ROLES[state], "" if e == "I" else texts[i]))
        i += e != "I"
    return out


def _gaps(turns: list) -> int:
    own = [t for t in turns if t is not None]
    return max(own) - min(own) + 1 - len(set(own)) if own else 0


def _illegal(initial: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Adjacent turns that are not su, ua or au, a conversation."""
    if len(initial) < 2:
        return np.zeros(initial.shape[1], dtype=np.int64)
    a, b = initial[:-1], initial[1:]
    fine = ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))
    return (~fine & (np.arange(1, len(initial))[:, None] < length)).sum(axis=0)


def repair_bucket(group: list[dict]) -> list[tuple[tuple, list]]:
    """(report, repaired turns) of conversations (lists turn, role, text, initial, fault) of like length, as one tensor."""
    length = np.array([len(g["turn"]) for g in group], dtype=np.int64)
    shape = (int(length.max()), len(group))
    initial, fault = np.full(shape, 3, dtype=np.int64), np.ones(shape, dtype=np.int64)
    for i, g in enumerate(group):
        seen: set = set()
        for t, said in enumerate(zip(g["role"], g["text"], strict=True)):
            if said in seen and g["fault"][t] != 1:
                g["fault"][t] = 2
            seen.add(said)
        initial[: length[i], i], fault[: length[i], i] = g["initial"], g["fault"]
    costs = backward_costs(initial, fault, length)
    steps = np.array(trace(initial, fault, length, costs), dtype=np.int64).reshape(-1, len(group))
    inside, illegal, out = np.arange(shape[0])[:, None] < length, _illegal(initial, length), []
    counts = [((fault == k) & inside).sum(axis=0) for k in (1, 2, 3)]
    for i, g in enumerate(group):
        edits = "".join(LETTERS[k] for k in steps[:, i] if k >= 0)
        turns = _repaired(edits, g["role"], g["text"])
        digest = hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in turns).encode()).hexdigest()
        out.append(((_gaps(g["turn"]), *(int(c[i]) for c in counts), int(illegal[i]), int(costs[0, i, 0]), edits, digest), turns))
    return out


def _batch(rows: list[tuple], schema: str, kind: pa.DataType) -> pa.RecordBatch:
    """Rows (conv_id, and the fields of ``schema``) as Arrow."""
    fields = [f.split() for f in schema.split(", ")]
    kinds = [kind, *(pa.int64() if k == "long" else pa.string() for _, k in fields)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", *(n for n, _ in fields)])


def _conversations(batches):
    """Whole conversations of rows that stand together, over the limits of Arrow batches, as lists by column."""
    key, own = None, None
    for batch in batches:
        cols = batch.to_pydict()
        for k, conv, turn, role, text, gone, initial, fault in zip(*(cols[c] for c in COLUMNS), strict=True):
            if k != key:
                if own is not None:
                    yield own
                key, own = k, {"conv_id": conv, "turn": [], "role": [], "text": [], "initial": [], "fault": []}
            if not gone:
                for c, v in (("turn", turn), ("role", role), ("text", text), ("initial", initial), ("fault", fault)):
                    own[c].append(v)
    if own is not None:
        yield own


def _repair_task(kind: pa.DataType, turns: bool):
    def flush(held):
        buckets: dict[int, list] = {}
        for g in held:
            buckets.setdefault(len(g["turn"]).bit_length(), []).append(g)
        for group in buckets.values():
            done = repair_bucket(group)
            if not turns:
                yield _batch([(g["conv_id"], *report) for g, (report, _) in zip(group, done, strict=True)], REPORT, kind)
            elif rows := [(g["conv_id"], i, *turn) for g, (_, own) in zip(group, done, strict=True) for i, turn in enumerate(own)]:
                yield _batch(rows, TURNS, kind)

    def run(batches):
        held, rows, size = [], 0, 0
        for g in _conversations(batches):
            held.append(g)
            rows, size = rows + len(g["turn"]) + 1, size + sum(map(len, g["text"]))
            if rows >= GATHER_ROWS or size >= GATHER_BYTES:
                yield from flush(held)
                held, rows, size = [], 0, 0
        if held:
            yield from flush(held)

    return run


def _backward(batches):
    """For turns in falling order, adds ``choice`` (two bits a state: the number of the letter that a cheapest path takes here) and ``cost`` from before the turn, nothing said yet.

    Where the letter is I, the next state's letter at the same turn follows.
    """
    key, after = None, None
    for batch in batches:
        choice, cost = [], []
        for k, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("key", "initial", "fault")), strict=True):
            if k != key:
                key, after = k, _closed(np.array([[0, FAR, FAR, 0]]))
            options = _consumed(after, np.array([initial]), np.array([fault]))[0]
            after = _closed(options.min(axis=1)[None])
            letters = np.stack([options[:, 0], INSERT + after[0, NEXT], options[:, 1], options[:, 2]], axis=1) == after[0][:, None]
            choice.append(int((letters.argmax(axis=1) << np.array([0, 2, 4, 6])).sum()))
            cost.append(int(after[0, 0]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(choice, pa.int64()), pa.array(cost, pa.int64())], names=[*batch.schema.names, "choice", "cost"])


class _Reader:
    """One long conversation read forward turn by turn: what is carried is of fixed size, save the edits."""

    def __init__(self, conv_id, cost: int):
        self.conv_id, self.cost, self.sha, self.state, self.edits, self.place = conv_id, cost, hashlib.sha256(), 0, [], 0
        self.low = self.high = self.before = None
        self.distinct, self.counts, self.illegal = 0, [0, 0, 0, 0], 0

    def say(self, edit: str, role: str, text: str) -> tuple:
        self.sha.update(f"{'' if self.place == 0 else chr(10)}{role}:{text}".encode())
        self.place += 1
        return (self.conv_id, self.place - 1, edit, role, text)

    def turn(self, turn, role: str, text: str, initial: int, fault: int, choice: int):
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        self.counts[fault] += 1
        self.illegal += self.before is not None and (self.before, initial) not in ((0, 1), (1, 2), (2, 1))
        self.before = initial
        while True:
            letter = LETTERS[choice >> 2 * self.state & 3]
            self.edits.append(letter)
            if letter != "D":
                self.state = int(KEEP[self.state, initial] if letter == "K" else NEXT[self.state])
                yield self.say(letter, role if letter == "K" else ROLES[self.state], "" if letter == "I" else text)
            if letter != "I":
                return

    def end(self):
        while self.state not in (0, 3):
            self.state = int(NEXT[self.state])
            self.edits.append("I")
            yield self.say("I", ROLES[self.state], "")

    def report(self) -> tuple:
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return (self.conv_id, gaps, *self.counts[1:], self.illegal, self.cost, "".join(self.edits), self.sha.hexdigest())


def _forward(kind: pa.DataType, turns: bool):
    names = ["key", "conv_id", "turn", "role", "text", "initial", "fault", "choice", "cost"]

    def run(batches):
        key, reader = None, None
        for batch in batches:
            said, reports = [], []
            for k, conv, turn, role, text, initial, fault, choice, cost in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if k != key:
                    if reader:
                        said += reader.end()
                        reports.append(reader.report())
                    key, reader = k, _Reader(conv, cost)
                for x in reader.turn(turn, role, text, initial, fault, choice):
                    if turns:
                        said.append(x)
            if turns and said:
                yield _batch(said, TURNS, kind)
            if not turns and reports:
                yield _batch(reports, REPORT, kind)
        if reader:
            said = [*reader.end()]
            if turns and said:
                yield _batch(said, TURNS, kind)
            if not turns:
                yield _batch([reader.report()], REPORT, kind)

    return run


def _long(rows: DataFrame, kind: pa.DataType, conv: str, turns: bool) -> DataFrame:
    """Conversations of any length by two sorted passes; ``rows`` have key, conv_id, turn, role, text, initial, fault."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(rows.withColumns({"said": F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)), "row": F.monotonically_increasing_id()}), "long-rows")
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "row")
    first = rows.groupBy("key", "said").agg(F.min(place)["row"].alias("first")).select(F.col("first").alias("row"), F.lit(True).alias("is_first"))
    # The join goes by unique row numbers: what many rows say meets them in no task.
    rows = rows.join(first, "row", "left").withColumn("fault", F.when(F.col("is_first").isNull() & (F.col("fault") != 1), 2).otherwise(F.col("fault"))).drop("is_first", "said")
    falling = [F.col("key"), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), F.col("row").desc()]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    chosen = materialize(rows.repartition(parts, "key").sortWithinPartitions(*falling).mapInArrow(_backward, f"{schema}, choice long, cost long"), "chosen")
    rising = ["key", F.col("turn").asc_nulls_first(), "role", "text", "row"]
    return chosen.repartition(parts, "key").sortWithinPartitions(*rising).mapInArrow(_forward(kind, turns), f"conv_id {conv}, {TURNS if turns else REPORT}")


def _repair(rows: DataFrame, turns: bool, most_rows: int, most_bytes: int) -> DataFrame:
    spark, conv = rows.sparkSession, rows.schema["conv_id"].dataType
    parts, kind = int(spark.conf.get("spark.sql.shuffle.partitions")), to_arrow_type(conv)
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    live = _judged(rows.where("not gone")).select(*COLUMNS)
    sizes = live.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    over = materialize(sizes.where((F.col("n") > most_rows) | (F.col("size") > most_bytes)).select("key"), "long-keys")
    some = not over.isEmpty()
    # Of dropped rows one marker a conversation is enough to name it.
    marks = rows.where("gone").groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    marks = marks.select("key", "conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(True).alias("gone"), F.lit(3).alias("initial"), F.lit(1).alias("fault"))
    short = live.unionByName(marks)
    short = without_ids(short, over, "key") if some else short
    dealt = short.repartition(parts, "key").sortWithinPartitions("key", F.col("turn").asc_nulls_first(), "role", "text")
    done = dealt.mapInArrow(_repair_task(kind, turns), f"conv_id {conv.simpleString()}, {TURNS if turns else REPORT}")
    return done.unionByName(_long(only_ids(live, over, "key").drop("gone"), kind, conv.simpleString(), turns)) if some else done


def _prepared(rows: DataFrame) -> DataFrame:
    if "gone" in rows.columns:
        return rows.select("conv_id", "turn", "role", "text", "gone")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role"), said("text"), F.lit(False).alias("gone"))


def repair(rows: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per conversation: its faults, the least cost, the audit of edits, the digest of the repaired turns.

    ``rows``: conv_id, turn, role, text, or what ``damaged`` returns.
    """
    return _repair(_prepared(rows), False, most_rows, most_bytes)


def repaired_turns(rows: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The repaired conversations: conv_id, place, edit (K, R or I), role, text."""
    return _repair(_prepared(rows), True, most_rows, most_bytes)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))

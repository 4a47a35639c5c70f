"""Operator 2, toxicity by a weighted finite-state pattern grammar.

Words map to classes (insult, threat, target, negation, report, other). Small
transducers over classes are composed: a report frame ("they wrote that ...")
and a negation in front of an insult pass the clause on with a lower weight, a
target next to an insult or a threat with a higher one. The composed machine is
one table (state, class) -> (state, weight); it reads each clause once and
emits the clause's weight and kind. Text outside matched clauses adds nothing.

Insults of the grammar come from a short public list and from labelled rows:
words, and stems of 3 to 8 letters for languages that inflect, whose document
frequency among toxic rows stands out; the logarithm of how far is the weight. A logistic model
over the clause weights of a document turns them into the score. Both are fitted
on at most ``SAMPLE`` labelled rows whose crc32(doc_id) mod 5 is not 0, the ones
with the smallest hashes, so that a larger input is not fitted longer.

The transducers' weights order the kinds of hits; how much each kind counts (clause
weight, insults, threats, softened hits) is fitted by the logistic model.

Empty and null texts have no clause and get the model's base score; texts of any
length are read whole. Labels that are null or neither 0 nor 1 are left out of the
fit, and of several labels of one document the toxic one counts; without labels of
both kinds the public list and fixed weights remain. Repeated rows each get their
row, rows of one id are scored by their own text, and a null id is never held out.
``scored`` reads doc_id and text only; ``drop_toxic`` returns further columns
whatever their names (but ``__score``, its own). An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import carried, materialize, only_ids

#: Labelled rows that the fit reads at most.
SAMPLE = 20_000
#: Learned insults: toxic documents that hold one at least (rows and share), toxic to clean rate, clean to toxic count.
LEAST_DOCS, LEAST_SHARE, LEAST_LIFT, MOST_CLEAN = 5, 0.01, 8.0, 0.15
STEMS = (8, 7, 6, 5, 4, 3)
#: The logarithm of the toxic to clean rate at which a learned mark weighs as much as a public one.
FULL_LIFT = 4.0

INSULT = frozenset("idiot idiots moron morons stupid imbecile scum trash garbage loser losers pathetic worthless disgusting clown vermin filth coward parasite dumb pig idiota estúpido estúpida imbécil basura escoria dummkopf idiotin abschaum versager connard crétin ordure salaud".split())
THREAT = frozenset("kill hurt destroy beat crush shoot stab burn strangle murder matar töten tuer".split())
TARGET = frozenset("you your yours he she him her they them these those people yourself yourselves himself herself themselves tu usted du sie ihr vous eux".split())
NEGATION = frozenset("not never no nobody without isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais nunca sin".split())
REPORT = frozenset("said says wrote called claimed reported quoted accused according dijo sagte schrieb dit écrit".split())

OTHER, C_INSULT, C_THREAT, C_TARGET, C_NEGATION, C_REPORT = range(6)
#: Weights that the composed transducers multiply into an insult or a threat.
BARE, AIMED, DENIED, REPORTED, THREATENED = 1.0, 1.5, 0.3, 0.4, 2.0
#: Words between a threat and its target.
REACH = 4

#: Clauses end at these signs; a colon ends none after a word of reporting: what follows is what was said.
CLAUSE = re.compile(rf"[.!?;\n\r。！？]+|(?<!{')(?<!'.join(sorted(REPORT, key=lambda w: (-len(w), w)))}):+(?=\s|$)")
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


@dataclass(frozen=True)
class Transducer:
    """States 0..n-1 from 0; (state, class) -> next state, and the weight that reading the class emits."""

    n: int
    step: dict[tuple[int, int], int] = field(default_factory=dict)
    weight: dict[tuple[int, int], float] = field(default_factory=dict)

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same classes side by side; weights multiply (1 where none is given)."""
        step, weight = {}, {}
        for a in range(self.n):
            for b in range(other.n):
                for c in range(6):
                    step[a * other.n + b, c] = self.step.get((a, c), a) * other.n + other.step.get((b, c), b)
                    weight[a * other.n + b, c] = self.weight.get((a, c), 1.0) * other.weight.get((b, c), 1.0)
        return Transducer(self.n * other.n, step, weight)


def _window(trigger: int, length: int, weight: float, classes: tuple[int, ...]) -> Transducer:
    """For ``length`` words after ``trigger``, ``classes`` weigh ``weight`` times as much."""
    step = {(0, trigger): length}
    for s in range(1, length + 1):
        step |= {(s, c): s - 1 for c in range(6)} | {(s, trigger): length}
    return Transducer(length + 1, step, {(s, c): weight for s in range(1, length + 1) for c in classes})


def grammar() -> Transducer:
    # An insult weighs by itself, a threat when its target follows within a few words: "kill all of you".
    step = {(s, c): max(s - 1, 0) for s in range(REACH + 1) for c in range(6)} | {(s, C_THREAT): REACH for s in range(REACH + 1)} | {(s, C_TARGET): 0 for s in range(1, REACH + 1)}
    weight = {(s, c): 0.0 for s in range(REACH + 1) for c in range(6)} | {(s, C_INSULT): BARE for s in range(REACH + 1)} | {(s, C_TARGET): THREATENED for s in range(1, REACH + 1)}
    hit = Transducer(REACH + 1, step, weight)
    aimed = _window(C_TARGET, 3, AIMED, (C_INSULT,))
    denied = _window(C_NEGATION, 4, DENIED, (C_INSULT, C_TARGET))
    reported = Transducer(2, {(0, C_REPORT): 1}, {(1, C_INSULT): REPORTED, (1, C_TARGET): REPORTED})
    return hit.compose(aimed).compose(denied).compose(reported)


class Grammar:
    """The composed machine as arrays, with its words and the weights of learned marks; a stem is written "abcd*"."""

    def __init__(self, marks: dict[str, float] | None = None):
        machine = grammar()
        self.step = np.array([[machine.step[s, c] for c in range(6)] for s in range(machine.n)]).tolist()
        self.weight = np.array([[machine.weight[s, c] for c in range(6)] for s in range(machine.n)]).tolist()
        marks = (marks or {}) | dict.fromkeys(INSULT, 1.0)
        self.stems = {w[:-1]: x for w, x in marks.items() if w.endswith("*")}
        self.words = {w: (C_INSULT, x) for w, x in marks.items() if not w.endswith("*")}
        self.words |= {w: (k, 1.0) for k, words in ((C_REPORT, REPORT), (C_NEGATION, NEGATION), (C_TARGET, TARGET), (C_THREAT, THREAT)) for w in words}
        self.hot = frozenset(w[:3] for w in THREAT | marks.keys())

    def read(self, w: str) -> tuple[int, float]:
        """The class of a word, and the weight of its mark."""
        if got := self.words.get(w):
            return got
        for n in STEMS:
            if len(w) > n and (x := self.stems.get(w[:n])):
                return C_INSULT, x
        return OTHER, 0.0

    def clause(self, words: list[str]) -> tuple[float, int, int, int]:
        """Weight, and the numbers of insults, threats and softened hits of one clause."""
        state, total, insults, threats, soft = 0, 0.0, 0, 0, 0
        for w in words:
            c, x = self.read(w)
            if got := self.weight[state][c]:
                total, soft = total + got * x, soft + (got < BARE)
                insults, threats = insults + (c == C_INSULT), threats + (c == C_TARGET)
            state = self.step[state][c]
        return total, insults, threats, soft

    def features(self, text: str | None) -> list[float]:
        """Of one whole text: clause weights, squashed and per word, and counts of hits."""
        low = (text or "").lower().replace("’", "'")
        weight, insults, threats, soft, clauses, strongest = 0.0, 0, 0, 0, 0, 0.0
        if not self.hot.isdisjoint({w[:3] for w in set(WORD.findall(low))}):
            for part in CLAUSE.split(low):
                words = WORD.findall(part)
                if not self.hot.isdisjoint(w[:3] for w in words):
                    w, i, t, s = self.clause(words)
                    weight, insults, threats, soft, strongest = weight + w, insults + i, threats + t, soft + s, max(strongest, w)
                    clauses += w > 0
        length = 1 + len(low) / 6
        return [math.log1p(weight), min(weight, 4.0), 100 * weight / length, math.log1p(clauses), float(weight >= 1), float(threats > 0), float(insults > soft), strongest, math.log1p(insults), math.log1p(threats), math.log1p(soft)]


N_FEATURES = 11
#: Without labels: an aimed or a second hit passes 0.5.
FIXED = np.array([-3.0, 1.5, 1.0, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0])


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled rows: those of the ids with the smallest hashes, and if shared ids bring more, of these the smallest hashes of texts."""
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = materialize(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "label")
    texts = only_ids(docs.select("doc_id", "text"), chosen.select("doc_id"))
    rows = materialize(texts.join(chosen, "doc_id").select("text", "toxic", F.monotonically_increasing_id().alias("row")), "labelled")
    if rows.count() > sample:
        few = rows.select(F.xxhash64("text").alias("h"), "row").orderBy("h", "row").limit(sample).select("row")
        rows = materialize(rows.join(few, "row"), "labelled")
    return rows.select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Grammar, np.ndarray]:
    """The grammar with learned insults and the weights of the logistic model."""
    rows = sampled(docs, labels, sample)
    n0, n1 = (rows.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first() or (0, 0))
    if not n0 or not n1:
        return Grammar(), FIXED
    # Each half's features use marks found in the other half, so that the model sees them as new rows will.
    rows = rows.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)))
    sizes = {(r.half, r.toxic): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}
    found = _mark_counts(rows)
    other = {h: Grammar(_marks(found, [1 - h], sizes)) for h in (0, 1)}

    def run(batches):
        for b in batches:
            x = np.array([other[h].features(t) for t, h in zip(b.column("text").to_pylist(), b.column("half").to_pylist(), strict=True)]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("toxic")] + [pa.array(x[:, i]) for i in range(N_FEATURES)], names=["toxic", *(f"f{i}" for i in range(N_FEATURES))])

    schema = "toxic int, " + ", ".join(f"f{i} double" for i in range(N_FEATURES))
    table = rows.select("text", "toxic", "half").mapInArrow(run, schema).toPandas().to_numpy()  # at most ``sample`` rows
    return Grammar(_marks(found, [0, 1], sizes)), logistic(table[:, 1:], table[:, 0])


def _mark_counts(rows: DataFrame) -> DataFrame:
    """Documents of each half and label that hold a word or stem; only those of LEAST_DOCS toxic ones or more."""
    words = F.array_distinct(F.expr(r"regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}]{3,}', 0)"))
    stem = lambda n: F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))
    marks = F.explode(F.array_distinct(F.concat(words, *map(stem, STEMS)))).alias("w")
    number = [F.count_if(F.col("half") == h).alias(f"h{h}") for h in (0, 1)]
    toxic = rows.where("toxic = 1").select(marks, "half").groupBy("w").agg(*number).where(F.col("h0") + F.col("h1") >= LEAST_DOCS)
    toxic = materialize(toxic, "marks")  # bounded by the sample
    clean = rows.where("toxic = 0").select(marks, "half").join(F.broadcast(toxic.select("w")), "w", "left_semi").groupBy("w").agg(*number)
    count = lambda t, h: F.coalesce(F.col(f"{t}.h{h}"), F.lit(0))
    both = toxic.alias("t").join(clean.alias("c"), "w", "left")
    return materialize(both.select("w", *(count(t, h).alias(f"{t}{h}") for t in "tc" for h in (0, 1))), "marks")


def _marks(found: DataFrame, halves: list[int], sizes: dict) -> dict[str, float]:
    n1, n0 = (sum(sizes.get((h, y), 0) for h in halves) for y in (1, 0))
    t, c = (sum((F.col(f"{k}{h}") for h in halves[1:]), F.col(f"{k}{halves[0]}")) for k in "tc")
    lift = ((t + 0.5) / (n1 + 1)) / ((c + 0.5) / (n0 + 1))
    rows = found.select("w", t.alias("t"), c.alias("c"), lift.alias("lift"))
    rows = rows.where((F.col("t") >= max(LEAST_DOCS * len(halves) / 2, LEAST_SHARE * n1)) & (F.col("lift") >= LEAST_LIFT) & (F.col("c") <= MOST_CLEAN * F.col("t")))
    return {r.w: min(1.0, math.log(r.lift) / FULL_LIFT) for r in rows.collect()}  # of the sample, each in LEAST_SHARE of its toxic documents at least


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method for a ridge logistic regression."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, eye = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + eye, x.T @ (y - p) - eye @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, gram: Grammar, weights: np.ndarray) -> DataFrame:
    """``docs`` with the column ``__score``; all columns pass through the Arrow task."""

    def run(batches):
        for b in batches:
            x = np.array([gram.features(t) for t in b.column("text").to_pylist()]).reshape(-1, N_FEATURES)
            p = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, "__score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__score", DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    gram, weights = fit(docs, labels)
    rows = score(docs.select("doc_id", "text"), gram, weights)
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more."""
    gram, weights = fit(docs, labels)
    return carried(docs, ("doc_id", "text"), lambda rows: score(rows, gram, weights).where("__score < 0.5").drop("__score"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

"""Operator 12, an audit of how filters interact, over the trie of their permutations.

Each document is judged once: bit i of ``fails`` says that it fails filter i. The trie of
all orders of k filters has k! leaves, but what survives a prefix doesn't depend on the
prefix's order, so a state is the set of filters applied (2^k of them). States are
visited depth first: a state's survivors are filtered from its parent's persisted frame
and persisted themselves while their own branches run; one grouped count of each state
gives what every next filter removes from these very survivors (one row a part and edge),
and a state met again on another path is taken from memory (the counts already written).
The orders are then read along the trie's edges.

A document fails a duplicate filter if any row of a smaller id has its text; the texts'
digests go through the two Bloom passes of operator 7, so only those that may repeat
shuffle, and a text that a third of all rows share is joined by broadcast of its one row.

Null texts count as empty, a null part as the empty string. Rows without an id have no
smaller id and are no smaller one, and have no labels. Rows that share an id and text
aren't copies of each other. A label holds if any row of ``labels`` of that id has it; null
labels don't hold. Repeated rows count each. Texts of any length are read whole. Columns other
than doc_id, text and the part's are not read, whatever their names. An empty table has
no parts and gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, delete_path, join_spread, materialize, release, scratch_path
from .exact_dedup import mark_repeated

LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT, SIGNS = 200, 50, 3, "[#$%&*|]"
#: The filter of repeated texts is not a test of one text.
REPEATS = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides."""
    words = F.array_remove(F.split(text, SPACES), "")
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MOST_CAPITALS_PERCENT * F.length(text),
        "D": text.rlike(SIGNS),
    }


def _repeated(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, sha and others) with ``copy``: whether a smaller id has the same digest."""
    names = [c for c in rows.columns if c != "sha"]
    split = mark_repeated(rows, "sha", rows.count())
    again = materialize(split.where("maybe").drop("maybe"), "again")
    groups = materialize(again.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("group_size")), "group")
    joined = join_spread(again, groups, "sha", "group_size", again.count())
    return split.where("not maybe").select(*names, F.lit(False).alias("copy")).unionByName(joined.select(*names, F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("copy")))


def verdicts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> tuple[DataFrame, str]:
    """One row per document: part, fails (bits in the order of the returned letters), good, toxic."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tests = text_filters(text)
    letters = "".join(tests) + REPEATS
    bits = sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests.values())), F.lit(0))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), bits.alias("fails"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"))
    rows = _repeated(materialize(rows, "verdict"))
    rows = rows.select("doc_id", "part", (F.col("fails") + F.when(F.col("copy"), 1 << len(tests)).otherwise(0)).alias("fails"))
    held = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(held("quality").alias("good"), held("toxic").alias("toxic"))
    no = F.lit(False)
    named = rows.where("doc_id is not null").join(marks, "doc_id", "left").select("part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return named.unionByName(rows.where("doc_id is null").select("part", "fails", no.alias("good"), no.alias("toxic"))), letters


def trie_edges(rows: DataFrame, letters: str) -> DataFrame:
    """Depth first over all states of the trie: part, state, survivors, and arrays of what each filter removes from them (null for those applied)."""
    spark, path, met = rows.sparkSession, scratch_path(rows.sparkSession, "edges"), set()

    def counted(state: int) -> list[Column]:
        fails = [F.lit(None).cast("boolean") if state >> i & 1 else (F.col("fails").bitwiseAND(1 << i) != 0) for i in range(len(letters))]
        lost = lambda also: F.array(*(F.count_if(f & also) if not state >> i & 1 else F.lit(None).cast("long") for i, f in enumerate(fails)))
        return [F.count(F.lit(1)).alias("survivors"), lost(F.lit(True)).alias("removed"), lost(F.col("good")).alias("good_lost"), lost(F.col("toxic")).alias("toxic_lost")]

    def visit(state: int, survivors: DataFrame) -> None:
        met.add(state)
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        survivors.groupBy("part").agg(*counted(state)).withColumn("state", F.lit(state)).write.mode("append").parquet(path)
        for i in range(len(letters)):
            if not state >> i & 1 and state | 1 << i not in met:
                visit(state | 1 << i, survivors.where(F.col("fails").bitwiseAND(1 << i) == 0))
        survivors.unpersist()

    visit(0, rows)
    return spark.read.schema("part string, survivors long, removed array<long>, good_lost array<long>, toxic_lost array<long>, state int").parquet(path)


def orders(letters: str) -> list[tuple]:
    """filter_order, step (from 1), number of the filter, state before it: a row for each step of each permutation."""
    place = {c: i for i, c in enumerate(letters)}
    return [("".join(p), k + 1, place[c], sum(1 << place[x] for x in p[:k])) for p in permutations(letters) for k, c in enumerate(p)]


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    rows, letters = verdicts(docs, labels, part)
    rows = materialize(rows, "judged")
    edges = trie_edges(rows, letters)
    release(rows)
    # A part where a state has no survivors has no row for it: all edges of every part, zeros where nothing is left.
    size = len(letters)
    every = edges.where("state = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << size) - 1))).alias("state"))
    edges = every.join(edges, ["part", "state"], "left").select("part", "state", F.coalesce("survivors", F.lit(0)).alias("survivors"), F.posexplode(F.coalesce(F.arrays_zip("removed", "good_lost", "toxic_lost"), F.array_repeat(F.struct(*(F.lit(0).cast("long").alias(c) for c in ("removed", "good_lost", "toxic_lost"))), size))).alias("filter", "lost"))
    free = F.expr("shiftright(state, filter) & 1") == 0
    edges = materialize(edges.where(free).select("part", "state", "filter", "survivors", "lost.*"), "edge")
    # In k! orders a filter meets state s in |s|! (k - 1 - |s|)! of them.
    weight = F.element_at(F.array(*(F.lit(factorial(n) * factorial(size - 1 - n)).cast("long") for n in range(size))), F.bit_count("state").cast("int") + 1)
    whole = (1 << size) - 1
    alone = F.col("state") == F.lit(whole) - F.expr("shiftleft(1, filter)")
    own = edges.groupBy("part", "filter").agg(F.sum(F.when(F.col("state") == 0, F.col("removed"))).alias("fails"), F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"), F.sum(weight * F.col("removed")).alias("shapley"))
    steps = F.broadcast(spark.createDataFrame(orders(letters), "filter_order string, step int, filter int, state int"))  # k * k! rows
    return edges.join(own, ["part", "filter"]).join(steps, ["state", "filter"]).select(
        "part", "filter_order", "step",
        (F.col("survivors") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
f AS (SELECT part, doc_id,
        len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
        100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, [a, b, c, d, e] AS fails, a::int + b::int + c::int + d::int + e::int AS n, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, n, good, toxic, count(*) AS k FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, [p.i, q.i, r.i, s.i, t.i] AS idx FROM x p, x q, x r, x s, x t
      WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
s AS (SELECT filter_order, idx, unnest([1, 2, 3, 4, 5]) AS step FROM o),
j AS (SELECT g.*, filter_order, step, idx[step] AS own, fails[idx[step]] AS bad, len(list_filter(idx[1:step - 1], lambda z: fails[z])) > 0 AS gone FROM g, s),
r AS (SELECT part, filter_order, step, any_value(own) AS own,
        sum(CASE WHEN NOT gone AND NOT bad THEN k ELSE 0 END)::bigint AS kept, sum(CASE WHEN NOT gone AND bad THEN k ELSE 0 END)::bigint AS removed,
        sum(CASE WHEN gone AND bad THEN k ELSE 0 END)::bigint AS redundant, sum(CASE WHEN bad AND n = 1 THEN k ELSE 0 END)::bigint AS unique_fails,
        sum(CASE WHEN NOT gone AND bad AND good THEN k ELSE 0 END)::bigint AS good_lost, sum(CASE WHEN NOT gone AND bad AND toxic THEN k ELSE 0 END)::bigint AS toxic_lost
      FROM j GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::bigint AS shapley FROM r
"""

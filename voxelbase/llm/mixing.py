"""Operator 8, mixing sources to target weights by temperature.

A source's weight is its token share to the power ``alpha``, normalised; alpha 1
keeps the shares, 0 makes sources equal. Bisection finds the largest alpha that
meets the target: weights of at least ``entropy`` (in nats), or no source
repeated more than ``repeats`` times. Each job is one aggregate over the source
table, which stays distributed; the driver sees a few numbers.

The weights are realised in blocks. A source's documents fall into blocks of
about ``block_tokens`` by a keyed hash, and a pass over a source (an epoch) is a
keyed permutation of its blocks. Whole epochs go to every document; the last,
partial epoch takes blocks in order until the source's token budget is spent,
and cuts inside one block only. Ordering therefore never holds more than one
block, or one source's list of blocks.

Without ``budget`` the budget is the smallest at which every source is seen at
least once, so no document is lost; a given budget may leave documents out, which
is the point of it.

A null source is a source of its own; null and empty texts have no tokens and
come along with their source's whole epochs. Equal rows (by id and text) have one
key and are taken or left together; of rows with one key a smaller id comes first,
a null id before all. Texts of any length count whole; words stand in for tokens
unless a column of token counts is named. Other columns pass through
``with_copies`` whatever their names. An empty table gives no rows. DataFrame
functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: Production parameters: repeats allowed, tokens in a block, halvings of the bisection and how many a job does.
REPEATS, BLOCK_TOKENS, STEPS, LEVELS, SEED = 4.0, 1_000_000, 40, 4, 17
#: Sources whose plan is broadcast; running sums over blocks go by 2^RANGE_BITS ranges of their draw.
MOST_SOURCES, RANGE_BITS, LOW = 100_000, 8, -(2**63)


def word_count(text: str = "text"):
    """Words of the whole text."""
    t = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.translate(t, " ", "")) + 1).cast("long")


def temperature(shares: DataFrame, entropy: float | None = None, repeats: float | None = REPEATS, steps: int = STEPS) -> float:
    """The largest alpha in [0, 1] that meets the target over (share); 0 if none does.

    Entropy falls and repeats fall as alpha rises, so for a limit on repeats the
    smallest alpha is sought: the flattest mix that the limit allows.
    """
    p = F.col("share")

    def measure(alphas: list[float]) -> list[bool]:
        """Whether each alpha meets the target, of one aggregate."""
        sums = []
        for a in alphas:
            if entropy is not None:  # of the normalised powers
                power = F.pow(p, F.lit(a))
                sums += [F.sum(power), F.sum(power * F.lit(a) * F.log(p))]
            else:  # copies of a source, where each is seen at least once
                sums += [F.max(F.pow(p, F.lit(a - 1))), F.min(F.pow(p, F.lit(a - 1)))]
        got = shares.agg(*sums).first()
        pairs = list(zip(got[::2], got[1::2], strict=True))
        return [math.log(x) - y / x >= entropy if entropy is not None else x / y <= repeats for x, y in pairs]

    # Entropy: good below the alpha sought. Repeats: good above it.
    below, above = measure([0.0, 1.0])
    if entropy is not None and above:
        return 1.0
    if entropy is None and below:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(-(-steps // LEVELS)):  # LEVELS halvings for one job
        grid = [low + (high - low) * i / 2**LEVELS for i in range(1, 2**LEVELS)]
        keep = [g == (entropy is not None) for g in measure(grid)]  # True: the alpha sought lies higher
        k = keep.index(False) if False in keep else len(grid)
        low, high = (grid[k - 1] if k else low), (grid[k] if k < len(grid) else high)
    return low if entropy is not None else high


def _order(seed: int):
    """The keyed order of documents inside their block, and their block's draw."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def _turn(seed: int):
    """A block's place in its source's permutation is the rank of this draw."""
    return F.xxhash64(F.lit(seed + 1), "source", "block")


def plan_sources(rows: DataFrame, entropy: float | None, repeats: float | None, budget: int | None, block_tokens: int) -> DataFrame | None:
    """Per source of (source, n_tokens): weight, epochs, rest (tokens of its last epoch) and blocks; None where no row has a token."""
    sources = materialize(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return None
    some = sources.where("tokens > 0").select((F.col("tokens") / F.lit(total)).alias("share"))
    alpha = temperature(some, entropy, repeats)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(total), F.lit(alpha))).otherwise(0.0)
    norm, cover = sources.agg(F.sum(power), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / power))).first()
    spent = float(budget) if budget is not None else cover * norm
    # Tokens of each source, cut to whole epochs and a rest; rounding keeps 1.0 from falling below one epoch.
    quota = F.round(F.lit(spent) * F.col("weight")).cast("long")
    sources = sources.withColumn("weight", power / F.lit(norm)).withColumn("quota", quota)
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1))
    sources = sources.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.col("quota") - F.col("epochs") * F.col("tokens"))
    return materialize(sources.withColumn("blocks", F.ceil(F.greatest(F.col("tokens"), F.lit(1)) / F.lit(block_tokens)).cast("long")), "sources")


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with their source's columns; the sources are broadcast where they are ``MOST_SOURCES`` at most."""
    table = sources.withColumnRenamed("source", "__s")
    table = F.broadcast(table) if table.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES else table
    return rows.join(table, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")


def walk_blocks(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """(source, block, turn, position, left): each block's place in its source's permutation, and the tokens left for it.

    Running sums in two levels: ranges of the draw first, then inside each range, so
    that no task holds all blocks of a large source.
    """
    keyed = _with_sources(rows, sources).withColumn("block", F.pmod("key", "blocks"))
    sums = keyed.groupBy("source", "block").agg(F.sum("n_tokens").alias("sum"), F.first("rest").alias("rest"))
    sums = materialize(sums.withColumn("turn", _turn(seed)).withColumn("range", F.shiftright("turn", 64 - RANGE_BITS)), "blocks")
    ranges = sums.groupBy("source", "range").agg(F.sum("sum").alias("all_tokens"), F.count(F.lit(1)).alias("all_blocks"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # 2^RANGE_BITS rows at most
    ranges = ranges.select(F.col("source").alias("__s"), F.col("range").alias("__r"), F.coalesce(F.sum("all_tokens").over(earlier), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum("all_blocks").over(earlier), F.lit(0)).alias("blocks_before"))
    rows = sums.join(ranges, F.col("source").eqNullSafe(F.col("__s")) & (F.col("range") == F.col("__r")))
    inside = Window.partitionBy("source", "range").orderBy("turn", "block")
    position = F.col("blocks_before") + F.row_number().over(inside)
    before = F.col("tokens_before") + F.coalesce(F.sum("sum").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.col("rest") - before
    return materialize(rows.select("source", "block", "turn", position.cast("int").alias("position"), "sum", left.alias("left")), "blocks")


def _cut(rows: DataFrame, walked: DataFrame, seed: int) -> DataFrame:
    """Per source the block that its last epoch cuts, and the last document taken from it: (source, cut_turn, cut_block, cut_key, cut_id).

    Sources whose rest ends between blocks have their first untaken block and no document of it.
    """
    end = walked.where("left < sum").groupBy("source").agg(F.min(F.struct("position", "turn", "block", "left")).alias("c"))
    end = end.select(F.col("source").alias("__s"), F.col("c.turn").alias("cut_turn"), F.col("c.block").alias("cut_block"), F.col("c.left").alias("left"))
    inside = rows.join(F.broadcast(end) if end.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES else end, F.col("source").eqNullSafe(F.col("__s")))
    inside = inside.where((F.pmod("key", "blocks") == F.col("cut_block")) & (F.col("left") > 0)).select("source", "key", "doc_id", "n_tokens", "left")
    walk = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # one block of each source
    taken = inside.withColumn("used", F.sum("n_tokens").over(walk)).where("used <= left")
    last = taken.groupBy("source").agg(F.max(F.struct("key", F.coalesce("doc_id", F.lit(LOW)).alias("id"))).alias("l"))
    out = end.drop("left").join(last.withColumnRenamed("source", "__t"), F.col("__s").eqNullSafe(F.col("__t")), "left")
    return materialize(out.select(F.col("__s").alias("source"), "cut_turn", "cut_block", F.col("l.key").alias("cut_key"), F.col("l.id").alias("cut_id")), "cuts")


def with_copies(docs: DataFrame, entropy: float | None = None, repeats: float | None = REPEATS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, tokens: str | None = None, key: str | None = None) -> DataFrame:
    """``docs`` with copies (how often the row is taken), weight (of its source), n_tokens and block; rows taken never stay out.

    Texts don't shuffle: a row finds from its own key and its source's plan whether
    the last epoch takes it. ``tokens`` names a column of token counts; without it
    words are counted. ``key`` names a column that holds the order of the rows already.
    Columns of these names are replaced.
    """
    names = [c for c in docs.columns if c not in ("copies", "weight", "n_tokens", "block")]
    count = (F.col(tokens) if tokens else word_count()).cast("long")
    keyed = docs.select(*(F.col(f"`{c}`") for c in names), count.alias("__tokens"), (F.col(key) if key else _order(seed)).alias("__key"))
    rows = materialize(keyed.select("doc_id", "source", F.col("__tokens").alias("n_tokens"), F.col("__key").alias("key")), "mix")
    sources = plan_sources(rows, entropy, repeats, budget, block_tokens)
    out = [F.col(f"`{c}`") for c in names] + [F.col("__tokens").alias("n_tokens")]
    if sources is None:
        share = rows.select("source").distinct().count() or 1
        return keyed.select(*out, F.lit(1).cast("long").alias("copies"), F.lit(1.0 / share).alias("weight"), F.lit(0).cast("long").alias("block"))
    cuts = _cut(_with_sources(rows, sources.select("source", "blocks")), walk_blocks(rows, sources, seed), seed).withColumnRenamed("source", "__t")
    plan = sources.join(cuts, F.col("source").eqNullSafe(F.col("__t")), "left")
    plan = materialize(plan.select("source", *(F.col(c).alias(f"__{c}") for c in ("weight", "epochs", "rest", "blocks", "cut_turn", "cut_block", "cut_key", "cut_id"))), "plan")
    rows = _with_sources(keyed, plan).withColumn("__block", F.pmod("__key", "__blocks"))
    turn = F.xxhash64(F.lit(seed + 1), "source", "__block")
    whole = F.col("__cut_turn").isNull() | (turn < F.col("__cut_turn")) | ((turn == F.col("__cut_turn")) & (F.col("__block") < F.col("__cut_block")))
    before = (F.col("__key") < F.col("__cut_key")) | ((F.col("__key") == F.col("__cut_key")) & (F.coalesce("doc_id", F.lit(LOW)) <= F.col("__cut_id")))
    part = (F.col("__block") == F.col("__cut_block")) & F.coalesce(before, F.lit(False))
    extra = ((F.col("__rest") > 0) & (whole | part)).cast("long")
    return rows.select(*out, (F.col("__epochs") + extra).alias("copies"), F.col("__weight").alias("weight"), F.col("__block").alias("block")).where("copies > 0")


def mix(docs: DataFrame, entropy: float | None = None, repeats: float | None = REPEATS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, tokens: str | None = None) -> DataFrame:
    """Per selected document: doc_id, source, n_tokens, copies, weight (of its source), block, position (of the block in its source's permutation)."""
    # Words are counted once: the result has no texts, so the counted rows stand for the documents.
    count = (F.col(f"`{tokens}`") if tokens else word_count()).cast("long")
    rows = materialize(docs.select("doc_id", "source", count.alias("__n"), _order(seed).alias("__order")), "counted")
    keyed = materialize(with_copies(rows, entropy, repeats, budget, block_tokens, seed, "__n", "__order").select("doc_id", "source", "n_tokens", "copies", "weight", "block"), "mix")
    # Positions number the blocks that some selected document is in, in the order of their draw.
    blocks = keyed.select("source", "block").distinct().withColumn("turn", _turn(seed)).withColumn("range", F.shiftright("turn", 64 - RANGE_BITS))
    blocks = materialize(blocks, "blocks")
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = blocks.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n")).select(F.col("source").alias("__s"), F.col("range").alias("__r"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "range").orderBy("turn", "block")
    blocks = blocks.join(ranges, F.col("source").eqNullSafe(F.col("__s")) & (F.col("range") == F.col("__r")))
    blocks = materialize(blocks.select(F.col("source").alias("__s"), F.col("block").alias("__b"), (F.col("before") + F.row_number().over(inside)).cast("int").alias("position")), "positions")
    return keyed.join(blocks, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b"))).drop("__s", "__b")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))

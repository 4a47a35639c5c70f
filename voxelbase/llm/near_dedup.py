"""Operator 5, MinHash near-duplicates with odd sketches.

A document's set is its distinct shingles of five words (lower-cased A-Z). Texts
with equal sets are one class. Each class has MinHash samples: bands of them
make buckets (32 of 6 at 85 %, 38 of 5 at 80 %), and the samples folded into a
parity bitmap of 512 bits make an odd sketch; the population count of two sketches' XOR estimates their
similarity, so a bucket's pairs are dropped or verified without their sets.

Pairs are tried in two passes. First every member of a bucket meets the
bucket's smallest class, a number of pairs that grows with the rows. What full
sets confirm joins into components. Then only buckets that still span several
components compare members of different components, in blocks of bounded size.
So a large group of near copies collapses in the first pass. Bands and the
sketch's limit follow from the threshold: a pair at it is missed with a chance
of at most ``LOSS`` for want of a shared band, and of at most ``LOSS`` by its sketches.

Null or blank texts have the empty set: n_shingles 0, no link, kept. Rows
without an id get no component and are kept. Rows that share an id are one
document, linked if any of its texts is; repeated rows each get their row. Texts
of any length are read whole, piece by piece. Ties: the smallest id names a
component. Columns other than doc_id and text are not read by ``near_groups``;
``drop_near_copies`` returns them whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, build_filter, carried, connected_components, filter_bits, join_spread, materialize, only_ids, test_filter, without_ids
from .hashing import Substrings, U, mix

WORDS = 5
SKETCH_BITS = 512
#: Samples of a class, unless bands of one sample need more.
SAMPLES = 192
#: Chance to miss a pair at the threshold, by the bands and by the sketches each.
LOSS = 3e-7
#: Members of a bucket that meet in one block.
BLOCK = 256
#: Shingles of a block's members together, unless one member has more.
BLOCK_SHINGLES = 400_000
PIECE = 1 << 20
MIN_PERCENT = 85

BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of ``b``, piece by piece."""
    hashes, starts, at = [], [], 0
    while at < len(b):
        end = at + PIECE
        if end < len(b):
            data = np.frombuffer(b, dtype=np.uint8, offset=at)
            cut = np.flatnonzero(BLANK[data[: end - at]])
            if not len(cut):  # a word longer than a piece
                cut = np.flatnonzero(BLANK[data])
            end = at + int(cut[-1] if len(cut) and cut[-1] < PIECE else cut[0]) + 1 if len(cut) else len(b)
        data = np.frombuffer(b[at:end], dtype=np.uint8)
        edge = np.diff(np.concatenate([[True], BLANK[data], [True]]).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        hashes.append(Substrings(data, 1)(first, last))
        starts.append(first + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


FACTORS = np.random.Generator(np.random.PCG64(77)).integers(0, 2**63, WORDS, dtype=np.uint64) * U(2) + U(1)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush():
        nonlocal size
        joined = b"\n".join(group)
        h, at = word_hashes(joined)
        ends = np.cumsum([len(x) + 1 for x in group])
        first = np.searchsorted(at, np.concatenate([[0], ends[:-1]]))
        last = np.append(first[1:], len(at))
        sums = sum(h[i : len(h) - WORDS + 1 + i] * FACTORS[i] for i in range(WORDS)) if len(h) >= WORDS else np.zeros(0, np.uint64)
        sums = mix(np.asarray(sums, dtype=np.uint64))
        for s, e in zip(first.tolist(), last.tolist(), strict=True):
            if e - s >= WORDS:
                out.append(np.unique(sums[s : e - WORDS + 1]))
            elif e > s:
                short = h[s:e] * FACTORS[: e - s]
                out.append(mix(np.array([short.sum(dtype=np.uint64) + U(e - s)], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        group.clear()
        size = 0

    for t in texts:
        b = (t or "").encode().lower()
        group.append(b)
        size += len(b)
        if size >= PIECE // 2:
            flush()
    if group:
        flush()
    return out


class Plan(NamedTuple):
    """Bands of samples, and the largest XOR population count of two sketches whose pair is verified."""

    bands: int
    depth: int
    limit: int


@cache
def plan(min_percent: int) -> Plan:
    """The deepest bands within ``SAMPLES`` and the lowest limit that keep ``LOSS`` at a similarity of ``min_percent``."""
    s = min(max(min_percent, 1), 99) / 100
    for depth in range(max(1, int(math.log(SAMPLES) / -math.log(s))), 0, -1):
        bands = math.ceil(math.log(LOSS) / math.log1p(-(s**depth)))
        if bands * depth <= SAMPLES:
            break
    # Each sample that differs flips two bits: the population count's distribution over their binomial number.
    n, k = bands * depth, np.arange(SKETCH_BITS + 1)
    count, total = (k == 0).astype(float), np.zeros(SKETCH_BITS + 1)
    for i in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(1 - s) + (n - i) * math.log(s)) * count
        for _ in range(2):
            count = np.append(0, (count * (SKETCH_BITS - k) / SKETCH_BITS)[:-1]) + np.append((count * k / SKETCH_BITS)[1:], 0)
    more = np.append(np.cumsum(total[::-1])[::-1], 0)  # chance of k or more
    return Plan(bands, depth, int(np.argmax(more <= LOSS)) - 1)


@cache
def _permutations(samples: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(99))
    return rng.integers(0, 2**31, samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, samples, dtype=np.uint32)


def min_hashes(shingles: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    a, b = _permutations(samples)
    low = np.full(samples, 0xFFFFFFFF, dtype=np.uint32)
    x = (shingles >> U(32)).astype(np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(low, ((x[i : i + 512, None] ^ b) * a).min(axis=0), out=low)
    return low


def signatures(sets: list[np.ndarray], bands: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n, bands) and odd sketches (n, SKETCH_BITS / 64) of non-empty sets."""
    n = bands * depth
    samples = np.array([min_hashes(s, n) for s in sets], dtype=np.uint64).reshape(-1, n)
    place = np.arange(n, dtype=np.uint64) << U(32)
    each = mix(samples | place)
    keys = mix(np.bitwise_xor.reduce((each * U(3)).reshape(-1, bands, depth), axis=2) + np.arange(bands, dtype=np.uint64))
    bits = (each >> U(55)).astype(np.int64) + np.arange(len(sets))[:, None] * SKETCH_BITS
    odd = (np.bincount(bits.ravel(), minlength=len(sets) * SKETCH_BITS) & 1).astype(np.uint8)
    return keys, np.packbits(odd.reshape(-1, SKETCH_BITS), axis=1).view(np.uint64)


def _lists(x: np.ndarray) -> pa.ListArray:
    flat = np.ascontiguousarray(x).view(np.int64).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, x.shape[1]), pa.int32()), pa.array(flat))


def _sketch(bands: int, depth: int):
    """(doc_id, text) to the number of shingles, a digest of the set, its band keys and its sketch."""

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                sets = shingle_sets(part.column("text").to_pylist())
                n = np.array([len(x) for x in sets])
                some = [x if len(x) else np.zeros(1, np.uint64) for x in sets]
                keys, sketch = signatures(some, bands, depth)
                digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), _lists(keys), _lists(sketch)], names=["doc_id", "n", "digest", "bands", "sketch"])

    return run


SIGNATURE = "doc_id long, n long, digest binary, bands array<long>, sketch array<long>"


def _verify(min_percent: int):
    """(u, v, text of u, text of v) to the pairs whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                left = shingle_sets(part.column("text_u").to_pylist())
                texts = part.column("text_v").dictionary_encode()
                right = shingle_sets(texts.dictionary.to_pylist())
                good = []
                for x, k in zip(left, texts.indices.to_pylist(), strict=True):
                    y = right[k]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(common > 0 and 100 * common >= min_percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v")], names=["u", "v"]).filter(pa.array(good))

    return run


def _close_members(min_percent: int, limit: int):
    """Two blocks of a bucket to the members that some member of another component is close to, by sketch and size."""

    def run(batches):
        for batch in batches:
            bucket, member = [], []
            for k, a, b, same in zip(batch.column("bucket").to_pylist(), batch.column("a"), batch.column("b"), batch.column("same").to_pylist(), strict=True):
                ids, comps, sizes, sketches = zip(*(((f := x.values.field)("id").to_numpy(), f("component").to_numpy(), f("n").to_numpy(), f("sketch").flatten().to_numpy().view(np.uint64).reshape(len(x), -1)) for x in (a, b)), strict=True)
                far = np.bitwise_count(sketches[0][:, None, :] ^ sketches[1][None, :, :]).sum(axis=2)
                small, large = np.minimum(sizes[0][:, None], sizes[1]), np.maximum(sizes[0][:, None], sizes[1])
                ok = (far <= limit) & (comps[0][:, None] != comps[1]) & (100 * small >= min_percent * large)
                found = np.unique(np.concatenate([ids[0][ok.any(axis=1)], ids[1][ok.any(axis=0)]]))
                bucket.append(np.full(len(found), k))
                member.append(found)
            if bucket:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bucket)), pa.array(np.concatenate(member))], names=["bucket", "id"])

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of sorted sets, by products of membership tables over their common elements."""
    common = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    out = np.zeros((len(a), len(b)), dtype=np.int64)

    def places(sets):
        at = [np.searchsorted(common, s[np.isin(s, common, assume_unique=True)]) for s in sets]
        return np.repeat(np.arange(len(sets)), [len(x) for x in at]), np.concatenate(at)

    (ra, ca), (rb, cb) = places(a), places(b)
    for s in range(0, len(common), columns):
        tables = []
        for n, r, c in ((len(a), ra, ca), (len(b), rb, cb)):
            own = (c >= s) & (c < s + columns)
            t = np.zeros((n, columns), dtype=np.float32)
            t[r[own], c[own] - s] = 1
            tables.append(t)
        out += (tables[0] @ tables[1].T).astype(np.int64)
    return out


def _block_links(min_percent: int):
    """Two blocks of a bucket to links between components that full sets confirm; of links that join the same components, one."""

    def run(batches):
        for batch in batches:
            u, v = [], []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                ids, comps = zip(*((x.values.field("id").to_numpy(), x.values.field("component").to_numpy()) for x in (a, b)), strict=True)
                sets = [[s.values.to_numpy().view(np.uint64) for s in x.values.field("shingles")] for x in (a, b)]
                both = overlaps(*sets)
                sizes = [np.array([len(s) for s in x]) for x in sets]
                ok = (both > 0) & (100 * both >= min_percent * (sizes[0][:, None] + sizes[1] - both)) & (comps[0][:, None] != comps[1])
                root: dict[int, int] = {}

                def find(c, root=root):
                    while (up := root.get(c, c)) != c:
                        root[c] = root.get(up, up)
                        c = up
                    return c

                for i, j in zip(*(x.tolist() for x in np.nonzero(ok)), strict=True):
                    p, q = find(int(comps[0][i])), find(int(comps[1][j]))
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        u.append(max(ids[0][i], ids[1][j]))
                        v.append(min(ids[0][i], ids[1][j]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _shingles(batches):
    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            sets = [x.view(np.int64) for x in shingle_sets(part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])


def _block_pairs(members: DataFrame, columns: list[str]) -> DataFrame:
    """Members of each bucket in blocks of bounded size, and every two blocks of a bucket as one row.

    Rows meet by (bucket, block), so a large bucket's blocks and pairs spread over many tasks.
    """
    members = materialize(members, "members")
    size = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("in_bucket"), F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    size = materialize(size, "bucket-size")
    rows = join_spread(members, size, "bucket", "in_bucket", members.count()).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    blocks = materialize(rows.groupBy("bucket", "part").agg(F.collect_list(F.struct(*columns)).alias("rows")), "blocks")
    here = blocks.select("bucket", "part")
    some = size.where("parts > 1").select("bucket", "parts")
    pairs = here.join(some, "bucket").select("bucket", F.col("part").alias("p"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("q"))
    one = here.join(some, "bucket", "left_anti").select("bucket", F.col("part").alias("p"), F.col("part").alias("q"))
    pairs = materialize(pairs.unionByName(one), "pairs")
    side = lambda p, x: blocks.select("bucket", F.col("part").alias(p), F.col("rows").alias(x))
    met = pairs.join(side("p", "a"), ["bucket", "p"]).join(side("q", "b"), ["bucket", "q"])
    return met.select("bucket", "a", "b", (F.col("p") == F.col("q")).alias("same"))


def _confirmed(docs: DataFrame, pairs: DataFrame, min_percent: int) -> DataFrame:
    ids = materialize(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "ids")
    texts = materialize(only_ids(docs.select("doc_id", "text").where("doc_id is not null"), ids), "texts").dropDuplicates()
    of = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    with arrow_rows(docs.sparkSession, 256):
        return materialize(pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "text_u", "text_v").mapInArrow(_verify(min_percent), "u long, v long"), "links")


def _shared_ids(rows: DataFrame) -> DataFrame:
    """Ids with rows of different sets; a filter of repeated ids keeps all others from the shuffle."""
    ids = rows.where("doc_id is not null").select("doc_id", F.coalesce("digest", F.lit(b"")).alias("digest"))
    bits = filter_bits(rows.count())
    maybe = test_filter(ids, "doc_id", build_filter(ids, "doc_id", bits, repeated=True), bits).where("maybe")
    return maybe.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")


def _joined_by_id(docs: DataFrame, min_percent: int) -> DataFrame:
    """``near_groups`` where ids are shared: rows are grouped by numbers of their own, then rows of one id are linked and each component takes its smallest id."""
    rows = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    numbered = rows.select(F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("doc_id"), "text")
    groups = materialize(near_groups(numbered, min_percent), "groups")
    named = groups.where("doc_id is not null").select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("component"))
    named = materialize(named.join(rows.select("row", "doc_id"), "row").select("doc_id", "n_shingles", "component"), "named")
    least = named.groupBy("doc_id").agg(F.min("component").alias("v"), F.max("component").alias("high")).where("v < high").drop("high")
    links = named.select("doc_id", F.col("component").alias("u")).distinct().join(least, "doc_id").where("u <> v").select("u", "v").distinct()
    moved = materialize(connected_components(links).where("id <> component").select(F.col("id").alias("component"), F.col("component").alias("to")), "moved")
    named = materialize(named.join(moved, "component", "left").select("doc_id", "n_shingles", F.coalesce("to", "component").alias("component")), "named")
    first = materialize(named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size")), "first")
    out = join_spread(named, first, "component", "size", named.count()).select("doc_id", "n_shingles", "component_id")
    nameless = groups.where("doc_id is null").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_groups(docs: DataFrame, min_percent: int = MIN_PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bands, depth, limit = plan(min_percent)
    with arrow_rows(docs.sparkSession, 1000):
        rows = materialize(docs.mapInArrow(_sketch(bands, depth), SIGNATURE), "signature")
    if not _shared_ids(rows).isEmpty():
        return _joined_by_id(docs, min_percent)

    # Classes of equal sets, each named by its smallest id.
    linked = rows.where("digest is not null and doc_id is not null")
    bits = filter_bits(rows.count())
    split = test_filter(linked.select("doc_id", "n", "digest"), "digest", build_filter(linked, "digest", bits, repeated=True), bits)
    again = materialize(split.where("maybe").select("doc_id", "digest"), "again")
    classes = materialize(again.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    copies = materialize(join_spread(again, classes, "digest", "copies", again.count()).select("doc_id", "rep").where("doc_id <> rep"), "copies")
    sketches = materialize(without_ids(linked, copies).select(F.col("doc_id").alias("id"), "n", "sketch", "bands"), "sketches")

    # Buckets of two classes or more.
    keys = sketches.select("id", F.explode("bands").alias("bucket"))
    bits = filter_bits(sketches.count() * bands, 8)
    keys = materialize(test_filter(keys, "bucket", build_filter(keys, "bucket", bits, repeated=True), bits).where("maybe").drop("maybe"), "keys")
    heads = materialize(keys.groupBy("bucket").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1"), "heads")
    buckets = materialize(join_spread(keys, heads, "bucket", "members", keys.count()), "buckets")
    sides = sketches.select("id", "n", "sketch")

    # Pass one: members and the head of their bucket.
    of = lambda c: sides.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    tried = materialize(buckets.where("id <> head").select(F.col("id").alias("u"), F.col("head").alias("v")).distinct(), "tried")
    far = sum((F.bit_count(F.col("s_u")[i].bitwiseXOR(F.col("s_v")[i])) for i in range(1, SKETCH_BITS // 64)), F.bit_count(F.col("s_u")[0].bitwiseXOR(F.col("s_v")[0])))
    close = tried.join(of("u"), "u").join(of("v"), "v").where((far <= limit) & (100 * F.least("n_u", "n_v") >= min_percent * F.greatest("n_u", "n_v")))
    links = _confirmed(docs, materialize(close.select("u", "v"), "close"), min_percent)
    comps = materialize(connected_components(links), "components")

    # Pass two: buckets that still span components.
    left = materialize(buckets.where("members > 2").select("bucket", "id", "members").join(comps, "id", "left").select("bucket", "id", "members", F.coalesce("component", "id").alias("component")), "left")
    mixed = left.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rows")).where("low < high")
    mixed = materialize(mixed.select("bucket", "rows"), "mixed")
    members = join_spread(left, mixed, "bucket", "rows", left.count()).drop("rows").join(sides, "id")
    with arrow_rows(docs.sparkSession, 32):
        met = _block_pairs(members, ["id", "component", "n", "sketch"]).mapInArrow(_close_members(min_percent, limit), "bucket long, id long")
        close = materialize(met.distinct(), "close")
    if not close.isEmpty():
        ids = materialize(close.select(F.col("id").alias("doc_id")).distinct(), "ids")
        with arrow_rows(docs.sparkSession, 1000):
            sets = only_ids(docs.select("doc_id", "text").where("doc_id is not null"), ids).distinct().mapInArrow(_shingles, "id long, shingles array<long>")
            sets = materialize(sets, "sets")
        members = close.join(left.select("bucket", "id", "component"), ["bucket", "id"]).join(sets, "id").withColumn("n", F.size("shingles"))
        with arrow_rows(docs.sparkSession, 4):
            more = materialize(_block_pairs(members, ["id", "component", "shingles"]).mapInArrow(_block_links(min_percent), "u long, v long").distinct(), "links")
        links = links.unionByName(more)
        comps = materialize(connected_components(links), "components")

    # Back to documents: id, its class, the class's component.
    moved = copies.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    moved = materialize(moved.unionByName(comps.select(F.col("id").alias("doc_id"), "component")).where("doc_id <> component").distinct(), "moved")
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(moved, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, min_percent: int = MIN_PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near copies: the smallest id, null ids last.

    Rows are grouped by a number of their own, so null and shared ids decide nothing but the order.
    """
    return carried(docs, ("doc_id", "text"), lambda rows: _drop_near_copies(rows, min_percent))


def _drop_near_copies(docs: DataFrame, min_percent: int) -> DataFrame:
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    groups = near_groups(rows.select(F.col("__row").alias("doc_id"), "text"), min_percent)
    moved = materialize(groups.where("not kept").select(F.col("doc_id").alias("__row"), F.col("component_id").alias("component")), "moved")
    members = materialize(moved.unionByName(moved.select(F.col("component").alias("__row"), "component").distinct()), "members")
    ids = only_ids(rows.select("__row", "doc_id"), members.select("__row"), "__row").join(members, "__row")
    first = ids.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first"))
    keep = materialize(first.select("first.__row"), "keep")
    return without_ids(rows, without_ids(members, keep, "__row"), "__row").select(*docs.columns)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))

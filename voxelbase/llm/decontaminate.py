"""Operator 4, benchmark decontamination by q-gram lemma filtering.

Texts are normalised alike (lower case, letters and digits, one space between
words). A region within ``edits`` of a passage of length m shares at least
m + 1 - q (edits + 1) q-grams with it, on diagonals at most ``edits`` apart. So
q-gram hits are counted in diagonal bands of twice that width that overlap by
half; bands that reach the count are verified by an alignment banded to the same
diagonals, which gives the exact distance.

Every item is searched as one passage, or above ``PASSAGE`` characters as passages
that overlap by half, and besides in short passages of ``LEAST`` characters, one
each ``STRIDE``. So any leaked run of ``LEAST`` + ``STRIDE`` - 1 = 79 normalised
characters (about 13 words) holds a short passage and is found if it is exact;
a shorter run may be missed. Items under ``LEAST`` characters are
found exactly, as whole words, however short they are.
Tasks cut the items into passages; these are read in blocks of about ``BLOCK_GRAMS``
characters, and the documents are scanned once for each block, so the index in a
task and what passes through the driver at once are bounded. Hits are counted per
band piece by piece, so a repetitive text of any length takes memory for its bands.

Null and empty texts match nothing; texts of any length are searched whole.
Repeated rows each get their rows; a null id stays null. Ties: of regions with
equally few edits the first is reported. ``contaminated`` reads doc_id, item_id and
text only; ``drop_contaminated`` returns further columns whatever their names. An
empty table of documents gives no rows, one of items no match.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, materialize
from .hashing import Substrings, U

GRAM = 10
#: Edits allowed in a passage, as a share of its length.
ERROR = 0.06
LEAST, STRIDE, PASSAGE = 60, 20, 400
BLOCK_GRAMS = 2_000_000
TABLE_BITS = 24
PIECE = 1 << 18
#: Pairs of equal q-grams that are counted at once.
PAIRS = 1 << 20


def normalise(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised text, and the place in the text that each comes from."""
    low = text or ""
    folded = low.lower()
    if len(folded) != len(low):  # letters whose lower case is longer keep their own form
        folded = "".join(c.lower() if len(c.lower()) == 1 else c for c in low)
    code = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    word = _is_word(code)
    keep = word | np.concatenate([[False], word[:-1]]) if len(code) else word
    at = np.flatnonzero(keep)
    return np.where(word, code, 32)[at].astype(np.uint32), at


def _is_word(code: np.ndarray) -> np.ndarray:
    known = (code < 128) & _ascii()[np.minimum(code, 127)]
    high = np.flatnonzero(code >= 128)
    if len(high):
        letters, where = np.unique(code[high], return_inverse=True)
        known[high] = np.array([unicodedata.category(chr(c))[0] in "LNM" for c in letters])[where]
    return known


@cache
def _ascii() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(128)])


def grams(code: np.ndarray, q: int = GRAM) -> np.ndarray:
    """A hash of each q-gram: its code points fold to a byte each, then a rolling polynomial."""
    if len(code) < q:
        return np.zeros(0, dtype=np.uint64)
    at = np.arange(len(code) - q + 1)
    return Substrings((code ^ (code >> np.uint32(8))).astype(np.uint8), 0)(at, at + q)


def budget(m: int, error: float = ERROR, q: int = GRAM) -> tuple[int, int]:
    """The edits allowed in a passage of length m, and the q-grams a region within them must share with it."""
    edits = min(int(error * m), (m - q) // q) if m >= LEAST else 0
    return edits, max(1, m + 1 - q * (edits + 1))


def words(code: np.ndarray) -> list[tuple[str, int]]:
    """The words of a normalised text, and where each ends."""
    out, at = [], 0
    for w in "".join(map(chr, code.tolist())).split(" "):
        at += len(w)
        if w:
            out.append((w, at))
        at += 1
    return out


class Passages:
    """A block of passages with their q-grams, sorted."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]], error: float = ERROR):
        self.item = [r[0] for r in rows]
        self.start = [r[1] for r in rows]
        self.code = [r[2] for r in rows]
        #: Passages without a q-gram, by their words.
        self.tiny: dict[tuple[str, ...], list[int]] = {}
        for p, c in enumerate(self.code):
            if len(c) < GRAM:
                self.tiny.setdefault(tuple(w for w, _ in words(c)), []).append(p)
        limits = np.array([budget(len(c), error) for c in self.code], dtype=np.int64).reshape(-1, 2)
        self.longest = max((len(c) for c in self.code), default=0)
        self.step, self.need = limits[:, 0] + 1, limits[:, 1]
        hashes = [grams(c) for c in self.code]
        owner = np.repeat(np.arange(len(rows)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if rows else np.zeros(0, np.int64)
        h = np.concatenate(hashes) if rows else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.owner, self.place = h[order], owner[order], place[order]
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.table[(self.hash >> U(64 - TABLE_BITS)).astype(np.int64)] = True

    def bands(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, band) of the bands that reach their passage's count, from hits counted piece by piece.

        A passage's half band k holds the diagonals from k * step to k * step + step - 1. Only the
        counters are kept, so a repetitive text takes memory for its bands and not for its pairs.
        """
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        far = len(code) + self.longest + 1
        for s in range(0, max(0, len(code) - GRAM + 1), PIECE):
            h = grams(code[s : s + PIECE + GRAM - 1])
            at = np.flatnonzero(self.table[(h >> U(64 - TABLE_BITS)).astype(np.int64)])
            h = h[at]
            lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            n = hi - lo
            some = np.flatnonzero(n)
            at, lo, n = at[some] + s, lo[some], n[some]
            ends = np.cumsum(n)
            first = 0
            while first < len(n):  # runs of hits of about PAIRS pairs
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
                m = n[first:last]
                k = np.repeat(lo[first:last], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                owner = self.owner[k]
                half = (np.repeat(at[first:last], m) - self.place[k]) // self.step[owner]
                new, c = np.unique(owner * (2 * far) + half + far, return_counts=True)
                keys, counts = _add(keys, counts, new, c)
                first = last
        # Band k holds half bands k and k + 1, so any ``edits`` + 1 diagonals in a row lie in one; bands under their passage's count go.
        after = np.r_[keys[1:] == keys[:-1] + 1, False] if len(keys) else np.zeros(0, bool)
        total = counts + np.where(after, np.r_[counts[1:], 0], 0) if len(keys) else counts
        owner = keys // (2 * far)
        some = total >= self.need[owner] if len(keys) else np.zeros(0, bool)
        return owner[some], keys[some] % (2 * far) - far


def _add(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two tables of counters, sorted by key, as one."""
    if not len(keys):
        return more, by
    both, where = np.unique(np.concatenate([keys, more]), return_inverse=True)
    return both, np.bincount(where, weights=np.concatenate([counts, by])).astype(np.int64)


def banded_distance(passage: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """The least edits between ``passage`` and any region of ``text`` on diagonals low..high, and where that region ends.

    Row i holds cells (i, i + low) .. (i, i + high); the region starts and ends freely.
    """
    m, width, far = len(passage), high - low + 1, len(passage) + 1
    d = np.arange(width)
    column = d + low
    row = np.where((column >= 0) & (column <= len(text)), 0, far)
    for i in range(1, m + 1):
        column = d + low + i  # length of the text's prefix
        inside = (column >= 1) & (column <= len(text))
        same = np.zeros(width, dtype=bool)
        same[inside] = text[column[inside] - 1] == passage[i - 1]
        best = np.minimum(row + ~same, np.append(row[1:], far) + 1)
        best = np.where(inside, best, np.where(column == 0, np.append(row[1:], far) + 1, far))
        best = np.minimum.accumulate(best - d) + d  # gaps along the row
        row = np.where((column >= 0) & (column <= len(text)), best, far)
    k = int(np.argmin(row))
    return int(row[k]), k + low + m


def matches(code: np.ndarray, index: Passages, error: float = ERROR) -> list[tuple[int, int, int]]:
    """(passage, edits, end in the text) of each passage that some region matches, with its best region."""
    found: dict[int, tuple[int, int]] = {}
    if index.tiny:
        text = words(code)
        for n in {len(w) for w in index.tiny}:
            for i in range(len(text) - n + 1):
                for p in index.tiny.get(tuple(w for w, _ in text[i : i + n]), []):
                    found.setdefault(p, (0, text[i + n - 1][1]))
    owner, band = index.bands(code)
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for p, low in zip(owner[np.r_[0, cuts]].tolist() if len(owner) else (), np.split(band, cuts), strict=False):
        passage = index.code[p]
        edits = int(index.step[p]) - 1
        m, step = len(passage), edits + 1
        seen: dict[bytes, tuple[int, int]] = {}
        for b in (low * step).tolist():
            end = _exact(code, passage, b, b + 2 * step, m < LEAST)
            if end:
                found[p] = 0, end
                break
            if not edits:
                continue
            begin = max(0, b - edits)
            text = code[begin : b + 2 * step + edits + m]
            own = (b - edits - begin).to_bytes(8, "little", signed=True) + text.tobytes()
            if own not in seen:  # a repetitive text shows the same region many times
                seen[own] = banded_distance(passage, text, b - edits - begin, b + 2 * step + edits - begin)
            got = seen[own]
            if got[0] <= edits and (p not in found or got[0] < found[p][0]):
                found[p] = got[0], got[1] + begin
    return [(p, e, end) for p, (e, end) in sorted(found.items())]


def _exact(code: np.ndarray, passage: np.ndarray, low: int, high: int, words_only: bool) -> int:
    """Where an exact copy on one of the diagonals low..high - 1 ends; 0 if there is none."""
    m = len(passage)
    for b in range(max(0, low), min(high, len(code) - m + 1)):
        if code[b] == passage[0] and code[b + m - 1] == passage[-1] and np.array_equal(code[b : b + m], passage):
            if not words_only or ((b == 0 or code[b - 1] == 32) and (b + m == len(code) or code[b + m] == 32)):
                return b + m
    return 0


def passages(item: int, text: str | None) -> list[tuple[int, int, np.ndarray]]:
    code, _ = normalise(text)
    if len(code) and code[-1] == 32:
        code = code[:-1]
    if not len(code):
        return []
    starts = [0] if len(code) <= PASSAGE else [*range(0, len(code) - PASSAGE, PASSAGE // 2), len(code) - PASSAGE]
    short = [*range(0, len(code) - LEAST, STRIDE), len(code) - LEAST] if len(code) > LEAST else []
    return [(item, s, code[s : s + PASSAGE]) for s in starts] + [(item, s, code[s : s + LEAST]) for s in short]


SCHEMA = "doc_id long, item_id long, passage_start long, edits long, match_start long, match_end long"


def _scan(rows: list[tuple[int, int, np.ndarray]], error: float):
    def run(batches):
        index = Passages(rows, error)
        for batch in batches:
            out = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                code, at = normalise(text)
                for p, edits, end in matches(code, index, error):
                    begin = max(0, end - len(index.code[p]))
                    out.append((key, index.item[p], index.start[p], edits, int(at[min(begin, len(at) - 1)]), int(at[min(end, len(at)) - 1]) + 1))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "passage_start", "edits", "match_start", "match_end"])

    return run


def _clean(rows: list[tuple[int, int, np.ndarray]], error: float):
    """Rows with a column ``text`` to those that match no passage."""

    def run(batches):
        index = Passages(rows, error)
        for batch in batches:
            yield batch.filter(pa.array([not (t and matches(normalise(t)[0], index, error)) for t in batch.column("text").to_pylist()], pa.bool_()))

    return run


def _cut_passages(batches):
    for batch in batches:
        rows = [p for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for p in passages(item, text)]
        cols = list(zip(*((i, s, c.astype("<u4").tobytes(), len(c)) for i, s, c in rows), strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["item_id", "start", "code", "n"])


def _blocks(benchmark: DataFrame):
    """The passages of each block, one block at a time: tasks cut the items, the driver holds BLOCK_GRAMS characters or so.

    Passages fall into blocks by hash, so a long item spreads over many blocks.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length("text") > 0)
    cut = materialize(items.mapInArrow(_cut_passages, "item_id long, start long, code binary, n long"), "passages")
    blocks = max(1, -(-(cut.agg(F.sum("n")).first()[0] or 0) // BLOCK_GRAMS))
    filed = materialize(cut.withColumn("block", F.pmod(F.xxhash64("item_id", "start", "code"), F.lit(blocks))), "items") if blocks > 1 else cut.withColumn("block", F.lit(0))
    for b in range(blocks):
        own = filed.where(F.col("block") == b).select("item_id", "start", "code").toArrow()  # about BLOCK_GRAMS characters
        yield [(i, s, np.frombuffer(c, dtype="<u4").astype(np.uint32)) for i, s, c in zip(*(own.column(k).to_pylist() for k in ("item_id", "start", "code")), strict=True)]


def contaminated(docs: DataFrame, benchmark: DataFrame, error: float = ERROR) -> DataFrame:
    """One row per document and passage of ``benchmark`` in it: its place in the item and the text, and the edits.

    A whole item's row and its short passages' have the same columns; ``match_start`` is the place as far back from the end as the passage is long.
    Of several blocks each is scanned and written before the next is read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out, last = None, None
    for rows in _blocks(benchmark):
        if last is not None:
            last = materialize(last, "matches")
            out = last if out is None else out.unionByName(last)
        last = docs.mapInArrow(_scan(rows, error), SCHEMA)
    return last if out is None else out.unionByName(last)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error: float = ERROR) -> DataFrame:
    """``docs`` without the rows that hold a passage of ``benchmark``, each row by its own text whatever its id."""

    def run(docs):
        first = True
        for rows in _blocks(benchmark):
            docs = docs if first else materialize(docs, "clean")
            docs, first = docs.mapInArrow(_clean(rows, error), docs.schema), False
        return docs

    return carried(docs, ("doc_id", "text"), run)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

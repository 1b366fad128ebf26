"""Texts packed into windows of a fixed number of tokens, by exact complements.

What fits together depends on lengths alone, and there are no more lengths than the capacity. The plan is
therefore made on a histogram: take the longest length left, fill up with the longest that fit until the
gap can be closed, and look up, in an index of the sums of one, two and three lengths, a sum that closes it exactly
and of whose lengths enough texts are left. Such a combination is used for as many windows as the counts allow, so every step of the
plan exhausts a length (or leaves less of it than one window takes), and the plan's size is bounded by the
capacity, not by the corpus. Where nothing closes a gap, the longest length that fits goes in (best fit).

Texts then take their places by rank within their length. The ranks come from a range partition on
(length, id) with counts carried over its edges; no task holds all texts of a common length.
"""

from __future__ import annotations

import base64
import importlib.util
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.operators.ranged import PART, in_ranges, scan
from arborlens.scratch import cut

#: Where the files of public tokenizers lie, and which one measures texts.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"


def vocabulary_of(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[str, bytes]:
    """(pattern, merges) of a public tokenizer, read where the job is started; executors need no files of it."""
    spec = importlib.util.spec_from_file_location("_public_tokenizers", Path(folder, "__init__.py"))
    public = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(public)
    return public.PATTERN, Path(folder, vocabulary).read_bytes()


class Counter:
    """Counts a text's tokens. Byte-pair merges do not cross the pieces that the pattern cuts, so a piece is measured once."""

    def __init__(self, pattern: str, merges: bytes) -> None:
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in merges.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for piece in self.pieces(text):
            n = known.get(piece)
            if n is None:
                if len(known) > 1_000_000:
                    known.clear()
                n = known[piece] = len(self.encoding.encode_ordinary(piece))
            total += n
        return total


@lru_cache(maxsize=2)
def _counter(pattern: str, merges: bytes) -> Counter:
    return Counter(pattern, merges)


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of every row; null and empty texts have 0 tokens."""
    kind = dict(docs.dtypes)[doc_id]
    held = docs.sparkSession.sparkContext.broadcast(vocabulary_of(folder, vocabulary))  # a vocabulary: about a megabyte

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(*held.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(t) for t in b.column(1).to_pylist()], pa.int64())], names=[doc_id, "tokens"])

    return docs.select(doc_id, text).mapInArrow(work, f"`{doc_id}` {kind}, tokens bigint")


class Sums:
    """The sums of one, two and three lengths, by sum: which of them lengths that are left can make.

    Counts only fall, so a sum that is out is out for good, and the search for a sum's parts goes on where it stopped.
    """

    def __init__(self, left: np.ndarray, lengths: list[int]) -> None:
        self.left, self.lengths = left, np.array(lengths[::-1], np.int64)  # the longest first
        there = np.zeros(len(left), np.float64)
        there[lengths] = 1
        n = 1 << (3 * len(left)).bit_length()
        wave = np.fft.rfft(there, n)
        self.two = np.fft.irfft(wave**2, n)[: len(left)] > 0.5
        self.three = np.fft.irfft(np.fft.rfft(self.two.astype(np.float64), n) * wave, n)[: len(left)] > 0.5
        self.at: dict[int, int] = {}

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two lengths that make ``total``, the longest possible first."""
        if not self.two[total]:
            return None
        start = self.at.get(total)
        if start is None:
            start = int(np.searchsorted(-self.lengths, -(total - 1)))
        while start < len(self.lengths) and 2 * self.lengths[start] >= total:
            a = self.lengths[start : start + 256]
            a = a[2 * a >= total]
            ok = np.flatnonzero((self.left[a] > 0) & (self.left[total - a] > (2 * a == total)))
            if len(ok):
                self.at[total] = start + int(ok[0])
                return int(a[ok[0]]), int(total - a[ok[0]])
            start += len(a)
        self.two[total] = False
        return None

    def closing(self, total: int) -> tuple[int, ...] | None:
        """One, two or three lengths left that make ``total``."""
        if self.left[total]:
            return (total,)
        if two := self.pair(total):
            return two
        if not self.three[total]:
            return None
        first = int(np.searchsorted(-self.lengths, -(total - 2)))
        a = self.lengths[first:]
        a = a[3 * a >= total]
        never = True
        for x in a[(self.left[a] > 0) & self.two[total - a]].tolist():
            if rest := self.pair(total - x):
                if all(self.left[y] >= (x, *rest).count(y) for y in rest) and self.left[x] >= (x, *rest).count(x):
                    return (x, *rest)
                never = False  # the pair needs what x takes; another may do later
        if never:
            self.three[total] = False
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Steps of ([(length, how many of it in a window)], windows) that use up all counts."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths = sorted(n for n in counts if counts[n] > 0)
    if not lengths:
        return []
    closing = Sums(left, lengths).closing
    steps = []

    def longest(most: int) -> int:
        """The longest length not above ``most`` of which there is any left, 0 if none."""
        at = bisect_right(lengths, most) - 1
        while at >= 0 and left[lengths[at]] == 0:
            del lengths[at]
            at -= 1
        return lengths[at] if at >= 0 else 0

    while first := longest(capacity):
        used: dict[int, int] = {}
        gap = capacity

        def take(x: int, k: int = 1) -> None:
            nonlocal gap
            used[x] = used.get(x, 0) + k
            left[x] -= k
            gap -= x * k

        take(first)
        top = longest(capacity)
        while gap > 0:
            if gap <= 3 * top and (last := closing(gap)):
                for x in last:
                    take(x)
                break
            x = longest(gap)
            if not x:
                break
            # leave room that up to three of the longest can close
            fit = max(1, min(int(left[x]), (gap - 2 * top) // x)) if gap > 3 * top else 1
            take(x, fit)
        more = min(int(left[x]) // k for x, k in used.items())
        for x, k in used.items():
            left[x] -= k * more
        steps.append((sorted(used.items(), reverse=True), 1 + more))
    return steps


def pack(sizes: DataFrame, capacity: int, doc_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(window, doc_id, piece, pieces, tokens): the place of every text in windows of ``capacity`` tokens.

    ``window`` numbers windows from 0. Only a text longer than the capacity is divided: into full pieces,
    which have a window each, and a rest that is packed like a text. Texts without tokens take no room
    and get window null. A null id is an id like any other; repeated rows are texts of their own; an
    empty input gives no rows. ``capacity`` must be positive.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    n, cap = F.col(tokens), F.lit(capacity)
    rest = sizes.select(F.col(doc_id), n.alias("tokens"), F.ceil(n / cap).cast("bigint").alias("pieces"))
    rest = rest.withColumn("length", (n - (F.greatest(F.col("pieces"), F.lit(1)) - 1) * cap).cast("bigint"))
    ranked = cut(_ranked(rest, doc_id), "ranked")
    found = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    found.pop(0, None)
    steps = plan({k: v for k, v in found.items()}, capacity)

    # places of each length: (length, first rank, how many in a window, first window), in order of length and rank
    ranks: dict[int, int] = {}
    rows, window = [], 0
    for used, times in steps:
        for x, k in used:
            rows.append((x, ranks.get(x, 0), k, window))
            ranks[x] = ranks.get(x, 0) + k * times
        window += times
    rows.sort()
    places = sizes.sparkSession.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 4))  # bounded by the capacity, as the plan is
    edges = _carried(ranked)
    carried = sizes.sparkSession.sparkContext.broadcast(edges)
    kind = dict(sizes.dtypes)[doc_id]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, carry = places.value, carried.value
        wide = np.int64(1) << np.int64(40)
        keys = table[:, 0] * wide + table[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            part = b.column(PART).to_numpy()
            for p in np.unique(part).tolist():
                if p in carry:
                    x, before = carry[p]
                    rank = np.where((part == p) & (length == x), rank + before, rank)
            some = length > 0
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            got = table[np.where(some, at, 0)] if len(table) else np.zeros((len(length), 4), np.int64)
            win = got[:, 3] + (rank - got[:, 1]) // np.maximum(got[:, 2], 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(win, mask=~some), b.column(doc_id), pc.subtract(pc.max_element_wise(b.column("pieces"), 1), 1), b.column("pieces"), b.column("length")],
                names=["window", doc_id, "piece", "pieces", "tokens"],
            )

    packed = ranked.select(doc_id, "pieces", "length", "rank", PART).mapInArrow(work, f"window bigint, `{doc_id}` {kind}, piece bigint, pieces bigint, tokens bigint")
    # full pieces: their windows follow, numbered by partition of the ranked table and place in it
    full = ranked.filter(F.col("pieces") > 1)
    per = full.groupBy(PART).agg(F.sum(F.col("pieces") - 1).alias("n"))
    offsets, at = {}, window
    for r in sorted(per.collect(), key=lambda r: r[PART]):  # one row a partition
        offsets[r[PART]] = at
        at += r["n"]
    if not offsets:
        return packed
    begins = sizes.sparkSession.createDataFrame(list(offsets.items()), f"{PART} int, __at bigint")  # one row a partition
    whole = full.join(F.broadcast(begins), PART).select((F.col("__at") + F.col("before")).alias("w"), doc_id, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 2)).alias("piece"), "pieces")
    whole = whole.select((F.col("w") + F.col("piece")).alias("window"), doc_id, "piece", "pieces", F.lit(capacity).cast("bigint").alias("tokens"))
    return packed.unionByName(whole)


def _ranked(rest: DataFrame, doc_id: str) -> DataFrame:
    """Each text with its rank within its length in its range, and the number of full pieces before it there."""
    kind = dict(rest.dtypes)[doc_id]

    def work(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen, before = -1, 0, 0
        for b in batches:
            length = b.column("length").to_numpy()
            n = len(length)
            if not n:
                continue
            fresh = np.append(length[0] != current, np.diff(length) != 0)
            at = np.arange(n)
            run = np.maximum.accumulate(np.where(fresh, at, -1))
            rank = np.where(run < 0, at + seen, at - run)
            current, seen = int(length[-1]), int(rank[-1]) + 1
            full = np.maximum(b.column("pieces").to_numpy() - 1, 0)
            sums = np.cumsum(full)
            yield pa.RecordBatch.from_arrays([b.column(doc_id), b.column("pieces"), b.column("length"), pa.array(rank), pa.array(before + sums - full), pa.array(np.full(n, part, np.int32))], names=[doc_id, "pieces", "length", "rank", "before", PART])
            before += int(sums[-1])

    ordered = in_ranges(rest, ["length", doc_id, "pieces"]).select(doc_id, "pieces", "length")
    return scan(ordered, work, f"`{doc_id}` {kind}, pieces bigint, length bigint, rank bigint, before bigint, {PART} int")


def _carried(ranked: DataFrame) -> dict[int, tuple[int, int]]:
    """Of each range its first length and how many texts of that length the ranges before it hold."""
    per = ranked.groupBy(PART).agg(F.min("length").alias("a"), F.max("length").alias("z"))
    counted = ranked.join(F.broadcast(per), PART).filter((F.col("length") == F.col("a")) | (F.col("length") == F.col("z"))).groupBy(PART, "a", "z").agg(
        F.count_if(F.col("length") == F.col("a")).alias("first"), F.count_if(F.col("length") == F.col("z")).alias("last")
    )
    out, length, so_far = {}, -1, 0
    for r in sorted(counted.collect(), key=lambda r: r[PART]):  # one row a partition
        if r["a"] == length:
            out[r[PART]] = (length, so_far)
        else:
            so_far = 0
        so_far = so_far + r["first"] if r["a"] == r["z"] else r["last"]
        length = r["z"]
    return out


def pack_all(docs: DataFrame, windows: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(window_id, window, doc_id, piece, pieces, tokens) for each capacity of ``windows`` (window_id, capacity_tokens)."""
    sizes = cut(measure(docs, doc_id, text, folder, vocabulary), "tokens")
    whole = None
    for r in windows.select("window_id", "capacity_tokens").distinct().orderBy("window_id").collect():  # a few capacities
        if r["window_id"] is None or not r["capacity_tokens"] or r["capacity_tokens"] < 1:
            continue
        one = pack(sizes, int(r["capacity_tokens"]), doc_id).select(F.lit(r["window_id"]).alias("window_id"), "*")
        whole = one if whole is None else whole.unionByName(one)
    return whole if whole is not None else sizes.limit(0).select(F.lit(0).alias("window_id"), F.col("tokens").alias("window"), doc_id, F.col("tokens").alias("piece"), F.col("tokens").alias("pieces"), "tokens")

"""Passages of held-out items in a corpus: size-partitioned MinHash containment search, then exact alignment.

Items are short and documents may be long, so documents are read in blocks: 60 words every 30, so that each
stretch of 30 words lies whole in a block. Items are cut in the same way. A block's five-word shingles are its
set; its signature has the smallest hash of the set under each of :data:`HASHES` functions, and the share
of equal places in two signatures estimates how alike the sets are. The least likeness of blocks that
share a passage follows from how many shingles survive the allowed edits and from the blocks' sizes. Blocks are
therefore partitioned by size, and each partition asks for as many equal places as a true pair misses
with a probability below :data:`MISS` only. What passes is checked by exact containment of shingles,
and then by aligning the words.

The items are the query set. As long as their texts have :data:`BROADCAST_BYTES` at most, their index is broadcast, and no
shuffle is needed: a document's result rests on it and on the items alone. Beyond that items stay a table: places of
signatures are rows, documents give those that a bitmap of fixed size does not rule out, and both meet in one join by
place and value. Either way the corpus is gone through once to find candidates, however many items there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from arborlens.llm.text import portions, readings, words
from arborlens.scratch import cut

#: Words in a shingle; shortest passage in words; one word in so many may be changed, dropped or added.
SHINGLE, PASSAGE, ONE_IN = 5, 30, 10
#: A block starts every STRIDE words and has BLOCK words.
STRIDE, BLOCK = 30, 60
#: Hash functions in a signature; chance that a true pair of blocks is missed at its least likeness.
HASHES, MISS = 64, 1e-3
#: Bytes of item texts up to which their index, some twelve times as large in each Python worker, is broadcast.
BROADCAST_BYTES = 16 << 20
#: Bits of the bitmap of the items' places and values: 16 MB, whatever the number of items.
BITMAP_BITS = 1 << 27

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def surviving(length: int) -> int:
    """Shingles of a passage of so many words that are left however the allowed edits fall."""
    return length - SHINGLE + 1 - SHINGLE * (length // ONE_IN)


#: Shingles that any passage shares with its source at least, within 59 words: longer ones contain a shorter that does.
LEAST = min(surviving(n) for n in range(PASSAGE, 2 * PASSAGE))


def needed(size: int) -> int:
    """Equal places that a true pair with a document block of ``size`` shingles has, but for a chance of MISS."""
    full = 2 * STRIDE  # two tiles
    likeness = LEAST / (max(size, LEAST) + full - LEAST)
    below = 0.0
    for n in range(HASHES + 1):
        below += math.comb(HASHES, n) * likeness**n * (1 - likeness) ** (HASHES - n)
        if below > MISS:
            return n
    return HASHES


#: Upper bounds of the size partitions, in shingles, and what each asks for.
_SIZES = np.array([12, 18, 26, 36, 46, 2 * STRIDE])
_NEEDED = np.array([needed(int(s)) for s in _SIZES])


class Words:
    """Hashes of words, the same in every process; a memory spares looking twice."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def hashes(self, found: list[str]) -> np.ndarray:
        import xxhash

        if len(self.known) > 1_000_000:
            self.known = {}
        for w in set(found) - self.known.keys():
            self.known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))


def shingles(hashed: np.ndarray) -> np.ndarray:
    """The hash of the shingle that starts at each word, for whole texts end to end."""
    n = len(hashed) - SHINGLE + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE if n > 0 else 0):
        out = (out * _P1) ^ (hashed[k : k + n] + (out >> np.uint64(29)))
        out *= _P2
    return out ^ (out >> np.uint64(31))


def signatures(sh: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(HASHES, tiles) smallest hashes, upper 32 bits, of the tiles of ``sh`` that begin at ``starts``."""
    out = np.empty((HASHES, len(starts)), np.uint32)
    for k in range(HASHES):
        out[k] = np.minimum.reduceat((sh * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32), starts)
    return out


def read(texts: list[str | None], memo: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts end to end, and each text's start and number of words."""
    found = [words(t) for t in texts]
    size = np.array([len(f) for f in found], np.int64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else size
    return memo.hashes(list(chain.from_iterable(found))), start, size


class Index:
    """Signatures of the items' blocks, by function and value."""

    def __init__(self, items: list[tuple[int, str]], memo: Words) -> None:
        items = [(i, r) for i, t in items for r in readings(t)]
        self.ids = [i for i, _ in items]
        hashed, start, size = read([t for _, t in items], memo)
        self.known = frozenset(memo.known)
        self.words = [hashed[a : a + n] for a, n in zip(start, size)]
        own = [shingles(w) for w in self.words]
        pairs = np.unique(np.stack([np.concatenate([*own, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(own)), [len(s) for s in own]).astype(np.uint64)]), axis=1)
        first = np.flatnonzero(np.append(True, pairs[0][1:] != pairs[0][:-1])) if pairs.shape[1] else np.zeros(0, np.int64)
        #: every shingle of the items once, where its items begin and how many they are, the items
        self.shingle = pairs[0][first], first, np.append(first[1:], pairs.shape[1]) - first, pairs[1].astype(np.int64)
        owner, values = [], []
        for i, w in enumerate(self.words):
            sh = shingles(w)
            if len(w) < PASSAGE:
                continue
            tile = np.arange(0, len(sh), STRIDE)
            sig = signatures(sh, tile)
            sig[:, :-1] = np.minimum(sig[:, :-1], sig[:, 1:])
            owner.append(np.full(sig.shape[1], i))
            values.append(sig)
        self.any = bool(owner)
        if not self.any:
            return
        owner, sig = np.concatenate(owner), np.concatenate(values, axis=1)
        self.table = []
        for k in range(HASHES):
            pairs = np.unique(np.stack([sig[k].astype(np.int64), owner]), axis=1)  # a value counts once for an item
            first = np.flatnonzero(np.append(True, np.diff(pairs[0]) != 0))
            held = np.zeros(1 << 16, bool)
            held[pairs[0] & 0xFFFF] = True
            self.table.append((pairs[0][first].astype(np.uint32), first, np.append(first[1:], len(pairs[0])) - first, pairs[1], held))

    def candidates(self, sig: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, item) with as many equal places as the block's size partition asks for."""
        hits = []
        for k, (values, first, count, owner, held) in enumerate(self.table):
            may = np.flatnonzero(held[sig[k] & np.uint32(0xFFFF)])
            at = np.searchsorted(values, sig[k][may])
            at[at == len(values)] = 0
            same = values[at] == sig[k][may]
            b, at = may[same], at[same]
            n = count[at]
            place = np.repeat(first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            hits.append(np.repeat(b, n) * len(self.ids) + owner[place])
        pair, equal = np.unique(np.concatenate(hits), return_counts=True)
        block, item = pair // len(self.ids), pair % len(self.ids)
        want = _NEEDED[np.searchsorted(_SIZES, np.minimum(sizes[block], _SIZES[-1]))]
        keep = equal >= want
        return block[keep], item[keep]

    def shared(self, sh: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Sorted item * len(sh) + place of each shingle, at some places of a text, that an item has."""
        values, first, count, owner = self.shingle
        at = np.searchsorted(values, sh[places])
        at[at == len(values)] = 0
        same = values[at] == sh[places]
        at, place = at[same], places[same]
        n = count[at]
        if not len(n):
            return np.zeros(0, np.int64)
        here = np.repeat(first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.sort(owner[here] * len(sh) + np.repeat(place, n))


def aligned(item: np.ndarray, text: np.ndarray, seeds: np.ndarray) -> bool:
    """Whether a stretch of PASSAGE words of the item or more stands in the text with one edit in ONE_IN words at most.

    A stretch of twice that length or more has a half that will do, so stretches below it are tried: of every
    place in the item at once, the least edit distance to any part of the text. ``seeds``: places in
    the item where a shared shingle starts; a stretch holds LEAST of them.
    """
    far = 2 * PASSAGE - 1
    held = np.zeros(len(item) + far + 1, np.int64)
    held[seeds] = 1
    held = np.concatenate([[0], np.cumsum(held)])
    starts = np.arange(0, len(item) - PASSAGE + 1)
    starts = starts[held[np.minimum(starts + far, len(held) - 1)] - held[starts] >= LEAST]
    if not len(starts):
        return False
    most = min(far, len(item))
    width = len(text)
    ramp = np.arange(width + 1)
    d = np.zeros((len(starts), width + 1), np.int32)
    for n in range(1, most + 1):
        at = starts + n - 1
        live = at < len(item)
        if not live.all():
            starts, d = starts[live], d[live]
            at = at[live]
            if not len(starts):
                return False
        change = d[:, :-1] + (text[None, :] != item[at][:, None])
        row = np.empty_like(d)
        row[:, 0] = n
        np.minimum(change, d[:, 1:] + 1, out=row[:, 1:])
        row = np.minimum.accumulate(row - ramp, axis=1) + ramp
        d = row
        least = d.min(axis=1)
        if n >= PASSAGE and (least <= n // ONE_IN).any():
            return True
        # edits never get fewer: a start with more than the longest stretch allows is out
        keep = least <= most // ONE_IN
        if not keep.all():
            starts, d = starts[keep], d[keep]
            if not len(starts):
                return False
    return False


def blocks(sh: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, sizes, signatures) of the blocks of texts that lie end to end; texts too short for a passage have none."""
    count = np.maximum(size - SHINGLE + 1, 0)
    count[size < PASSAGE - PASSAGE // ONE_IN] = 0
    tiles = -(-count // STRIDE)
    text = np.repeat(np.arange(len(count)), tiles)
    if not len(text):
        return text, text, text, np.zeros((HASHES, 0), np.uint32)
    nth = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(tiles)[:-1]]), tiles)
    begin = start[text] + nth * STRIDE
    length = np.minimum(count[text] - nth * STRIDE, STRIDE)
    # reduceat runs to the next start: a text's last tile is closed by a start of its own, dropped afterwards
    edges = np.stack([begin, begin + length], axis=1).ravel()
    last_in = edges < len(sh)
    sig = np.full((HASHES, len(begin)), 0xFFFFFFFF, np.uint32)
    got = signatures(sh, edges[last_in])
    sig[:] = got[:, np.flatnonzero(last_in.reshape(-1, 2)[:, 0].repeat(2)[last_in] & (np.arange(len(edges)) % 2 == 0)[last_in])]
    joined = np.append(text[1:] == text[:-1], False)
    sig[:, joined] = np.minimum(sig[:, joined], sig[:, np.flatnonzero(joined) + 1])
    return text, begin, length + np.append(length[1:], 0) * joined, sig


def search(index: Index, texts: list[str | None], memo: Words) -> set[tuple[int, int]]:
    """(text's place, item's place) of every passage found."""
    hashed, start, size = read(texts, memo)
    sh = shingles(hashed)
    text, begin, sizes, sig = blocks(sh, start, size)
    if not index.any or not len(text):
        return set()
    blk, item = index.candidates(sig, sizes)
    margin = PASSAGE // ONE_IN * 2 + SHINGLE
    begin, text = begin[blk], text[blk]
    a = np.maximum(begin - margin, start[text])
    z = np.minimum(begin + BLOCK + margin, start[text] + size[text])
    # exact containment: the shingles of the item that stand in the block; looked up in candidates only
    depth = np.zeros(len(sh) + 1, np.int32)
    np.add.at(depth, a, 1)
    np.add.at(depth, np.minimum(z, len(sh)), -1)
    shared = index.shared(sh, np.flatnonzero(np.cumsum(depth[:-1])))
    lo = np.searchsorted(shared, item * len(sh) + a)
    hi = np.searchsorted(shared, item * len(sh) + z - SHINGLE + 1)
    out: set[tuple[int, int]] = set()
    for c in np.flatnonzero(hi - lo >= LEAST).tolist():
        t, i = int(text[c]), int(item[c])
        if (t, i) not in out:
            own = shingles(index.words[i])
            seeds = np.isin(own, sh[shared[lo[c] : hi[c]] - i * len(sh)])
            if aligned(index.words[i], hashed[a[c] : z[c]], np.flatnonzero(seeds)):
                out.add((t, i))
    return out


def holds(item: np.ndarray, text: np.ndarray) -> bool:
    """Whether a passage of an item stands in a text, both as hashes of words: exact containment, then alignment, of every block."""
    own, sh = shingles(item), shingles(text)
    if len(item) < PASSAGE or not len(sh):
        return False
    here = np.concatenate([[0], np.cumsum(np.isin(sh, own))])
    margin = PASSAGE // ONE_IN * 2 + SHINGLE
    begin = np.arange(0, len(sh), STRIDE)
    a, z = np.maximum(begin - margin, 0), np.minimum(begin + BLOCK + margin, len(text))
    for i in np.flatnonzero(here[np.minimum(z - SHINGLE + 1, len(sh))] - here[a] >= LEAST).tolist():
        seeds = np.flatnonzero(np.isin(own, sh[a[i] : z[i] - SHINGLE + 1]))
        if aligned(item, text[a[i] : z[i]], seeds):
            return True
    return False


_indexes: dict[object, tuple[Index, Words]] = {}


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(item_id, doc_id) of items of which a passage stands in a document.

    A passage is a stretch of :data:`PASSAGE` words of the item or more, with at most one word in
    :data:`ONE_IN` changed, dropped or added; only words count. Null and empty texts and items shorter than
    a passage have no rows; repeated rows of a document or item give one row, of items with one id the first text counts. Texts are read whole.
    Items whose texts have more than ``most_bytes`` are joined, not broadcast.
    """
    known = items.filter(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), F.col(item_text).alias("said"))
    known = known.groupBy("item").agg(F.min("said").alias("said"))
    source = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    size = known.agg(F.coalesce(F.sum(F.octet_length("said")), F.lit(0))).first()[0]
    found = _by_broadcast(source, known) if size <= most_bytes else _by_join(source, known)
    return found.distinct().select(F.col("item").alias(item_id), F.col("doc").alias(doc_id))


def _by_broadcast(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item, doc) by an index of all items in each worker."""
    kinds = dict(docs.dtypes)["doc"], dict(items.dtypes)["item"]
    id_type = to_arrow_type(items.schema["item"].dataType)
    held = docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in items.collect()])  # BROADCAST_BYTES of text at most, as counted

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = (len(held.value), hash(tuple(held.value)))
        if name not in _indexes:
            _indexes.clear()
            memo = Words()
            _indexes[name] = (Index(held.value, memo), memo)
        index, memo = _indexes[name]
        for b in batches:
            for part in portions(b, 1):
                read_as = [(t, r) for t, text in enumerate(part.column(1).to_pylist()) for r in readings(text, index.known)]
                found = sorted((read_as[t][0], i) for t, i in search(index, [r for _, r in read_as], memo))
                yield pa.RecordBatch.from_arrays([pa.array([index.ids[i] for _, i in found], id_type), part.column(0).take(pa.array([t for t, _ in found], pa.int64()))], names=["item", "doc"])

    return docs.mapInArrow(work, f"item {kinds[1]}, doc {kinds[0]}")


def confirmed(pairs: DataFrame) -> DataFrame:
    """(sure) of pairs (said, text): whether a passage stands in the text by edit distances alone, without hashes of shingles or blocks."""

    def plainly(item: list[str], text: list[str]) -> bool:
        place = {w: i for i, w in enumerate(dict.fromkeys([*item, *text]))}
        t = np.array([place[w] for w in text], np.int64)
        ramp = np.arange(len(t) + 1)
        for start in range(len(item) - PASSAGE + 1):
            row = np.zeros(len(t) + 1, np.int64)
            for n, w in enumerate(item[start : start + 2 * PASSAGE - 1], 1):
                new = np.minimum(row[1:] + 1, row[:-1] + (t != place[w]))
                row = np.minimum.accumulate(np.append(n, new) - ramp) + ramp
                if n >= PASSAGE and row.min() <= n // ONE_IN:
                    return True
        return False

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sure = []
            for said, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                theirs = [words(r) for r in readings(said)]
                known = {w for ws in theirs for w in ws}
                sure.append(any(plainly(i, words(r)) for i in theirs for r in readings(text, known)))
            yield pa.RecordBatch.from_arrays([pa.array(sure, pa.bool_())], names=["sure"])

    return pairs.select("said", "text").mapInArrow(work, "sure boolean")


def _places(rows: DataFrame, column: str, bits: np.ndarray | None = None, held=None) -> DataFrame:
    """(id, block, size, place, value): the signature of every block of every reading of a text, a row a place.

    With ``held``, a broadcast bitmap, only places and values that it may have, of blocks with as many of them as their size asks for.
    """
    kind = rows.dtypes[0][1]
    names = ["id", "block", "size", "place", "value"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for b in batches:
            for part in portions(b, 1):
                read_as = [(t, r) for t, text in enumerate(part.column(1).to_pylist()) for r in readings(text)]
                hashed, start, size = read([r for _, r in read_as], memo)
                text, begin, sizes, sig = blocks(shingles(hashed), start, size)
                keep = np.ones(sig.shape, bool)
                if held is not None:
                    at = _bit(np.arange(HASHES, dtype=np.int64)[:, None], sig.astype(np.int64))
                    keep = (held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                    keep &= keep.sum(axis=0) >= _NEEDED[np.searchsorted(_SIZES, np.minimum(sizes, _SIZES[-1]))]
                place, block = np.nonzero(keep)
                ids = part.column(0).take(pa.array([read_as[t][0] for t in text[block].tolist()], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(begin[block].astype(np.int64)), pa.array(sizes[block].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(sig[place, block].astype(np.int64))], names=names)

    return rows.mapInArrow(work, f"id {kind}, block bigint, size int, place int, value bigint")


def _bit(place, value):
    """The bit of a place and value; the same for arrays and columns."""
    return (value * HASHES + place) % BITMAP_BITS


def _by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item, doc) by a join of signatures; nothing that grows with items or documents is broadcast or collected."""
    spark = docs.sparkSession
    theirs = cut(_places(items, "said").select("id", "place", "value").distinct(), "signatures")  # a value counts once for an item
    bit = _bit(F.col("place"), F.col("value"))
    buckets = theirs.select((bit + 1).alias("b")).groupBy(F.expr("bitmap_bucket_number(b)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("bits"))
    bitmap = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in buckets.collect():  # BITMAP_BITS at most
        bitmap[(r["n"] - 1) * 4096 : r["n"] * 4096] = np.frombuffer(r["bits"], np.uint8)  # buckets are counted from 1
    held = spark.sparkContext.broadcast(bitmap)
    ours = _places(docs, "text", held=held).withColumnRenamed("id", "doc")
    need = F.element_at(F.array(*[F.lit(int(n)) for n in _NEEDED]), F.lit(len(_SIZES)) - sum((F.col("size") <= int(s)).cast("int") for s in _SIZES[:-1]))
    equal = ours.join(theirs.withColumnRenamed("id", "item"), ["place", "value"]).groupBy("doc", "block", "item").agg(F.count_distinct("place").alias("n"), F.max("size").alias("size"))
    pairs = cut(equal.filter(F.col("n") >= need).select("doc", "item").distinct(), "candidates")
    # short texts go to the long ones: a document's text is moved once, whatever its number of candidates
    both = pairs.join(items, "item").join(docs, "doc").select("item", "doc", "text", "said")
    kinds = dict(both.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, last, ours, known = Words(), None, {}, {}
        for b in batches:
            keep = []
            for text, item in zip(b.column(2), b.column(3)):  # a document's rows follow each other
                text, item = text.as_py(), item.as_py()
                if text != last:
                    last, ours = text, {}
                if item not in known:
                    if len(known) > 1000:
                        known.clear()
                    said = [words(r) for r in readings(item)]
                    known[item] = [memo.hashes(ws) for ws in said], {w for ws in said for w in ws}
                theirs, spelled = known[item]
                as_read = readings(text, spelled)
                for r in as_read:
                    if r not in ours:
                        ours[r] = memo.hashes(words(r))
                keep.append(any(holds(i, ours[r]) for i in theirs for r in as_read))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], names=["item", "doc"])

    return both.mapInArrow(work, f"item {kinds['item']}, doc {kinds['doc']}")

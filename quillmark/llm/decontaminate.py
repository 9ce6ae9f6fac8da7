"""Benchmark decontamination by SimHash over item-sized windows.

A window of an item's length in a document is compared with the item by the
exact weighted Jaccard similarity of their five-word shingles (multiset counts,
weighted by rarity among the items).

1. Windows.  A window can reach the threshold only if shingles that items hold
   make up so much of its weight; running sums tell which windows do, for the
   lengths of the items that the document shares a shingle with.  The gate looks
   at no item in particular and loses nothing.
2. Fingerprints.  Windows and items get ``PRINTS`` 64-bit SimHashes: the signs of
   sums of bell-shaped numbers, hashed from the shingles, times the root of their
   weights.  Two texts at similarity s have a cosine of 2s / (1 + s) at least, so
   at 0.75 a bit differs with probability acos(6/7) / pi = 0.172 at most, whatever
   the edit and wherever it stands: the radius follows from the threshold.
3. Candidates.  With four blocks of 16 bits, fingerprints at most ``RADIUS`` = 15
   bits apart agree in some block up to 3 bits, and all those block values of the
   items are posted: every item within the radius of a window is found.  All five
   fingerprints of a pair at 0.75 lie beyond the radius with probability 2.2e-6
   (0.0738 each); nothing else is lost.
4. Candidates are verified by the exact similarity.

The benchmark is the stated query set: it is broadcast in blocks of bounded
size, each of which sees all documents, at most ``CHAIN`` of them at a time.  Rarity is counted once over the whole
benchmark, so a verdict doesn't depend on the block of an item.  A shingle of a
single item weighs as much as one of none; only those that items share, and
their counts, go to every block.  Posting lists are made by the workers that
meet a window to look up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, column_bytes, materialize, mix64, pieces, run_hashes, shingle_hashes, small_batches, split_words

WIDTH = 5
SIMILARITY = 0.75
#: Weights are whole numbers of this unit, so sums and the border are exact.
UNIT = 1 << 36
PRINTS, BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 5, 4, 16, 3
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Items in one broadcast block.
BLOCK_ITEMS = 1_000
#: Blocks in one plan; between plans the rows are written and the blocks leave the executors.
CHAIN = 8

_FLIPS = np.array([sum(1 << b for b in bits) for k in range(BLOCK_RADIUS + 1) for bits in combinations(range(BLOCK_BITS), k)], np.uint16)
_BIT = np.arange(64, dtype=np.uint64)
_SALT = mix64(np.arange(1, 64 * PRINTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_AGAIN = np.uint64(0xD1342543DE82EF95)
_MEMBER_BITS = 20
#: Windows that are fingerprinted at a time.
_WINDOWS = 1_024


def _occurrences(shingles: np.ndarray) -> np.ndarray:
    """How often each shingle stands before its place; zeros if none repeats."""
    order = np.argsort(shingles, kind="stable")
    placed = shingles[order]
    begins = np.flatnonzero(np.concatenate([[True], placed[1:] != placed[:-1]]))
    out = np.empty(len(shingles), np.uint64)
    out[order] = np.arange(len(shingles)) - np.repeat(begins, np.diff(np.append(begins, len(shingles))))
    return out


def _terms(shingles: np.ndarray, weights: np.ndarray, occurrences: np.ndarray) -> np.ndarray:
    """A row of whole numbers per shingle, one for each bit: its part in the sums."""
    with np.errstate(over="ignore"):
        told = shingles + occurrences * _AGAIN
        bell = np.bitwise_count(mix64(told[:, None] ^ _SALT)).astype(np.int64) - 32
    return bell * np.rint(np.sqrt(weights / UNIT) * 1024).astype(np.int64)[:, None]


def _packed(sums: np.ndarray) -> np.ndarray:
    """``PRINTS`` fingerprints per row of sums."""
    return ((sums.reshape(len(sums), PRINTS, 64) > 0).astype(np.uint64) << _BIT).sum(axis=2, dtype=np.uint64)


def fingerprints(shingles: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
    """The fingerprints of every run of ``width`` shingles, one row each.

    A shingle's second occurrence in a run is a feature of its own, as is its
    third, so that counts tell.  Without repeats the sums of all runs are
    differences of running sums.
    """
    count = len(shingles) - width + 1
    again = _occurrences(shingles)
    if not again.any():
        running = np.zeros((len(shingles) + 1, len(_SALT)), np.int64)
        np.cumsum(_terms(shingles, weights, again), axis=0, out=running[1:])
        return _packed(running[width:] - running[:count])
    runs = [slice(i, i + width) for i in range(count)]
    return _packed(np.stack([_terms(shingles[r], weights[r], _occurrences(shingles[r])).sum(axis=0) for r in runs]))


class Rarity:
    """Number of items of a benchmark, and the shingles that more than one of them hold with the number of holders."""

    def __init__(self, n: int, shared: np.ndarray, holders: np.ndarray):
        order = np.argsort(shared)
        self.n, self.shared, self.holders = n, shared[order], holders[order]
        self.other = round(log(1 + n) * UNIT) if n else UNIT

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        """The weight of each shingle."""
        out = np.full(len(shingles), self.other, np.int64)
        if len(self.shared):
            place = np.minimum(np.searchsorted(self.shared, shingles), len(self.shared) - 1)
            held = self.shared[place] == shingles
            out[held] = [round(log(1 + self.n / c) * UNIT) for c in self.holders[place[held]].tolist()]
        return out


class ItemIndex:
    """One block of benchmark items, ready for lookup; without ``rarity`` the block is the whole benchmark."""

    def __init__(self, ids: list[int], texts: list[bytes | None], rarity: Rarity | None = None):
        known = WordHashes()
        self.ids, self.lengths, self.shingles = [], [], []
        for i, text in zip(ids, texts, strict=True):
            words = split_words(text)
            if words:
                self.ids.append(i)
                self.lengths.append(len(words))
                self.shingles.append(shingle_hashes(words, known, WIDTH))
        n = len(self.ids)
        # Items under WIDTH words are one shingle, found in windows of their own length.
        self.short: dict[int, dict[int, list[int]]] = {}
        for k, length in enumerate(self.lengths):
            if length < WIDTH:
                self.short.setdefault(length, {}).setdefault(int(self.shingles[k][0]), []).append(k)
        self.anchors, holders = np.unique(np.concatenate([*map(np.unique, self.shingles), np.empty(0, np.uint64)]), return_counts=True)
        self.rarity = rarity or Rarity(n, self.anchors[holders > 1], holders[holders > 1])
        self.anchor_weights = self.rarity.weights(self.anchors)
        self.weights = dict(zip(self.anchors.tolist(), self.anchor_weights.tolist(), strict=True))
        self.counts = [Counter(own.tolist()) for own in self.shingles]
        self.member = np.zeros(1 << _MEMBER_BITS, bool)
        self.member[(self.anchors >> np.uint64(64 - _MEMBER_BITS)).astype(np.int64)] = True
        self.totals = np.array([sum(self.weights[s] * c for s, c in own.items()) for own in self.counts], np.int64)
        prints = [fingerprints(own, self.rarity.weights(own), len(own))[0] for own in self.shingles]
        self.prints = np.array(prints, np.uint64).reshape(n, PRINTS)
        # The lengths of the items that hold each anchor.
        held = [np.searchsorted(self.anchors, np.unique(own)) for own in self.shingles]
        pairs = np.unique(np.concatenate([*(own << 32 | length for own, length in zip(held, self.lengths, strict=True)), np.empty(0, np.int64)]))
        self.anchor_lengths, self.anchor_starts = pairs & 0xFFFFFFFF, np.searchsorted(pairs >> 32, np.arange(len(self.anchors) + 1))
        self.posted = None

    def _posted(self) -> list:
        """For each fingerprint and block: where each value's list starts, and the items within ``BLOCK_RADIUS`` bits of it."""
        if self.posted is None:
            self.posted = []
            for f in range(PRINTS):
                for b in range(BLOCKS):
                    values = ((self.prints[:, f] >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.uint16)
                    spread = (values[:, None] ^ _FLIPS).ravel()
                    order = np.argsort(spread, kind="stable")
                    self.posted.append((f, np.uint64(b * BLOCK_BITS), np.searchsorted(spread[order], np.arange((1 << BLOCK_BITS) + 1)), (order // len(_FLIPS)).astype(np.int32)))
        return self.posted

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``prints``, item) of all pairs within ``RADIUS`` bits in one of the fingerprints."""
        found = [np.empty(0, np.int64)]
        for f, shift, starts, own in self._posted():
            value = ((prints[:, f] >> shift) & np.uint64(0xFFFF)).astype(np.int64)
            sizes = starts[value + 1] - starts[value]
            row = np.repeat(np.arange(len(prints)), sizes)
            item = own[np.repeat(starts[value] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            close = np.bitwise_count(prints[row, f] ^ self.prints[item, f]) <= RADIUS
            found.append(row[close] * len(self.ids) + item[close])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.ids)), pairs % max(1, len(self.ids))

    def similarity(self, k: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity of an item and the shingles of a window."""
        own, other = self.counts[k], Counter(window.tolist())
        low = high = 0
        strange = [s for s in other if s not in self.weights]
        more = dict(zip(strange, self.rarity.weights(np.array(strange, np.uint64)).tolist(), strict=True))
        for s in own.keys() | other.keys():
            w = self.weights[s] if s in self.weights else more[s]
            low += w * min(own[s], other[s])
            high += w * max(own[s], other[s])
        return low / high if high else 0.0  # a quotient of integers, rounded once

    def windows(self, shingles: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(length in words, first start, fingerprints) of runs of adjacent windows of ``n`` words that can reach the threshold."""
        hit = np.flatnonzero(self.member[(shingles >> np.uint64(64 - _MEMBER_BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.anchors, shingles[hit]), len(self.anchors) - 1)
        real = self.anchors[place] == shingles[hit]
        hit, place = hit[real], place[real]
        if not len(hit):
            return
        lengths = {int(x) for p in np.unique(place) for x in self.anchor_lengths[self.anchor_starts[p] : self.anchor_starts[p + 1]]}
        weights = self.rarity.weights(shingles)
        total = np.concatenate([[0], np.cumsum(weights)])
        known = np.zeros(len(shingles) + 1, np.int64)
        known[hit + 1] = weights[hit]
        known = np.cumsum(known)
        for length in sorted({min(x, n) for x in lengths}):
            width = max(1, length - WIDTH + 1)
            at = np.flatnonzero(4 * (known[width:] - known[:-width]) >= 3 * (total[width:] - total[:-width]))
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ():
                for first in range(int(run[0]), int(run[-1]) + 1, _WINDOWS):
                    span = slice(first, min(first + _WINDOWS - 1, int(run[-1])) + width)
                    yield length, first, fingerprints(shingles[span], weights[span], width)

    def within(self, words: list[bytes], known: WordHashes) -> dict[int, float]:
        """The items under ``WIDTH`` words that a document holds as a run of words; these agree as a whole, similarity 1."""
        out = {}
        for length, items in self.short.items():
            if length <= len(words):
                runs = run_hashes(words, known, length)
                for value in np.unique(runs[np.isin(runs, np.array(list(items), np.uint64))]).tolist():
                    out |= dict.fromkeys(items[value], 1.0)
        return out

    def best(self, words: list[bytes], known: WordHashes) -> tuple[int | None, float, int]:
        """(best item, its similarity, items at or above the threshold) of one document."""
        shingles, n = shingle_hashes(words, known, WIDTH), len(words)
        found: dict[int, float] = self.within(words, known) if self.short else {}
        for length, first, prints in self.windows(shingles, n) if n and self.ids else ():
            width = max(1, length - WIDTH + 1)
            for row, k in zip(*(x.tolist() for x in self.near(prints)), strict=True):
                if min(self.lengths[k], n) == length and found.get(k) != 1:
                    found[k] = max(found.get(k, 0.0), self.similarity(k, shingles[first + row : first + row + width]))
        found = {k: v for k, v in found.items() if v >= SIMILARITY}
        if not found:
            return None, 0.0, 0
        k = min(found, key=lambda k: (-found[k], self.ids[k]))
        return self.ids[k], found[k], len(found)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")


def _held_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's distinct shingles, and a row without shingle for the item itself."""
    known = WordHashes()
    for batch in pieces(batches):
        for text in column_bytes(batch, "text"):
            own = np.unique(shingle_hashes(split_words(text), known, WIDTH))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array([None, *own.view(np.int64).tolist()], pa.int64())], ["shingle"])


def _rarity(benchmark: DataFrame) -> Rarity:
    """Counted over all items.  Shingles of a single item don't reach the driver."""
    counts = _items(benchmark).select("text").mapInArrow(_held_shingles, "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    found = counts.filter("shingle is null or n > 1").toArrow()
    shingles, holders = found["shingle"].combine_chunks(), found["n"].to_numpy()
    empty = shingles.is_null().to_numpy(zero_copy_only=False)
    shared = shingles.drop_null().to_numpy().astype(np.int64).view(np.uint64)
    return Rarity(int(holders[empty].sum()), shared, holders[~empty])


def _blocks(benchmark: DataFrame) -> Iterator[ItemIndex]:
    """The benchmark in blocks of ``BLOCK_ITEMS`` items at most, read one after the other."""
    rarity = _rarity(benchmark)
    ids, texts = [], []
    for row in _items(benchmark).orderBy("item_id", "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"].encode())
        if len(ids) == BLOCK_ITEMS:
            yield ItemIndex(ids, texts, rarity)
            ids, texts = [], []
    if ids:
        yield ItemIndex(ids, texts, rarity)


def _verdicts(index, texts: list[bytes | None], known: WordHashes) -> list[tuple[int | None, float, int]]:
    return [index.value.best(split_words(t), known) for t in texts]


def _report(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in pieces(batches):
            old = zip(*(batch.column(c).to_pylist() for c in ("item_id", "similarity", "n_items")), strict=True)
            rows = []
            for (item, high, n), (item2, high2, n2) in zip(old, _verdicts(index, column_bytes(batch, "text"), known), strict=True):
                better = n2 and (not n or high2 > high)
                rows.append((item2 if better else item, max(high, high2), n + n2))
            out = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *out], ["doc_id", "text", "item_id", "similarity", "n_items"])

    return run


def _keep(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in pieces(batches):
            yield batch.filter(pa.array([n == 0 for _, _, n in _verdicts(index, column_bytes(batch, "text"), known)], pa.bool_()))

    return run


def _by_blocks(rows: DataFrame, benchmark: DataFrame, step) -> DataFrame:
    """``rows`` after ``step`` (rows, broadcast block) for each block of the benchmark."""
    held = []
    for index in _blocks(benchmark):
        if len(held) == CHAIN:
            rows = materialize(rows, "blocks")
            for block in held:
                block.unpersist()
            held = []
        held.append(rows.sparkSession.sparkContext.broadcast(index))
        rows = step(rows.transform(small_batches), held[-1])
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, item_id, similarity, n_items) for each row of ``docs``.

    item_id: the most similar item (ties: the smallest id) at or above the
    threshold, else null with similarity 0.  Null, empty and wordless texts are
    clean.  An item under five words is one shingle and must stand in the
    document as it is, word by word; a document under five words must agree as a
    whole with an item of its length or hold a shorter one.  Null items are left out; an empty
    benchmark leaves all documents clean.  Repeated rows get equal verdicts,
    other columns are ignored.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("n_items"))
    schema = "doc_id long, text string, item_id long, similarity double, n_items long"
    out = _by_blocks(out, benchmark, lambda rows, block: rows.mapInArrow(_report(block), schema))
    return out.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "item_id", F.round("similarity", 9).alias("similarity"), "n_items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item."""
    return _by_blocks(docs, benchmark, lambda rows, block: rows.mapInArrow(_keep(block), docs.schema))

"""Which texts hold which patterns, letter by letter, without comparing all pairs.

A text that holds a pattern holds each of its q-grams.  Of every pattern one
gram is posted, the one that the fewest sampled texts have; a text is compared
with those patterns alone whose gram it has.  Which gram is posted changes the
cost and never the result.  Patterns are a stated set: they are broadcast in
blocks of bounded bytes, each of which sees all texts once; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of a gram; shorter patterns are their own gram.
Q = 8
#: Bytes of patterns in one block, texts of the sample and letters read of each, bytes of texts hashed at a time.
BLOCK_BYTES, SAMPLE, SAMPLE_LETTERS, CHUNK = 16 << 20, 1_000, 20_000, 250_000
_STEP = np.random.default_rng(23).integers(0, 2**63, Q, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLAGS = (1 << 20) - 1


def _grams(letters: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` letters from each place on."""
    count = max(len(letters) - size + 1, 0)
    out = np.full(count, size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out += letters[j : j + count] * _STEP[j]
        return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


@dataclass(frozen=True)
class _Posted:
    """Sorted grams with the patterns that are found by them; ``sizes``: the lengths of the grams."""

    ids: pa.Array
    patterns: list[str]
    sizes: list[int]
    grams: np.ndarray
    starts: np.ndarray
    owners: np.ndarray
    flags: np.ndarray

    @classmethod
    def of(cls, ids: pa.Array, patterns: list[str], sample: list[str]) -> _Posted:
        own = [_grams(_letters(p), min(Q, len(p))) for p in patterns]
        sizes = sorted({min(Q, len(p)) for p in patterns})
        known = np.unique(np.concatenate([*own, np.empty(0, np.uint64)]))
        seen = np.zeros(len(known) + 1, np.int64)
        for text in sample:
            letters = _letters(text)
            for size in sizes:
                held = np.unique(_grams(letters, size))
                place = np.searchsorted(known, held)
                seen[place[(place < len(known)) & (known[np.minimum(place, len(known) - 1)] == held)]] += 1
        chosen = np.array([g[np.argmin(seen[np.searchsorted(known, g)])] for g in own], np.uint64)
        order = np.argsort(chosen, kind="stable")
        grams, starts = np.unique(chosen[order], return_index=True)
        flags = np.zeros(_FLAGS + 1, bool)
        flags[(grams & np.uint64(_FLAGS)).astype(np.int64)] = True
        return cls(ids, patterns, sizes, grams, np.append(starts, len(chosen)), order, flags)

    def hits(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """(text, pattern) of all texts that hold a pattern."""
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        letters = _letters("\0".join(texts) + "\0")
        found = [np.empty(0, np.int64)]
        for size in self.sizes:
            grams = _grams(letters, size)
            maybe = np.flatnonzero(self.flags[(grams & np.uint64(_FLAGS)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.grams, grams[maybe]), len(self.grams) - 1)
            real = self.grams[place] == grams[maybe]
            text = np.searchsorted(starts, maybe[real], "right") - 1
            found.append(text * len(self.grams) + place[real])
        for pair in np.unique(np.concatenate(found)).tolist():
            text, gram = divmod(pair, len(self.grams))
            for k in self.owners[self.starts[gram] : self.starts[gram + 1]].tolist():
                if self.patterns[k] in texts[text]:
                    yield text, k


def _holding(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posted = shared.value
        for batch in batches:
            upto, first = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)), 0
            # few texts at a time become Python objects
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + CHUNK, "right")))
                pairs = list(posted.hits(batch.column(1).slice(first, last - first).to_pylist()))
                if pairs:
                    places, owners = (pa.array(x, pa.int64()) for x in zip(*pairs, strict=True))
                    yield pa.RecordBatch.from_arrays([posted.ids.take(owners), batch.column(0).slice(first, last - first).take(places)], names)
                first = last

    return run


def containing(texts: DataFrame, patterns: DataFrame, key: str = "doc_id", asked: str = "query_id") -> DataFrame:
    """(asked, key): every row of ``texts`` (key, text) whose text holds the pattern of a row of ``patterns`` (asked, pattern).

    Letters are compared as they are.  The empty pattern is held by every text;
    null texts and patterns have no rows.  Repeated rows are found as often as
    they come; an empty table on either side gives no rows.
    """
    spark = texts.sparkSession
    rows = texts.select(key, F.col("text").cast("string").alias("text")).filter("text is not null")
    own = patterns.select(asked, F.col("pattern").cast("string").alias("pattern")).filter("pattern is not null")
    kinds = T.StructType([own.schema[asked], rows.schema[key]])
    total = own.filter("pattern <> ''").agg(F.coalesce(F.sum(F.octet_length("pattern") + 16), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK_BYTES)
    sample = [r[0] for r in rows.select(F.substring("text", 1, SAMPLE_LETTERS)).limit(SAMPLE).collect()] if blocks else []
    # what every text holds: each pair is a row of the result
    out = rows.select(key).crossJoin(own.filter("pattern = ''").select(asked)).select(asked, key) if not own.filter("pattern = ''").isEmpty() else None
    for block in range(blocks):
        part = own.filter("pattern <> ''")
        held = (part if blocks == 1 else part.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block)).toArrow().combine_chunks()
        if held.num_rows:
            posted = _Posted.of(held[asked].combine_chunks(), held["pattern"].to_pylist(), sample)
            found = rows.mapInArrow(_holding(spark.sparkContext.broadcast(posted), [asked, key]), kinds)
            out = found if out is None else out.unionAll(found)
    return out if out is not None else spark.createDataFrame([], kinds)

"""Exact length histogram of encoded documents.

Each document is encoded whole once; only (length, documents) pairs leave the
tasks.  Suffix sums over the histogram answer, for every context limit that
occurs as a length, how many documents fit, how many tokens there are in all
and how many remain when longer documents are cut at the limit.
"""

from __future__ import annotations

import base64
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pieces, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public split pattern of this byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths in one block of the two-level suffix sums.
BLOCK = 1_024


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoding_of(vocabulary: bytes, pattern: str = PATTERN):
    """The encoding of a vocabulary file's content."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def load_encoding(path: str, pattern: str = PATTERN):
    return encoding_of(read_vocabulary(path), pattern)


def _measure(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, seen = encoding_of(vocabulary.value), Counter()
        for batch in pieces(batches):
            seen.update(len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["length", "n_docs"])

    return run


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(length, n_docs): how many rows of ``docs`` have each encoded length; null texts have none."""
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(os.fspath(vocabulary)))
    counted = docs.select(F.col("text").cast("string").alias("text")).transform(small_batches).mapInArrow(_measure(content), "length long, n_docs long")
    return counted.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def limit_totals(histogram: DataFrame) -> DataFrame:
    """For each length as context limit: documents and tokens, by suffix sums.

    Columns: length, n_docs, n_tokens (of documents of this length), docs_over
    (longer documents), docs_within, tokens_within, total_docs, total_tokens,
    truncated_total (tokens left when all are cut at this limit), cut_tokens,
    quantile (share of documents within the limit).

    Sums run within blocks of ``BLOCK`` lengths and over the blocks' totals, so
    no task sees more than a block or the list of blocks.  The list of blocks is
    one row per ``BLOCK`` lengths up to the longest text, whatever the number of
    documents.  ``histogram`` is read twice: pass a written table.
    """
    base = histogram.withColumns({"block": F.floor(F.col("length") / BLOCK), "n_tokens": F.col("length") * F.col("n_docs")})
    totals = base.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    after = Window.partitionBy(F.lit(0)).orderBy("block")
    every = after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = after.rowsBetween(1, Window.unboundedFollowing)
    blocks = totals.select(
        "block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"), F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens")
    )
    within = Window.partitionBy("block").orderBy("length").rowsBetween(1, Window.unboundedFollowing)
    out = base.withColumns({f"{c}_own": F.coalesce(F.sum(n).over(within), F.lit(0)) for c, n in (("d", "n_docs"), ("t", "n_tokens"))}).join(blocks, "block")
    out = out.withColumns({"docs_over": F.col("d_own") + F.col("d_later"), "tokens_over": F.col("t_own") + F.col("t_later")})
    truncated = F.col("total_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("length")
    return out.select(
        "length",
        "n_docs",
        "n_tokens",
        "docs_over",
        (F.col("total_docs") - F.col("docs_over")).alias("docs_within"),
        (F.col("total_tokens") - F.col("tokens_over")).alias("tokens_within"),
        "total_docs",
        "total_tokens",
        truncated.alias("truncated_total"),
        (F.col("total_tokens") - truncated).alias("cut_tokens"),
        F.round((F.col("total_docs") - F.col("docs_over")) / F.col("total_docs"), 9).alias("quantile"),
    )


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The histogram of ``docs`` with its suffix sums; see ``limit_totals``.

    Null and empty texts have length 0.  Each row counts, repeated ones too;
    an empty table gives no rows.  Other columns are ignored.  ``vocabulary``
    must be readable on the driver; executors get it by broadcast.
    """
    return limit_totals(materialize(length_histogram(docs, vocabulary), "histogram"))


def at_limits(totals: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for arbitrary context limits: (limit, docs_within, truncated_total)."""
    asked = totals.sparkSession.createDataFrame([(x,) for x in limits], "limit long")
    below = totals.join(F.broadcast(asked), F.col("length") <= F.col("limit")).groupBy("limit").agg(F.max_by(F.struct("docs_within", "tokens_within", "docs_over", "total_docs", "total_tokens"), "length").alias("x"))
    whole = totals.agg(F.max("total_docs").alias("all_docs"))
    return asked.join(below, "limit", "left").join(F.broadcast(whole)).select(
        "limit", F.coalesce("x.docs_within", F.lit(0)).alias("docs_within"), F.coalesce(F.col("x.tokens_within") + F.col("x.docs_over") * F.col("limit"), F.col("limit") * F.coalesce("all_docs", F.lit(0))).alias("truncated_total")
    )

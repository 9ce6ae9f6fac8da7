"""Canonical exact fingerprints of documents.

A text is normalised (NFKC, case folding, NFKC again, white space folded to
single blanks and trimmed) and digested by 128-bit xxhash.  Equal canonical
texts have equal fingerprints.  Inside each digest bucket with more than one
document the canonical bytes are compared; should different bytes ever share a
digest, each further variant gets its number in byte order as a suffix.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, small_batches

#: Ranges of ids per shuffle partition when neighbours are brought together.
RANGES_PER_PARTITION = 6


def canonical(text: str | None) -> str:
    """The canonical form; null counts as the empty text."""
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def digest(form: str) -> str:
    return xxhash.xxh3_128_hexdigest(form.encode("utf-8", "surrogatepass"))


def _digest_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [digest(canonical(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.string())], ["doc_id", "digest"])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) per row of ``docs``."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.transform(small_batches).mapInArrow(_digest_all, "doc_id long, digest string")


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/3) code points replaced by the first as many of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


#: Order of rows of one id within a range: bucket marks, the text, and last of all the next range's first text.
_MARK, _TEXT, _BORDER = 0, 1, 2


def _range(limits: np.ndarray, i: int | None) -> int:
    """Number of the id's range, 0 for a missing id."""
    return 0 if i is None else int(np.searchsorted(limits, i, "right")) + 1


def _place(bounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = [_range(bounds.value, i) for i in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), batch.column("doc_id"), batch.column("digest")], ["range", "doc_id", "digest"])

    return run


def _deal(bounds, tops):
    """Rows (range, border, doc_id, kind, packed text); the first text of a range also goes to the range above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        limits, first_of = bounds.value, tops.value
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                packed = pack.compress((text or "").encode("utf-8", "surrogatepass"))
                r = _range(limits, i)
                rows.append((r, 0, i, _TEXT, packed))
                if first_of.get(r, ("none",))[0] == i:
                    rows.append((first_of[r][1], 1, i, _BORDER, packed))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], ["range", "border", "doc_id", "kind", "packed"])

    return run


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in descending id order, each with the one that follows it."""
    unpack = zstandard.ZstdDecompressor()
    held, marked, marked_id, out = None, None, None, []
    names = ["doc_id", "n_chars", "edited_sha256", "digest", "edited_digest", "same_edited", "same_next", "bytes"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.binary())

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names)

    def finish(now, following: str, following_form: str):
        r, i, text, form = now
        changed = edited(text, following)
        changed_form = canonical(changed)
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        held_bytes = zstandard.compress(form.encode("utf-8", "surrogatepass")) if (r, i) == marked_id else None
        out.append((i, len(text), sha, digest(form), digest(changed_form), changed_form == form, following_form == form, held_bytes))

    for batch in batches:
        for r, border, i, kind, packed in zip(*(batch.column(c).to_pylist() for c in ("range", "border", "doc_id", "kind", "packed")), strict=True):
            if kind == _MARK:
                marked = (r, i)
                continue
            if held is None and border:
                continue
            text = unpack.decompress(packed).decode("utf-8", "surrogatepass")
            form = canonical(text)
            if held is not None and held[0] == r:
                finish(held, text, form)
            held = None if border else (r, i, text, form)
            marked_id = marked
        if out:
            yield flush()
            out.clear()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) per row of ``docs``, with byte comparison inside equal buckets.

    Null texts count as empty.  Repeated rows get equal fingerprints; rows
    without doc_id are fingerprinted too.  An empty table gives no rows.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [canonical(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([digest(f) for f in forms], pa.string()), pa.array([f.encode("utf-8", "surrogatepass") for f in forms], pa.binary())], ["doc_id", "digest", "bytes"])

    held = slim.transform(small_batches).mapInArrow(run, "doc_id long, digest string, bytes binary")
    return held.join(variants(held), ["digest", "bytes"], "left").select("doc_id", F.concat("digest", F.coalesce("suffix", F.lit(""))).alias("fingerprint"))


def variants(held: DataFrame) -> DataFrame:
    """(digest, bytes, suffix) of buckets that hold different bytes; first variant: no suffix."""
    distinct = held.filter("bytes is not null").groupBy("digest", "bytes").agg(F.count("*").alias("n"))
    shared = distinct.groupBy("digest").agg(F.count("*").alias("v")).filter("v > 1").select("digest")
    clash = distinct.join(shared, "digest")
    number = F.row_number().over(Window.partitionBy("digest").orderBy("bytes")) - 1
    return clash.select("digest", "bytes", F.when(number > 0, F.concat(F.lit("-"), number.cast("string"))).otherwise("").alias("suffix"))


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next).  The next document is the one of next smaller
    doc_id, after the smallest the greatest; rows of one id follow each other
    in the order of their packed bytes, rows without id come last.  A single
    row is its own next.  Fingerprints are exact, so a likeness is 1 for equal
    and 0 for different canonical texts, whose bytes are compared.  Null texts are empty; an empty table
    gives no rows; other columns are ignored.

    The ids are cut into ranges at quantiles (a bounded list); each range meets
    in one task with the first text of the range below, so texts are shuffled
    once; rows of one id, and those without id, lie in one range, as ids are
    keys here.  Canonical bytes leave a task only for digests that occur twice.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = materialize(digests(docs), "digests")
    parts = shuffle_partitions(spark)
    n = parts * RANGES_PER_PARTITION
    cuts = known.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n)
    limits = np.unique(np.array(cuts, np.int64))
    broadcast = spark.sparkContext.broadcast
    bounds = broadcast(limits)
    known = known.mapInArrow(_place(bounds), "range int, doc_id long, digest string")
    found = known.groupBy("range").agg(F.max("doc_id").alias("top")).orderBy(F.desc("range")).collect()
    above = {found[k]["range"]: (found[k]["top"], found[k - 1]["range"]) for k in range(len(found))}
    shared = known.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    marks = known.join(shared, "digest", "left_semi").select(
        "range", F.lit(0).alias("border"), "doc_id", F.lit(_MARK).alias("kind"), F.lit(None).cast("binary").alias("packed")
    )
    texts = slim.transform(small_batches).mapInArrow(_deal(bounds, broadcast(above)), "range int, border int, doc_id long, kind int, packed binary")
    dealt = texts.unionByName(marks.distinct()).repartition(parts, "range").sortWithinPartitions(F.asc("range"), F.asc("border"), F.desc_nulls_last("doc_id"), F.asc("kind"), F.asc("packed"))
    walked = materialize(dealt.mapInArrow(_walk, "doc_id long, n_chars long, edited_sha256 string, digest string, edited_digest string, same_edited boolean, same_next boolean, bytes binary"), "walked")
    suffix = variants(walked)
    own = walked.join(suffix, ["digest", "bytes"], "left")
    fingerprint = F.concat("digest", F.coalesce("suffix", F.lit("")))
    return own.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint.alias("fingerprint"),
        F.when(F.col("same_edited"), fingerprint).when(F.col("edited_digest") == F.col("digest"), F.concat(fingerprint, F.lit("-edited"))).otherwise(F.col("edited_digest")).alias("edited_fingerprint"),
        F.col("same_edited").cast("int").cast("double").alias("near_edited"),
        F.col("same_next").cast("int").cast("double").alias("near_next"),
    )

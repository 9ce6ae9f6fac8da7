"""Which filter removes what, in every order of the filters.

The replay is relational: each document's failures are one integer of flags; the
flags meet the 120 orders of five filters, which are broadcast, each order's five
steps are exploded, and a document is removed at the step of its first failure.
Sums of conditions are combined inside each task before the shuffle, so that
what is shuffled is 600 rows for each part and task, however many documents a
part has.  Texts are read once: what the replay needs of them (flags, a digest)
is written to the shared folder first.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

_SPACE = r"[\x20\x09-\x0D]+"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column, min_words: int = 200, distinct_percent: int = 50, capitals_percent: int = 2) -> dict[str, Column]:
    """The conditions under which a whole text fails by itself, by the filter's letter.

    A: under ``min_words`` words; B: distinct words under ``distinct_percent`` of
    the words; C: A-Z over ``capitals_percent`` of the code points; D: holds any
    of ``#$%&*|``.  The empty text fails A alone.
    """
    words = F.array_remove(F.split(text, _SPACE), "")
    n, chars = F.size(words), F.char_length(text)
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < min_words,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < distinct_percent * n.cast("long"),
        "C": 100 * capitals.cast("long") > capitals_percent * chars.cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _bits(failures: dict[str, Column]) -> Column:
    return sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(failures.values())), F.lit(0))


def failure_flags(documents: DataFrame) -> DataFrame:
    """(doc_id, part, flags) per row of ``documents``: bits 0 to 4 are set where filters A to E fail.

    E fails where a row with a smaller doc_id has the same text; rows without
    doc_id neither fail it nor make others fail.  Texts are equal if their
    SHA-256 is.  Only texts that occur more than once are joined back, as a
    table, so that a text that a third of all rows share can be split.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    heads = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    heads = heads.select("doc_id", "part", _bits(text_failures(F.col("text"))).alias("own"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    heads = materialize(heads, "heads")
    firsts = heads.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    joined = heads.join(materialize(firsts, "firsts"), "digest", "left")
    return joined.select("doc_id", "part", (F.col("own") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)).alias("flags"))


def with_marks(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """``flagged`` with good and toxic (0 or 1): whether any row of ``labels`` says so of the doc_id."""
    said = labels.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    said = materialize(said.filter("labelled is not null and good + toxic > 0"), "marks")
    joined = flagged.join(said, F.col("doc_id") == F.col("labelled"), "left")
    return joined.select(*flagged.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def replay(marked: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """Every order of the filters ``letters``, step by step, over ``marked`` (part, flags, good, toxic).

    (part, filter_order, step, filter, the counts, shapley) for every part,
    order and step, zeros included.  Bit k of flags is set where the k-th letter
    fails.  The orders are a table of n! rows: of few filters only.
    """
    steps = range(len(letters))
    orders = [("".join(letters[k] for k in p), *(1 << k for k in p)) for p in permutations(steps)]
    bits = [F.col(f"bit{s}") for s in steps]
    table = marked.sparkSession.createDataFrame(orders, ["filter_order", *(f"bit{s}" for s in steps)]).select(F.monotonically_increasing_id().alias("order"), "filter_order", *(b.cast("int").alias(f"bit{s}") for s, b in zip(steps, bits, strict=True)))
    first = F.lit(len(letters))
    for s in reversed(steps):
        first = F.when(F.col("flags").bitwiseAND(bits[s]) != 0, s).otherwise(first)
    crossed = marked.crossJoin(F.broadcast(table)).select("part", "order", "flags", "good", "toxic", first.alias("first"), F.array(*bits).alias("bits"))
    rows = crossed.select("part", "order", "flags", "good", "toxic", "first", F.posexplode("bits").alias("at", "bit"))
    at, stopped = F.col("at"), F.col("first")
    conditions = {
        "kept": stopped > at,
        "removed": stopped == at,
        "redundant": (stopped < at) & (F.col("flags").bitwiseAND(F.col("bit")) != 0),
        "unique_fails": F.col("flags") == F.col("bit"),
        "good_lost": (stopped == at) & (F.col("good") == 1),
        "toxic_lost": (stopped == at) & (F.col("toxic") == 1),
    }
    counts = rows.groupBy("part", "order", "at").agg(*(F.sum(F.when(conditions[c], 1).otherwise(0)).cast("long").alias(c) for c in _COUNTS))
    named = counts.join(F.broadcast(table.select("order", "filter_order")), "order").withColumn("filter", F.expr("substring(filter_order, at + 1, 1)"))
    total = F.expr("sum(removed) OVER (PARTITION BY part, filter)").cast("long")
    return named.select("part", "filter_order", (at + 1).cast("int").alias("step"), "filter", *_COUNTS, total.alias("shapley"))


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over whole ``documents``, by source.

    A null source is the empty one, a null text the empty text; of equal rows
    (same doc_id and text) none is a copy of the other; a doc_id that ``labels``
    repeats counts as good or toxic if any of its rows says so, and null labels
    say nothing.  An empty table gives no rows; other columns are ignored, and
    a text may have any length.
    """
    return replay(with_marks(failure_flags(documents), labels))

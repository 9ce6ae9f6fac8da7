"""Cheapest repairs of conversations whose turns are missing, blank, repeated, cut or misattributed.

A repaired conversation is empty, or an optional system turn and then user and
assistant in turn.  Its rows that are kept or reroled are a subsequence of the
rows found; the dynamic programme runs over that retained subsequence.  What lies
between two retained rows is deleted, which prefix sums price, and what the two
roles lack between them is inserted, so that the best predecessor of each role is
a running minimum of cost less deletions up to it.  Equal costs go to the audit
(the initials of the edits) that is least.  Audits need not be compared in full:
two audits over the same rows are equal or differ before either ends, so what
comes behind never changes their order, and a rank for each state is enough.

Spark brings a conversation's rows together in order; a task streams through
them and holds, for one conversation, the edits (a few numbers a row) and
digests of the rows seen, but no texts: the repaired text of each state is
hashed as it grows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, shuffle_partitions, small_batches

ROLES = {"u": b"user", "a": b"assistant"}
#: Inserted roles between the last retained role (or none, "") and the next.
GAPS = {("", "s"): "", ("", "u"): "", ("", "a"): "u", ("s", "u"): "", ("s", "a"): "u", ("u", "u"): "a", ("u", "a"): "", ("a", "u"): "", ("a", "a"): "u"}
#: Inserted roles behind the last retained one.
TAILS = {"": "", "s": "ua", "u": "a", "a": ""}


@dataclass(frozen=True)
class Prices:
    """What an edit costs; ``cut`` is added for a truncated row that stays."""

    rerole: int = 2
    delete: int = 3
    insert: int = 2
    cut: int = 1


class _Path:
    """The best way to one state: cost less deletions so far, its rank among the states, its edits and the digest of its text."""

    __slots__ = ("price", "rank", "edits", "digest", "empty")

    def __init__(self, price, rank, edits, digest, empty):
        self.price, self.rank, self.edits, self.digest, self.empty = price, rank, edits, digest, empty


def _added(digest, empty: bool, turns: list[tuple[bytes, bytes]]):
    """A copy of ``digest`` after ``role:text`` of ``turns``, joined by line breaks."""
    digest = digest.copy()
    for role, text in turns:
        digest.update((b"" if empty else b"\n") + role + b":")
        digest.update(text)
        empty = False
    return digest


class Repair:
    """Repairs one conversation, row by row: ``add`` each, then ``result``."""

    def __init__(self, prices: Prices = Prices()):
        self.prices, self.rows, self.deleted = prices, 0, 0
        self.paths = {"": _Path(0, 0, None, hashlib.sha256(), True)}

    def add(self, role: bytes, text: bytes, lost: bool, cut: bool) -> None:
        """``lost`` rows must be deleted; ``cut`` ones are truncated."""
        p, row, before = self.prices, self.rows, self.deleted
        self.rows, self.deleted = row + 1, before + p.delete
        best = {q: (path.price, path.rank, "D", q, "") for q, path in self.paths.items()}
        if not lost:
            for (q, r), roles in GAPS.items():
                path = self.paths.get(q)
                kept = role[:1].decode("latin-1") == r
                if path is None or (r == "s" and not kept):
                    continue
                edit, price = ("K", 0) if kept else ("R", p.rerole)
                price += path.price + before - self.deleted + p.insert * len(roles) + (p.cut if cut else 0)
                way = (price, path.rank, "I" * len(roles) + edit, q, roles)
                if r not in best or way < best[r]:
                    best[r] = way
        ranks = {r: k for k, r in enumerate(sorted(best, key=lambda r: best[r][1:3]))}
        paths = {}
        for r, (price, _, edit, q, roles) in best.items():
            path = self.paths[q]
            if edit == "D":
                paths[r] = _Path(price, ranks[r], path.edits, path.digest, path.empty)
            else:
                turns = [(ROLES[x], b"") for x in roles] + [(role if edit[-1] == "K" else ROLES[r], text)]
                paths[r] = _Path(price, ranks[r], (path.edits, row, edit), _added(path.digest, path.empty, turns), False)
        self.paths = paths

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, lower-case hex digest of the repaired text)."""
        ends = {q: path.price + self.deleted + self.prices.insert * len(TAILS[q]) for q, path in self.paths.items()}
        q = min(ends, key=lambda q: (ends[q], self.paths[q].rank))
        path, tail, after = self.paths[q], TAILS[q], self.rows
        parts, edits = ["I" * len(tail)], path.edits
        while edits:
            edits, row, edit = edits
            parts += ["D" * (after - row - 1), edit]
            after = row
        parts.append("D" * after)
        digest = _added(path.digest, path.empty, [(ROLES[x], b"") for x in tail])
        return ends[q], "".join(reversed(parts)), digest.hexdigest()


_SPACE = b" \t\n\v\f\r"
_STOPS = (b".", b"!", b"?")
_PAIRS = {b"su", b"ua", b"au"}
_COLUMNS = (("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()))
SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def first_fault(role: bytes, text: bytes, seen: set[bytes]) -> str:
    """The row's first fault, or nothing; ``seen`` holds 128-bit digests of the rows before it and gets this one's."""
    body = text.strip(_SPACE)
    key = xxhash.xxh3_128_digest(len(role).to_bytes(8, "little") + role + text)
    again = key in seen
    seen.add(key)
    return "blank" if not body else "duplicate" if again else "" if body.endswith(_STOPS) else "truncated"


class _Report:
    """One conversation's counts and its repair."""

    def __init__(self, conv_id: int | None, prices: Prices):
        self.conv_id, self.repair, self.seen = conv_id, Repair(prices), set()
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.low = self.high = self.turn = self.initial = None
        self.distinct = self.illegal = 0

    def add(self, turn: int | None, role: bytes, text: bytes) -> None:
        fault = first_fault(role, text, self.seen)
        if fault:
            self.faults[fault] += 1
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turn, self.distinct = turn if self.low is None else self.low, turn, turn, self.distinct + 1
        initial = role.decode()[:1].encode()
        self.illegal += self.initial is not None and self.initial + initial not in _PAIRS
        self.initial = initial
        self.repair.add(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return self.conv_id, gaps, *self.faults.values(), self.illegal, *self.repair.result()


def _streamed(prices: Prices, batch_rows: int = 4_096):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *(k for _, k in _COLUMNS)]
        names = ["conv_id", *(n for n, _ in _COLUMNS)]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        now, done = None, []
        for batch in batches:
            ids, turns, present = (batch.column(n).to_pylist() for n in ("conv_id", "turn", "present"))
            for conv_id, turn, here, role, text in zip(ids, turns, present, column_bytes(batch, "role"), column_bytes(batch, "text"), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now:
                        done.append(now.row())
                    now = _Report(conv_id, prices)
                if here:
                    now.add(turn, role, text)
                if len(done) >= batch_rows:
                    yield packed(done)
                    done = []
        if now:
            done.append(now.row())
        if done:
            yield packed(done)

    return run


def _told() -> list[Column]:
    """The four columns; a null role or text is one space."""
    return [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))]


def repair_conversations(conversations: DataFrame, prices: Prices = Prices(), present: str | None = None) -> DataFrame:
    """A row of ``SCHEMA`` per conversation: its faults and the cheapest repair.

    Rows are taken by turn, null turns first, equal turns by role and text.
    Null roles and texts are one space; a null conv_id is a conversation of its
    own; repeated rows are duplicates; an empty table gives no rows; other
    columns are ignored.  ``present`` names a column that is false in rows that
    only name their conversation.
    """
    rows = conversations.select(*_told(), (F.col(present) if present else F.lit(True)).alias("present"))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*order)
    return small_batches(dealt).select("conv_id", "turn", "role", "text", "present").mapInArrow(_streamed(prices), SCHEMA)


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text, present) with known faults, the same at every run.

    The CRC-32 of ``conv_id:turn`` modulo 20 chooses: 0 drops the row (it stays,
    without text, as one that is not present), 1 empties its text, 2 removes
    ``[.!?]``, 3 repeats the row, 4 sets the role user.  A null counts as one
    space in each place.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.col("fault")
    text = F.when(fault < 2, "").when(fault == 2, F.regexp_replace("text", "[.!?]+", "")).otherwise(F.col("text"))
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.select(*_told()).withColumn("fault", F.crc32(key.cast("binary")) % 20)
    rows = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (fault != 0).alias("present"), F.explode(copies).alias("copy"))
    return rows.drop("copy")


def repair_report(conversations: DataFrame) -> DataFrame:
    """``repair_conversations`` of the damaged table; conversations that lose all rows have zeros and the digest of nothing."""
    return repair_conversations(damage(conversations), present="present")

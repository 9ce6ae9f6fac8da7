"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``VIRTUAL_NODES`` nodes on a ring of 2**32 places; the arc that
ends at a node belongs to the node's shard.  A shard's room is its equal share of
the rows, times 1 + ``slack``: without slack counts differ by one at most (law
``rows``).  Keys that find their shard full continue clockwise to the next arc
whose shard has room, first come first served.  The walk needs only the number
of keys in each part of an arc; each row then finds its place by its rank within
the part.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING_BITS = 32
VIRTUAL_NODES = 64
#: Parts of an arc, by a hash of key and tie: rows of one hot key are spread over them.
PARTS = 16


def _position(key: str) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16)


def ring_arcs(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(last place, shard) of each arc in clockwise order; places after the last arc belong to the first.

    Of nodes at one place the smallest shard's counts; a shard that would be
    left without any arc so is an error.
    """
    first: dict[int, int] = {}
    for s in range(shards):
        for v in range(virtual_nodes):
            first.setdefault(_position(f"shard-{s}-node-{v}"), s)
    arcs = sorted(first.items())
    if len({s for _, s in arcs}) < shards:
        raise ValueError(f"{shards} shards with {virtual_nodes} virtual nodes each don't fit on the ring")
    return arcs


def rooms(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """The most rows of each shard: equal to within one, enough for ``total`` rows together."""
    capacity = max(total, int(total * (1 + slack)))
    return [capacity // shards + (s < capacity % shards) for s in range(shards)]


def plan(counts: dict[int, int], owners: list[int], room: list[int]) -> list[dict[str, int]]:
    """Segments {unit, lo, hi, shard, slot}: ranks lo..hi-1 of a unit go to ``shard`` from ``slot`` on.

    ``counts``: rows of each unit; ``owners``: the shard of each unit in
    clockwise order.  Every row gets a place, or the plan is an error.
    """
    used = [0] * len(room)
    out: list[dict[str, int]] = []
    waiting: deque[tuple[int, int, int]] = deque()

    def take(unit: int, lo: int, hi: int, shard: int) -> int:
        n = min(hi - lo, room[shard] - used[shard])
        if n > 0:
            out.append({"unit": unit, "lo": lo, "hi": lo + n, "shard": shard, "slot": used[shard]})
            used[shard] += n
        return lo + max(n, 0)

    for turn in range(2):
        for unit, shard in enumerate(owners):
            n = 0 if turn else counts.get(unit, 0)
            rest = take(unit, 0, n, shard)
            while waiting and used[shard] < room[shard]:
                u, lo, hi = waiting.popleft()
                if (lo := take(u, lo, hi, shard)) < hi:
                    waiting.appendleft((u, lo, hi))
            if rest < n:
                waiting.append((unit, rest, n))
    if sum(used) != sum(counts.values()):
        raise AssertionError(f"{sum(counts.values()) - sum(used)} rows found no shard")
    return out


def ring_position(key: Column) -> Column:
    """Place of a key on the ring, 0 to 2**32 - 1; a null key is the empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def _table(spark, rows: list[dict[str, int]], kind: str) -> DataFrame:
    """A table bounded by the ring, by SQL functions alone."""
    chunks = [json.dumps(rows[i : i + 20_000]) for i in range(0, len(rows), 20_000)] or ["[]"]
    return spark.range(1).select(F.explode(F.array(*map(F.lit, chunks))).alias("j")).select(F.inline(F.from_json("j", f"array<struct<{kind}>>")))


def _pieces(arcs: list[tuple[int, int]]) -> tuple[int, list[dict[str, int]]]:
    """Bits to drop from a place for its cell, and the parts of arcs {cell, from, to, arc} in each cell.

    Cells are about as many as arcs, so a place is found by an equality join
    that leaves one or two candidates.
    """
    shift = RING_BITS - max(len(arcs) - 1, 1).bit_length()
    ends = [p for p, _ in arcs]
    out = []
    for cell in range(1 << (RING_BITS - shift)):
        lo, last = cell << shift, ((cell + 1) << shift) - 1
        while lo <= last:
            k = bisect_left(ends, lo)
            hi = min(ends[k], last) if k < len(ends) else last
            out.append({"__cell": cell, "__from": lo, "__to": hi, "__arc": k % len(ends)})
            lo = hi + 1
    return shift, out


def assign_shards(rows: DataFrame, shards: int = 8, key: str = "doc_id", tie: tuple[str, ...] = (), virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0) -> DataFrame:
    """``rows`` with shard and slot (gapless from 0 within a shard).

    Rows with equal keys lie at one place of the ring and are told apart by the
    ``tie`` columns; rows equal in all of these may change places.  Null keys
    count as one key.  An empty table gives no rows; every row of another gets
    a place.  Columns named shard or slot are replaced.  The driver holds the
    ring, ``shards`` * ``virtual_nodes`` * ``PARTS`` counts, whatever the number
    of rows.  ``slack``: how far a shard may exceed its equal share, as a part
    of it; more slack moves fewer keys when a shard is added.
    """
    spark = rows.sparkSession
    arcs = ring_arcs(shards, virtual_nodes)
    shift, pieces = _pieces(arcs)
    own = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, *tie)))
    part = F.conv(F.substring(F.md5(own.cast("binary")), 9, 4), 16, 10).cast("int") % PARTS
    at = rows.drop("shard", "slot").withColumns({"__at": ring_position(F.col(key)), "__part": part})
    at = at.withColumn("__cell", F.shiftright("__at", shift).cast("int"))
    # Both broadcast tables are bounded by the ring.
    found = F.broadcast(_table(spark, pieces, "__cell:int,__from:long,__to:long,__arc:int"))
    at = at.join(found, "__cell").filter(F.col("__at").between(F.col("__from"), F.col("__to"))).withColumn("__unit", F.col("__arc") * PARTS + F.col("__part"))
    at = at.drop("__cell", "__from", "__to", "__arc", "__part")
    counts = {r["__unit"]: r["n"] for r in at.groupBy("__unit").agg(F.count("*").alias("n")).collect()}
    segments = plan(counts, [s for _, s in arcs for _ in range(PARTS)], rooms(sum(counts.values()), shards, slack))
    named = [{f"__{k}": v for k, v in s.items()} for s in segments]
    table = _table(spark, named, "__unit:int,__lo:long,__hi:long,__shard:int,__slot:long")
    rank = F.row_number().over(Window.partitionBy("__unit").orderBy("__at", key, *tie)) - 1
    placed = at.withColumn("__rank", rank).join(F.broadcast(table), "__unit").filter((F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))
    out = placed.withColumns({"shard": F.col("__shard"), "slot": F.col("__slot") + F.col("__rank") - F.col("__lo")})
    return out.drop("__unit", "__at", "__rank", "__lo", "__hi", "__shard", "__slot")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row of ``docs``.

    size: UTF-8 bytes of the text plus 1, a null text has none.  An empty table
    gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return assign_shards(slim, shards, tie=("size", "text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

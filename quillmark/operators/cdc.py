"""Change detection, COALESCE upserts and the audit log.

Records have the columns of ``CONTENT_FIELDS`` and ``scope``; arrays may come in
any order.  Everything is one join of the stored and the fresh table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of the content hash, and what counts as gone.
CONTENT_FIELDS = ("title", "year", "status", "division", "amendments", "normative_references", "certification", "supersedes")
LISTS = ("amendments", "normative_references")
GONE = ("withdrawn", "superseded")
AUDITED = ("title", "year", "status", "amendments", "certification")
# Which change names a record's change, in two published orders.
PRECEDENCE = {
    "detector": ("withdrawn", "scope", "references", "certification", "metadata"),
    "trigger": ("withdrawn", "certification", "scope", "references", "amendment", "metadata"),
}


def _canonical(side: str, field: str) -> Column:
    value = F.col(f"{side}.{field}")
    if field in LISTS:
        return F.array_sort(F.coalesce(value, F.lit(None)))
    return F.trim(value) if field in ("title", "status", "division", "supersedes") else value


def _json(fields: list[Column]) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def content_hash(record: str = "r") -> Column:
    """SHA-256 over the content fields in fixed order, lists sorted, nulls kept."""
    return F.sha2(_json([_canonical(record, f).alias(f) for f in sorted(CONTENT_FIELDS)]), 256)


def scope_hash(record: str = "r") -> Column:
    """SHA-256 over trimmed title and scope, the text that is embedded."""
    parts = [F.trim(F.coalesce(F.col(f"{record}.{c}"), F.lit(""))).alias(c) for c in ("scope", "title")]
    return F.sha2(_json(parts), 256)


def with_hashes(records: DataFrame) -> DataFrame:
    r = records.alias("r")
    return r.select("r.*", content_hash().alias("content_hash"), scope_hash().alias("scope_hash"))


def _was_gone(side: str) -> Column:
    return F.coalesce(F.col(f"{side}.status").isin(*GONE), F.lit(False))


def detect_changes(fresh: DataFrame, stored: DataFrame, key: str = "is_number", legacy_gates: bool = False) -> DataFrame:
    """(key, change_type, changed_fields, reembed, update_graph) for each fresh record.

    Both tables carry their hashes.  Gates follow the changed fields; with
    ``legacy_gates`` they follow the named change alone.
    """
    n, s = fresh.alias("n"), stored.alias("s")
    joined = n.join(s, F.col(f"n.{key}") == F.col(f"s.{key}"), "left")
    new = F.col(f"s.{key}").isNull()
    same = F.col("n.content_hash").eqNullSafe(F.col("s.content_hash")) & F.col("n.scope_hash").eqNullSafe(F.col("s.scope_hash"))
    differs = [F.when(~_canonical("n", f).eqNullSafe(_canonical("s", f)), F.lit(f)) for f in CONTENT_FIELDS]
    differs.append(F.when(~F.col("n.scope_hash").eqNullSafe(F.col("s.scope_hash")), F.lit("scope")))
    none = F.array().cast("array<string>")
    changed = F.when(new, F.array(F.lit("*"))).when(same, none).otherwise(F.array_compact(F.array(*differs)))
    out = joined.select(F.col(f"n.{key}").alias(key), new.alias("__new"), same.alias("__same"), changed.alias("changed_fields"), (_was_gone("n") & ~_was_gone("s")).alias("__gone"))
    has = lambda f: F.array_contains("changed_fields", f)
    kind = (
        F.when(F.col("__new"), "new").when(F.col("__same"), "unchanged").when(F.col("__gone"), "withdrawn").when(has("scope"), "scope").when(has("normative_references"), "references").when(has("certification"), "certification").otherwise("metadata")
    )
    out = out.withColumn("change_type", kind)
    if legacy_gates:
        embed, graph = F.col("change_type").isin("new", "scope"), F.col("change_type").isin("new", "references", "withdrawn")
    else:
        embed = F.col("__new") | has("scope")
        graph = F.col("__new") | has("normative_references") | (F.col("change_type") == "withdrawn")
    return out.select(key, "change_type", "changed_fields", embed.alias("reembed"), graph.alias("update_graph"))


def _filled(value: Column, kind: str) -> Column:
    """Null where an incoming array is empty or an incoming struct is."""
    return F.when(F.size(value) > 0, value) if kind.startswith("array") else value


def upsert(stored: DataFrame, fresh: DataFrame, key: str = "is_number", now: Column | None = None) -> DataFrame:
    """Stored table after the fresh rows: new value, else old value.

    Empty lists count as missing, quality is the greater one, sources are
    united, a status that is absent keeps the old one, last_seen is ``now`` for
    rows that were seen.  Rows that only one side has pass through.
    """
    now = F.current_timestamp() if now is None else now
    s, n = stored.alias("s"), fresh.alias("n")
    joined = s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full")
    seen = F.col(f"n.{key}").isNotNull()
    kinds = dict(stored.dtypes)
    out = []
    for c in stored.columns:
        old = F.col(f"s.{c}")
        new = F.col(f"n.{c}") if c in fresh.columns else F.lit(None).cast(kinds[c])
        if c == "last_seen":
            out.append(F.when(seen, now).otherwise(old).alias(c))
        elif c == "extraction_quality":
            out.append(F.greatest(new, old).alias(c))
        elif c == "sources":
            out.append(F.array_distinct(F.concat(F.coalesce(old, F.array().cast(kinds[c])), F.coalesce(new, F.array().cast(kinds[c])))).alias(c))
        elif c == "raw_designation":
            out.append(F.coalesce(old, new).alias(c))
        else:
            out.append(F.coalesce(_filled(new, kinds[c]), old).alias(c))
    return joined.select(*out)


def audit(stored: DataFrame, fresh: DataFrame, key: str = "is_number", precedence: str = "trigger") -> DataFrame:
    """(key, change_type, old_values, new_values) of updates whose hashes changed; inserts are not audited."""
    s, n = stored.alias("s"), fresh.alias("n")
    joined = n.join(s, F.col(f"n.{key}") == F.col(f"s.{key}"))
    moved = ~F.col("n.content_hash").eqNullSafe(F.col("s.content_hash")) | ~F.col("n.scope_hash").eqNullSafe(F.col("s.scope_hash"))
    tests = {
        "withdrawn": _was_gone("n") & ~_was_gone("s"),
        "certification": ~F.col("n.certification").eqNullSafe(F.col("s.certification")),
        "scope": ~F.col("n.scope_hash").eqNullSafe(F.col("s.scope_hash")),
        "references": ~F.col("n.normative_references").eqNullSafe(F.col("s.normative_references")),
        "amendment": F.size("n.amendments") > F.size("s.amendments"),
        "metadata": F.lit(True),
    }
    kind = F.coalesce(*(F.when(tests[k], k) for k in PRECEDENCE[precedence]))
    image = {side: _json([F.col(f"{side}.{c}").alias(c) for c in AUDITED]) for side in "sn"}
    return joined.filter(moved).select(F.col(f"n.{key}").alias(key), kind.alias("change_type"), image["s"].alias("old_values"), image["n"].alias("new_values"))


def recent_changes(log: DataFrame, standards: DataFrame, since: Column, limit: int = 500, key: str = "is_number") -> DataFrame:
    """Audit rows since a time, newest first, with today's titles; ties by key."""
    titled = log.join(standards.select(key, "title"), key, "left").filter(F.col("changed_at") >= since)
    return titled.orderBy(F.desc("changed_at"), key).limit(limit)

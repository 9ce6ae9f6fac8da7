"""Merging of records: arrival-order folds, two tiers, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import truthy

# Fields whose last value wins when departments are merged.
LAST_WINS = ("aspect", "revision_count", "department_alias", "department_name", "department_id", "valid_upto")
#: Catalogue fields that fill gaps of an enriched record.
TIER_FILL = ("published_on", "valid_upto", "department_name", "division", "aspect", "degree_of_equivalence", "title_hindi")


def merge_arrivals(rows: DataFrame, key: str, seq: str, fields: list[str], last_wins: tuple[str, ...] = LAST_WINS, queries: str | None = "matched_queries", also: dict[str, Column] | None = None) -> DataFrame:
    """One row per ``key``: the first arrival, its gaps filled by later ones.

    Fields in ``last_wins`` take the last value that is not null, the others the
    first; ``queries`` (an array) becomes the ordered union.  With an empty
    ``last_wins`` this is the keyword merge.  ``also``: further aggregates by name.
    """
    picked = [(F.max_by if f in last_wins else F.min_by)(F.col(f), F.when(F.col(f).isNotNull(), F.col(seq))).alias(f) for f in fields]
    out = rows.groupBy(key).agg(*picked, F.count("*").alias("arrivals"), *(c.alias(n) for n, c in (also or {}).items()))
    if not queries:
        return out
    values = rows.select(F.col(key).alias("__k"), F.col(seq).alias("__s"), F.posexplode(queries).alias("__p", "__v"))
    united = ordered_union(values, "__k", "__v", F.struct("__s", "__p")).withColumnRenamed("__v", queries)
    joined = out.join(united, F.col(key).eqNullSafe(F.col("__k")), "left").drop("__k")
    return joined.withColumn(queries, F.coalesce(queries, F.array().cast("array<string>")))


def ordered_union(values: DataFrame, key: str, value: str, place: Column) -> DataFrame:
    """(key, value): the distinct values of each key in order of their first ``place``.

    First places are minima, combined map-side: a key of very many rows gathers
    its distinct values only.
    """
    first = values.groupBy(key, value).agg(F.min(place).alias("__place"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__place", F.col(value).alias("v")))), lambda x: x["v"]).alias(value))


def merge_counters(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """One row: raw rows, keys new to ``stored``, rows merged and keys in all."""
    fresh = rows.select(key).distinct().join(stored.select(key).distinct(), key, "left_anti")
    raw, new = rows.agg(F.count("*").alias("raw")), fresh.agg(F.count("*").alias("new"))
    total = stored.select(key).unionAll(rows.select(key)).distinct().agg(F.count("*").alias("total"))
    return raw.crossJoin(new).crossJoin(total).select("raw", "new", (F.col("raw") - F.col("new")).alias("merged"), "total")


def merge_tiers(enriched: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Unified corpus of both tiers.

    ``enriched``: is_number, canonical_key, title, status and any of TIER_FILL;
    ``catalogue``: seq, is_number, canonical_key, title, withdrawn and TIER_FILL.
    Catalogue rows with an enriched record's key are absorbed: their printed
    number is noted and their values fill gaps, the first in order first.  The
    others are appended without scope or references.
    """
    fills = [f for f in TIER_FILL if f in catalogue.columns]
    held = catalogue.join(enriched.select("canonical_key").distinct(), "canonical_key", "left_semi")
    absorbed = held.groupBy("canonical_key").agg(
        *(F.min_by(F.col(f), F.when(truthy(F.col(f).cast("string")).isNotNull(), F.col("seq"))).alias(f"__{f}") for f in fills),
    )
    absorbed = absorbed.join(ordered_union(held, "canonical_key", "is_number", F.col("seq")).withColumnRenamed("is_number", "alternate_designations"), "canonical_key")
    none = F.array().cast("array<string>")
    first = enriched.join(absorbed, "canonical_key", "left").select(
        "is_number",
        "canonical_key",
        "title",
        F.lit("enriched").alias("tier"),
        F.coalesce(truthy(F.col("status")), F.lit("current")).alias("status"),
        *(F.coalesce(truthy(F.col(f)) if f in enriched.columns else F.lit(None).cast("string"), F.col(f"__{f}")).alias(f) for f in fills),
        F.coalesce("alternate_designations", none).alias("alternate_designations"),
    )
    rest = catalogue.filter(truthy(F.col("is_number")).isNotNull()).join(enriched.select("canonical_key").distinct(), "canonical_key", "left_anti")
    second = rest.select(
        "is_number",
        "canonical_key",
        "title",
        F.lit("catalogue").alias("tier"),
        F.when(F.col("withdrawn"), "withdrawn").otherwise("current").alias("status"),
        *fills,
        none.alias("alternate_designations"),
    )
    return first.unionByName(second)


def tier_overlap(enriched: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row: catalogue rows with an enriched key, and enriched keys that the catalogue has."""
    keys = enriched.select("canonical_key").distinct()
    rows = catalogue.join(keys, "canonical_key", "left_semi").agg(F.count("*").alias("catalogue_rows"), F.countDistinct("canonical_key").alias("shared_keys"))
    exact = catalogue.join(enriched.select("is_number").distinct(), "is_number", "left_semi").agg(F.count("*").alias("exact_rows"))
    return rows.crossJoin(exact)


def preferred_version(rows: DataFrame, key: str = "canonical_key", seq: str = "seq") -> DataFrame:
    """The first row of each key, or its first current row if the first is not current."""
    order = Window.partitionBy(key).orderBy(F.col("status") != "current", seq)
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def lookup(requests: DataFrame, corpus: DataFrame) -> DataFrame:
    """Detail lookup by cascade: exact then canonical enriched, then exact then canonical catalogue.

    ``requests``: request; ``corpus``: is_number, canonical_key, tier, status, seq.
    A request that nothing matches comes back without a record.
    """
    from ..functions.ident import canonical_key

    asked = requests.withColumn("asked_key", canonical_key(F.col("request")))
    steps = [("enriched", "is_number", "request"), ("enriched", "canonical_key", "asked_key"), ("catalogue", "is_number", "request"), ("catalogue", "canonical_key", "asked_key")]
    hits = None
    for n, (tier, own, wanted) in enumerate(steps):
        side = corpus.filter(F.col("tier") == tier).select(F.col(own).alias("__k"), "is_number", "status", "seq", "tier")
        step = asked.join(side, asked[wanted] == side["__k"]).select("request", "is_number", "tier", F.lit(n).alias("step"), (F.col("status") != "current").alias("old"), "seq")
        hits = step if hits is None else hits.unionAll(step)
    best = hits.groupBy("request").agg(F.min(F.struct("step", "old", "seq", "is_number", "tier")).alias("b"))
    return requests.join(best, "request", "left").select("request", "b.is_number", "b.tier", "b.step")

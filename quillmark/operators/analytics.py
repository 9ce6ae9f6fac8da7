"""Corpus analytics: coverage, counts, censuses, anomalies, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(standards: DataFrame) -> DataFrame:
    """Per division: totals, current, with scope, references and certification, quality, last sync."""
    return standards.groupBy("division").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "current").alias("current_count"),
        F.count_if(F.col("scope").isNotNull()).alias("with_scope"),
        F.count_if(F.size("normative_references") > 0).alias("with_refs"),
        F.count_if(F.col("certification").isNotNull()).alias("with_certification"),
        F.round(F.avg("extraction_quality"), 3).alias("avg_quality"),
        F.max("last_seen").alias("last_synced"),
    )


def kpis(standards: DataFrame) -> DataFrame:
    return standards.agg(
        F.count("*").alias("total"), F.countDistinct("division").alias("divisions"), F.count_if("mandatory").alias("mandatory"), F.count_if(F.col("status").isin("superseded", "withdrawn")).alias("gone")
    )


def share(rows: DataFrame, by: str) -> DataFrame:
    """Count per value and its integer percentage of the whole."""
    counted = rows.groupBy(by).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select(by, "n", F.round(F.col("n") * 100 / F.col("total"), 0).cast("int").alias("percent"))


def null_census(rows: DataFrame) -> DataFrame:
    """(field, nulls): nulls per column, in one pass."""
    one = rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns))
    return one.unpivot([], rows.columns, "field", "nulls")


def histogram(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Rows per value; null is a bucket of its own."""
    return rows.select(value.alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def validity(valid_upto: Column, as_of: Column) -> Column:
    return F.when(valid_upto.isNull(), "missing").when(valid_upto < as_of, "lapsed").otherwise("future")


def multi_version(rows: DataFrame, base: Column) -> DataFrame:
    """Bases with more than one row."""
    return rows.select(base.alias("base")).groupBy("base").agg(F.count("*").alias("versions")).filter("versions > 1")


def anomalies(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """(anomaly, n) per labelled test, counted in one pass; tests that are null don't count."""
    one = rows.agg(*(F.count_if(F.coalesce(t, F.lit(False))).alias(name) for name, t in tests.items()))
    return one.unpivot([], list(tests), "anomaly", "n")


def catalogue_tests(title: Column, year: Column, withdrawn: Column, valid_upto: Column, as_of: Column) -> dict[str, Column]:
    """The anomalies that the catalogue audit counts."""
    return {
        "year_typo": (year < 1900) | (year > 2100),
        "html_entity": title.rlike(r"&(?:[A-Za-z]+|#\d+);"),
        "wide_spaces": title.rlike(" {3,}"),
        "withdrawn_future": withdrawn & (valid_upto > as_of),
    }


def run_health(pages: Column, records: Column, errors: Column) -> Column:
    """Whether a run fetched pages and records and met no error."""
    return (pages > 0) & (records > 0) & (F.coalesce(F.size(errors), F.lit(0)) <= 0)


def first_non_empty(*candidates: Column) -> Column:
    """Ordered fallbacks: the first candidate with text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in candidates))


def selector_misses(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(source, field, misses, resolved): rows per source for which no selector of a field found text."""
    counted = rows.groupBy("source").agg(*(F.count_if(c.isNull()).alias(f) for f, c in fields.items()))
    out = counted.unpivot(["source"], list(fields), "field", "misses")
    return out.withColumn("resolved", F.col("misses") == 0)


def filter_catalogue(rows: DataFrame, division: str | None = None, search: str | None = None) -> DataFrame:
    """Equality on division unless it is All; trimmed, case-folded substring in number, title or scope."""
    if division and division != "All":
        rows = rows.filter(F.col("division") == division)
    wanted = (search or "").strip().lower()
    if wanted:
        hit = F.lit(False)
        for c in ("is_number", "title", "scope"):
            hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(wanted)), F.lit(False))
        rows = rows.filter(hit)
    return rows


def catalogue_view(rows: DataFrame) -> DataFrame:
    """The seven listed columns, with their defaults."""
    return rows.select(
        "is_number",
        F.coalesce("title", F.lit("")).alias("title"),
        "year",
        F.coalesce("division", F.lit("ETD")).alias("division"),
        F.coalesce("status", F.lit("current")).alias("status"),
        F.coalesce("scope", F.lit("")).alias("scope"),
        F.coalesce("mandatory", F.lit(False)).alias("mandatory_qco"),
    )


def rank_within(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))

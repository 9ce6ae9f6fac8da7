"""Normalisation of catalogue records: blanks, alternates, status, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: provenance of catalogue rows.
CATALOGUE_SOURCE = "BIS Know Your Standard / BIS Published Standards Catalogue"


def trimmed(value: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def truthy(value: Column) -> Column:
    """The text, null where it is empty."""
    return F.nullif(value, F.lit(""))


def year_of(text: Column) -> Column:
    """First year 19xx or 20xx in a text."""
    return F.nullif(F.regexp_extract(text, r"((?:19|20)\d{2})", 1), F.lit("")).try_cast("int")


def normalize_status(raw: Column) -> Column:
    """withdrawn before superseded before under_revision, else current; null is current."""
    folded = F.lower(F.coalesce(raw, F.lit("")))
    return F.when(folded.contains("withdraw"), "withdrawn").when(folded.contains("supersed"), "superseded").when(folded.contains("revision"), "under_revision").otherwise("current")


def is_withdrawn(status: Column, on: Column, flag: Column) -> Column:
    """A status other than null and 0, a withdrawal date, or the flag itself."""
    return (status.isNotNull() & (status.cast("string") != "0")) | on.isNotNull() | F.coalesce(flag, F.lit(False))


def dedup_key(is_number: Column, standard_id: Column, title: Column) -> Column:
    """NUM: over ID: over TITLE:, the first that the record has."""
    return F.coalesce(
        F.concat(F.lit("NUM:"), F.upper(F.trim(truthy(is_number)))),
        F.concat(F.lit("ID:"), standard_id.cast("string")),
        F.concat(F.lit("TITLE:"), F.upper(F.trim(F.coalesce(title, F.lit(""))))),
    )


def normalize_records(raw: DataFrame, query: Column | None = None, department: bool = False) -> DataFrame:
    """Catalogue rows from landed service rows (search or catalogue layout).

    ``raw`` has the service's column names; absent ones count as null.  With
    ``department`` the columns dept_id, dept_alias and dept_name override the
    row's own department.  ``query`` is the keyword the row was found by.
    """

    def col(name: str) -> Column:
        return F.col(name) if name in raw.columns else F.lit(None).cast("string")

    number = trimmed(col("standardNumber"))
    own = ("departmentId", "deptAliasName", "deptName")
    department_id, alias, name = (col(c) for c in (("dept_id", "dept_alias", "dept_name") if department else own))
    valid = F.coalesce(truthy(col("reviewOn")), col("validUpto") if "validUpto" in raw.columns else col("validupto"))
    queries = F.array_compact(F.array(F.coalesce(truthy(query) if query is not None else F.lit(None).cast("string"), truthy(alias))))
    return raw.select(
        number.alias("is_number"),
        F.coalesce(F.trim(F.coalesce(truthy(col("standardTitle")), truthy(col("standardName")))), F.lit("")).alias("title"),
        trimmed(col("standardNameInHindi")).alias("title_hindi"),
        col("standardId").cast("long").alias("standard_id"),
        department_id.cast("int").alias("department_id"),
        alias.alias("department_alias"),
        name.alias("department_name"),
        col("committeeId").cast("int").alias("committee_id"),
        col("publishedOn").alias("published_on"),
        valid.alias("valid_upto"),
        col("noOfRevision").cast("int").alias("revision_count"),
        col("typeOfStandardName").alias("aspect"),
        col("equivalenceTypeName").alias("degree_of_equivalence"),
        col("withdrawStatus").cast("int").alias("withdraw_status"),
        is_withdrawn(col("withdrawStatus"), col("withdrawOn"), col("withdrawn").cast("boolean")).alias("withdrawn"),
        col("isStatus").cast("int").alias("is_status"),
        F.coalesce(truthy(col("matched_standard")), number).alias("matched_standard"),
        queries.alias("matched_queries"),
        F.lit(CATALOGUE_SOURCE).alias("source"),
        F.lit(None).cast("string").alias("source_url"),
    )


def clean_and_validate(records: DataFrame) -> DataFrame:
    """Drop rows without a key; canonical, distinct references without the row itself; defaults.

    ``records``: is_number, normative_references, status, sources and any other columns.
    """
    from .ident import canonical_key

    key = canonical_key(F.col("is_number"))
    references = F.array_distinct(F.array_compact(F.transform(F.coalesce("normative_references", F.array().cast("array<string>")), lambda r: canonical_key(r))))
    return (
        records.withColumn("is_number", key)
        .filter("is_number is not null")
        .withColumns(
            {
                "normative_references": F.filter(references, lambda r: r != F.col("is_number")),
                "status": F.coalesce(truthy(F.col("status")), F.lit("current")),
                "sources": F.coalesce("sources", F.array(F.lit("bis_portal"))),
            }
        )
    )

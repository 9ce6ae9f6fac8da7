"""Designators, statuses and roles, over phrases derived from whole tables.

The test tables hold no designators, so each part number is printed in one of
ten known forms; the oracle knows the key by construction, without any pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, ident, records
from .registry import query
from .tables import table

FORMS = 10
_N, _P, _S, _Y = "p_partkey", "(p_partkey % 9 + 1)", "(p_partkey % 5 + 1)", "(1950 + p_partkey % 70)"
# For each form: the printed text, the number's prefix, whether part, section and year are printed.
PRINTED = (
    (f"'IS ' || {_N} || ' (Part ' || {_P} || ') : ' || {_Y}", "IS", True, False, True),
    (f"'IS:' || {_N} || '-' || {_P}", "IS", True, False, False),
    (f"'IS ' || {_N} || ' Part ' || {_P}", "IS", True, False, False),
    (f"'IS' || {_N}", "IS", False, False, False),
    (f"'is ' || {_N} || ':' || {_Y}", "IS", False, False, True),
    (f"'IS ' || {_N} || '-' || {_Y}", "IS", False, False, True),
    (f"'IS ' || {_N} || ' (Part ' || {_P} || '/Sec ' || {_S} || '):' || {_Y}", "IS", True, True, True),
    (f"'IS/ISO ' || {_N} || ':' || {_Y}", "IS/ISO", False, False, True),
    (f"'SP ' || {_N} || ' : ' || {_Y}", "SP", False, False, True),
    ("'no standard here'", None, False, False, False),
)


def _by_form(values: list[str], number: str = "p_partkey") -> str:
    return f"CASE {number} % {FORMS} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


RAW = _by_form([f[0] for f in PRINTED])
FAMILY = _by_form([f"'{f[1]} ' || p_partkey" if f[1] else "NULL" for f in PRINTED])
KEY = _by_form([(f"'{f[1]} ' || p_partkey" + (f" || '-' || {_P}" if f[2] else "") + (f" || '-' || {_S}" if f[3] else "")) if f[1] else "NULL" for f in PRINTED])
YEAR = _by_form([_Y if f[4] else "NULL" for f in PRINTED])


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part with its designator ``raw``."""
    return table(spark, sf_dir, "part").withColumn("raw", F.expr(RAW))


@query("designator_normalize", f"SELECT p_partkey, {RAW} AS raw, {KEY} AS key FROM part")
def designator_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return printed(spark, sf_dir).select("p_partkey", "raw", ident.canonical_key(F.col("raw")).alias("key"))


@query("designator_family", f"SELECT p_partkey, {FAMILY} AS family FROM part")
def designator_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return printed(spark, sf_dir).select("p_partkey", ident.standard_family(F.col("raw")).alias("family"))


@query("split_year", f"SELECT p_partkey, {KEY} AS key, CAST({YEAR} AS INT) AS year FROM part")
def split_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return printed(spark, sf_dir).select("p_partkey", ident.canonical_key(F.col("raw")).alias("key"), ident.designator_year(F.col("raw")).alias("year"))


@query("designator_sql_functions", f"SELECT p_partkey, {KEY} AS key, {FAMILY} AS family, CAST({YEAR} AS INT) AS year FROM part")
def designator_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident.register(spark)
    return printed(spark, sf_dir).selectExpr("p_partkey", "canonical_key(raw) AS key", "standard_family(raw) AS family", "designator_year(raw) AS year")


@query("same_designation", f"SELECT p_partkey, coalesce(p_partkey % 3 = 0 AND ({KEY}) IS NOT NULL, false) AS same FROM part")
def same_designation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each designator against its own key, or against the key of another part."""
    rows = printed(spark, sf_dir)
    other = F.when(F.col("p_partkey") % 3 == 0, ident.canonical_key(F.col("raw"))).otherwise(F.concat(F.lit("IEC "), F.col("p_partkey")))
    return rows.select("p_partkey", ident.same_designation(F.col("raw"), other).alias("same"))


_CITED = [f"'{p} ' || (l_partkey % 5000 + 1)" for p in ("IS", "SP")]
_LINE = "CASE WHEN l_linenumber % 2 = 1 THEN 'IS ' || (l_partkey % 5000 + 1) || ':2019' ELSE 'as per SP ' || (l_partkey % 5000 + 1) END"
_LINE_KEY = "CASE WHEN l_linenumber % 2 = 1 THEN 'IS ' || (l_partkey % 5000 + 1) ELSE 'SP ' || (l_partkey % 5000 + 1) END"


@query(
    "extract_references",
    f"""WITH k AS (SELECT l_orderkey, {_LINE_KEY} AS key, min(struct_pack(a := l_linenumber, b := l_partkey)) AS pos FROM lineitem GROUP BY ALL),
    r AS (SELECT l_orderkey, key, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS place FROM k)
    SELECT l_orderkey, key, place FROM r""",
)
def extract_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of one text per order, in order of first mention."""
    cited = citing_texts(spark, sf_dir)
    return cited.select("l_orderkey", F.posexplode(ident.extract_references(F.col("body"))).alias("place", "key")).withColumn("place", F.col("place") + 1)


def citing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, body): a text for each order that cites its parts."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.expr(_LINE).alias("t")))).alias("lines"))
    return lines.select("l_orderkey", F.array_join(F.transform("lines", lambda x: x["t"]), "; ").alias("body"))


_STATUS = "CASE o_orderkey % 6 WHEN 0 THEN 'Withdrawn on request' WHEN 1 THEN 'SUPERSEDED by revision' WHEN 2 THEN 'Under Revision' WHEN 3 THEN 'Active' WHEN 4 THEN NULL ELSE '' END"


@query(
    "status_normalize",
    "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'withdrawn' WHEN 1 THEN 'superseded' WHEN 2 THEN 'under_revision' ELSE 'current' END AS status, CAST(year(o_orderdate) AS INT) AS year FROM orders",
)
def status_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    printed_on = F.concat(F.lit("printed "), F.date_format("o_orderdate", "dd.MM.yyyy"))
    return rows.select("o_orderkey", records.normalize_status(F.expr(_STATUS)).alias("status"), records.year_of(printed_on).alias("year"))


# Title or citing sentence, and the role that the rules give it.
_PHRASES = (
    ("'Methods of test for cables Part 7'", "NULL", "test_method"),
    ("'Glossary of terms relating to cables'", "NULL", "terminology"),
    ("'Code of practice for electrical wiring installations'", "NULL", "installation"),
    ("'Safety requirements for LV switchgear'", "NULL", "safety"),
    ("'Methods of sampling hydraulic cement'", "NULL", "sampling"),
    ("'PVC insulated cables Part 1'", "NULL", "related_product"),
    ("'Methods of test for safety of household appliances'", "NULL", "test_method"),
    ("NULL", "'shall be tested in accordance with'", "test_method"),
    ("'Preferred numbers'", "'safety'", "dimensions"),
    ("'Cables'", "'installed by the contractor'", "installation"),
    ("'Cables'", "'SAMPLED from each lot'", "sampling"),
    ("NULL", "NULL", "related_product"),
)


def _phrase(i: int, key: str = "p_partkey") -> str:
    return f"CASE {key} % {len(_PHRASES)} " + " ".join(f"WHEN {n} THEN {p[i]}" for n, p in enumerate(_PHRASES)) + " END"


_ROLE = f"CASE p_partkey % {len(_PHRASES)} " + " ".join(f"WHEN {n} THEN '{p[2]}'" for n, p in enumerate(_PHRASES)) + " END"
_LABEL = f"CASE p_partkey % {len(_PHRASES)} " + " ".join(f"WHEN {n} THEN '{classify.ROLE_LABELS[p[2]]}'" for n, p in enumerate(_PHRASES)) + " END"


@query("classify_roles", f"SELECT p_partkey, {_ROLE} AS role, {_LABEL} AS label FROM part")
def classify_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    role = classify.classify_reference(F.expr(_phrase(0)), F.expr(_phrase(1)))
    return rows.select("p_partkey", role.alias("role"), classify.role_label(role).alias("label"))


@query(
    "scheme_of_notification",
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'CRS' WHEN 1 THEN 'Hallmarking' ELSE 'BIS Product Certification (ISI)' END AS scheme FROM part",
)
def scheme_of_notification(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'Compulsory Registration, not HALLMARKING' WHEN 1 THEN 'Hallmark of gold' ELSE p_name END")
    return table(spark, sf_dir, "part").select("p_partkey", classify.scheme_of_notification(text).alias("scheme"))


_BLANKED = "CASE c_custkey % 4 WHEN 0 THEN '  ' || c_name || ' ' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE c_name END"


@query(
    "dedup_key",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 3) THEN 'NUM:' || upper(trim(c_name)) WHEN c_custkey % 3 <> 0 THEN 'ID:' || c_custkey
    ELSE 'TITLE:' || upper(trim(c_mktsegment)) END AS key FROM customer""",
)
def dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    number = F.when(records.trimmed(F.expr(_BLANKED)).isNotNull(), F.expr(_BLANKED))
    return rows.select("c_custkey", records.dedup_key(number, F.expr("CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END"), F.concat(F.lit(" "), F.col("c_mktsegment"))).alias("key"))


@query(
    "record_normalize",
    f"""SELECT nullif(trim({_BLANKED}), '') AS is_number, coalesce(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END, c_name) AS title,
    c_custkey AS standard_id, c_nationkey AS department_id, 'D' || c_nationkey AS department_alias,
    CASE WHEN c_custkey % 7 = 0 THEN '2024-01-01' WHEN c_custkey % 2 = 0 THEN '2030-06-30' END AS valid_upto,
    (c_custkey % 6 = 1) OR (c_custkey % 10 = 3) AS withdrawn, 'D' || c_nationkey AS matched_queries FROM customer""",
)
def record_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "customer").selectExpr(
        f"{_BLANKED} AS standardNumber",
        "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ' ' || c_mktsegment END AS standardTitle",
        "c_name AS standardName",
        "c_custkey AS standardId",
        "c_nationkey AS departmentId",
        "'D' || c_nationkey AS deptAliasName",
        "CASE WHEN c_custkey % 7 = 0 THEN '2024-01-01' END AS reviewOn",
        "CASE WHEN c_custkey % 2 = 0 THEN '2030-06-30' END AS validUpto",
        "CAST(c_custkey % 6 = 1 AS INT) AS withdrawStatus",
        "CASE WHEN c_custkey % 10 = 3 THEN '2020-01-01' END AS withdrawOn",
    )
    out = records.normalize_records(raw)
    return out.select("is_number", "title", "standard_id", "department_id", "department_alias", "valid_upto", "withdrawn", F.array_join("matched_queries", ",").alias("matched_queries"))


@query(
    "clean_and_validate",
    f"""WITH k AS (SELECT p_partkey, {KEY} AS key FROM part)
    SELECT key AS is_number, CASE WHEN key = 'IS 5' THEN 'SP 7' ELSE 'IS 5,SP 7' END AS references, CASE WHEN p_partkey % 4 = 0 THEN 'withdrawn' ELSE 'current' END AS status FROM k WHERE key IS NOT NULL""",
)
def clean_and_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = printed(spark, sf_dir).select(
        F.col("raw").alias("is_number"),
        F.array(F.lit("IS 5:2001"), F.lit("none"), F.col("raw"), F.lit("SP 7"), F.lit("IS:5")).alias("normative_references"),
        F.expr("CASE p_partkey % 4 WHEN 0 THEN 'withdrawn' WHEN 1 THEN '' END").alias("status"),
        F.lit(None).cast("array<string>").alias("sources"),
    )
    out = records.clean_and_validate(rows)
    return out.select("is_number", F.array_join("normative_references", ",").alias("references"), "status")

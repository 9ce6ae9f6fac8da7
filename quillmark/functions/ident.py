"""Printed designators of standards and their canonical keys.

The canonical key ``PREFIX NUMBER[-part][-section]`` is the join key of the
engine; the year is carried beside it so that revisions share a key.  All
functions take and return columns and stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed value: the grammar of a printed designator: prefix, number, part, bare part, section, bare section, year.
DESIGNATOR = (
    r"(?i)(IS(?:/(?:[A-Za-z]+(?:/[A-Za-z]+)*))?|SP|IEC|ISO/SAE|ISIHB)\s*[:\-/]?\s*([A-Z]?\d+)"
    r"(?:\s*[\(\-/ ]\s*(?:Part|Pt\.?)\s*(\d+)\s*\)?|-(\d{1,3})(?!\d))?"
    r"(?:\s*[\(\-/ ]\s*(?:Sec|Section)\s*(\d+)\s*\)?|-(\d{1,3})(?!\d))?"
    r"(?:\s*[:\-]\s*((?:18|19|20)\d{2}))?"
)
#: The same with a word boundary in front, so that "this 12" is no designator.
STRICT_DESIGNATOR = DESIGNATOR.replace("(?i)", r"(?i)\b", 1)
_PREFIX, _NUMBER, _PART, _BARE_PART, _SECTION, _BARE_SECTION, _YEAR = range(1, 8)


def _pattern(strict: bool) -> str:
    return STRICT_DESIGNATOR if strict else DESIGNATOR


def _group(raw: Column, group: int, strict: bool) -> Column:
    """A group of the first designator; the empty string where it took no part."""
    return F.regexp_extract(raw, _pattern(strict), group)


def _suffix(*groups: Column) -> Column:
    found = F.coalesce(*(F.nullif(g, F.lit("")) for g in groups))
    return F.coalesce(F.concat(F.lit("-"), found), F.lit(""))


def standard_family(raw: Column, strict: bool = False) -> Column:
    """Prefix and number of the first designator, without part and section; null if there is none."""
    number = _group(raw, _NUMBER, strict)
    return F.when(number != "", F.concat(F.upper(_group(raw, _PREFIX, strict)), F.lit(" "), F.upper(number)))


def canonical_key(raw: Column, strict: bool = False) -> Column:
    """Canonical key of the first designator in ``raw``; null if there is none."""
    part = _suffix(_group(raw, _PART, strict), _group(raw, _BARE_PART, strict))
    section = _suffix(_group(raw, _SECTION, strict), _group(raw, _BARE_SECTION, strict))
    return F.concat(standard_family(raw, strict), part, section)


def designator_year(raw: Column, strict: bool = False) -> Column:
    """Year of the first designator, null where it has none."""
    return F.nullif(_group(raw, _YEAR, strict), F.lit("")).try_cast("int")


def extract_references(text: Column, strict: bool = False) -> Column:
    """Distinct canonical keys in ``text``, in order of first mention; null text: none."""
    found = F.regexp_extract_all(text, F.lit(_pattern(strict)), F.lit(0))
    keys = F.array_distinct(F.transform(found, lambda m: canonical_key(m)))
    return F.coalesce(F.array_compact(keys), F.array().cast("array<string>"))


def same_designation(a: Column, b: Column) -> Column:
    """Whether both sides have a key and it is the same one."""
    return F.coalesce(canonical_key(a) == canonical_key(b), F.lit(False))


def family_sql(raw: str) -> str:
    """``standard_family`` of the SQL expression ``raw``, as SQL."""
    return f"CASE WHEN {_group_sql(raw, _NUMBER)} <> '' THEN concat(upper({_group_sql(raw, _PREFIX)}), ' ', upper({_group_sql(raw, _NUMBER)})) END"


def key_sql(raw: str) -> str:
    """``canonical_key`` of the SQL expression ``raw``, as SQL."""

    def suffix(a: int, b: int) -> str:
        return f"coalesce(concat('-', coalesce(nullif({_group_sql(raw, a)}, ''), nullif({_group_sql(raw, b)}, ''))), '')"

    return f"concat({family_sql(raw)}, {suffix(_PART, _BARE_PART)}, {suffix(_SECTION, _BARE_SECTION)})"


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _group_sql(raw: str, group: int) -> str:
    return f"regexp_extract({raw}, {quoted(DESIGNATOR)}, {group})"


def register(spark: SparkSession) -> None:
    """Make the functions available to SQL as temporary SQL functions."""
    references = f"array_distinct(array_compact(transform(regexp_extract_all(coalesce(raw, ''), {quoted(DESIGNATOR)}, 0), m -> {key_sql('m')})))"
    for name, arguments, kind, body in (
        ("standard_family", "raw STRING", "STRING", family_sql("raw")),
        ("canonical_key", "raw STRING", "STRING", key_sql("raw")),
        ("designator_year", "raw STRING", "INT", f"try_cast(nullif({_group_sql('raw', _YEAR)}, '') AS INT)"),
        ("extract_references", "raw STRING", "ARRAY<STRING>", references),
        ("same_designation", "a STRING, b STRING", "BOOLEAN", f"coalesce({key_sql('a')} = {key_sql('b')}, false)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")

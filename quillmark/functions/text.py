"""Tokenizers, text cleaning, section extraction, parameters and languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ident import canonical_key, extract_references

# The tokens of the sparse index.
DESIGNATOR_TOKEN = r"is\s*\d+(?:-\d+)?"
WORD_TOKEN = r"[a-z]+|\d+(?:\.\d+)?"


def collapse(text: Column) -> Column:
    """White space folded to single blanks and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def search_tokens(text: Column) -> Column:
    """Tokens of a text: designators first (blanks removed), then words and numbers of the rest."""
    folded = F.lower(F.coalesce(text, F.lit("")))
    named = F.transform(F.regexp_extract_all(folded, F.lit(DESIGNATOR_TOKEN), F.lit(0)), lambda d: F.regexp_replace(d, r"\s+", ""))
    rest = F.regexp_replace(folded, DESIGNATOR_TOKEN, " ")
    return F.concat(named, F.regexp_extract_all(rest, F.lit(WORD_TOKEN), F.lit(0)))


# --- documents -----------------------------------------------------------

# Section heads and phrases of a printed standard.
SCOPE_SECTION = r"(?is)(?:^|\n)\s*1[\.\s]+SCOPE\s*\n(.*?)(?=\n\s*2[\.\s]+|\n\s*NORMATIVE|\n\s*REFERENCES)"
REFERENCE_SECTION = r"(?is)(?:^|\n)\s*(?:2[\.\s]+)?(?:NORMATIVE\s+)?REFERENCES?\s*\n(.*?)(?=\n\s*3[\.\s]+|\n\s*TERMINOLOGY|\n\s*DEFINITIONS)"
SUPERSEDES = r"(?i)supersed(?:es|ing)\s+(IS\s*:?\s*\d+[^\n\.]{0,60})"
AMENDMENT = r"(?i)Amendment\s*(?:No\.?)?\s*(\d+)\s*[:\-–]?\s*((?:January|February|March|April|May|June|July|August|September|October|November|December)?\s*(?:19|20)\d{2})?"
TITLE_LINE = r"IS\s*:?\s*\d+[^\n]{0,40}\n+\s*([A-Z][^\n]{10,160})"
RUNNING_HEAD = r"\n\s*(?:Bureau of Indian Standards|IS\s*\d+\s*:\s*\d{4})\s*\n"
IN_FORCE = r"(?i)come into force on(?: the)?\s+(.{0,40}?\d{4})"


def clean_pages(text: Column) -> Column:
    """Lone page numbers and running heads removed."""
    return F.regexp_replace(F.regexp_replace(text, r"\n\s*\d{1,3}\s*\n", "\n"), RUNNING_HEAD, "\n")


def printable(text: Column) -> Column:
    """Control and format characters removed except line breaks and tabs; lines trimmed."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{C}&&[^\n\r\t]]", "")
    return F.trim(F.array_join(F.transform(F.split(kept, r"\r\n|\n|\r"), lambda x: F.trim(x)), "\n"), F.lit("\n \t"))


def section_scope(text: Column, least: int = 30, most: int = 3000) -> Column:
    """Body of the scope section, folded; null where it has ``least`` characters or fewer."""
    body = collapse(F.regexp_extract(text, SCOPE_SECTION, 1))
    return F.when(F.length(body) > least, F.substring(body, 1, most))


def section_references(text: Column, own: Column) -> Column:
    """References of the reference section, or of the whole text without one, but for the text's own key."""
    body = F.regexp_extract(text, REFERENCE_SECTION, 1)
    source = F.when(text.rlike(REFERENCE_SECTION), body).otherwise(text)
    return F.filter(extract_references(source), lambda r: ~r.eqNullSafe(own))


def superseded_key(text: Column) -> Column:
    return canonical_key(F.nullif(F.regexp_extract(text, SUPERSEDES, 1), F.lit("")))


def amendments(text: Column) -> Column:
    """array<struct<number, date>>, the first mention of each number."""
    found = F.regexp_extract_all(text, F.lit(AMENDMENT), F.lit(0))
    rows = F.transform(
        found,
        lambda m: F.struct(F.regexp_extract(m, AMENDMENT, 1).alias("number"), F.nullif(F.trim(F.regexp_extract(m, AMENDMENT, 2)), F.lit("")).alias("date")),
    )
    empty = F.array().cast("array<struct<number:string,date:string>>")
    return F.aggregate(rows, empty, lambda kept, r: F.when(F.exists(kept, lambda k: k["number"] == r["number"]), kept).otherwise(F.concat(kept, F.array(r))))


def header_title(text: Column, within: int = 2000) -> Column:
    """The title line of a document's header; by rule a title stands in the first ``within`` characters."""
    line = F.regexp_extract(F.substring(text, 1, within), TITLE_LINE, 1)
    return F.nullif(F.trim(F.regexp_replace(line, r"\s+", " "), F.lit(" -—")), F.lit(""))


def extraction_quality(key: Column, title: Column, scope: Column, references: Column) -> Column:
    """0.30 number, 0.25 title, 0.30 scope (half if short), 0.15 references."""
    score = (
        F.when(F.coalesce(key, F.lit("")) != "", 0.30).otherwise(0.0)
        + F.when(F.length(title) > 10, 0.25).otherwise(0.0)
        + F.when(F.length(scope) > 100, 0.30).when(F.length(scope) > 0, 0.15).otherwise(0.0)
        + F.when(F.size(references) > 0, 0.15).otherwise(0.0)
    )
    return F.round(score, 3)


def merge_repeated_cells(cells: Column) -> Column:
    """Trimmed, non-empty cells without adjacent repeats, joined by ' | '."""
    kept = F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: c != "")
    start = F.array().cast("array<string>")
    once = F.aggregate(kept, start, lambda out, c: F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1)) == c), out).otherwise(F.concat(out, F.array(c))))
    return F.array_join(once, " | ")


# Fixed value: what begins a numbered item.
ITEM_BREAK = r"\n\s*(?:\d+[\.\)]\s+|[a-z][\.\)]\s+|Item\s+\d+)"


def segment_items(text: Column, least: int = 60, whole: int = 2000) -> Column:
    """Numbered items over ``least`` characters, folded; by rule a text without any is one item of its first ``whole`` characters."""
    parts = F.filter(F.split(text, ITEM_BREAK, -1), lambda p: F.length(F.regexp_replace(p, r"^\s+|\s+$", "")) > least)
    return F.when(F.size(parts) > 0, F.transform(parts, collapse)).otherwise(F.array(F.substring(collapse(text), 1, whole)))


# The technical parameters of a specification.
VOLTAGE, CAPACITY = r"(?i)\b\d+(?:\.\d+)?\s*(?:kV|V)\b", r"(?i)\b\d+(?:\.\d+)?\s*(?:kVA|MVA|kW|MW)\b"
MATERIAL = r"\b(?:xlpe|pvc|copper|aluminium|steel|tmt|cement|concrete)\b"


def _matches(text: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))


def technical_parameters(text: Column) -> Column:
    """struct of voltage_ratings, capacities and materials (lower-cased), distinct and sorted."""
    return F.struct(
        _matches(text, VOLTAGE).alias("voltage_ratings"),
        _matches(text, CAPACITY).alias("capacities"),
        _matches(F.lower(text), MATERIAL).alias("materials"),
    )


# --- languages -------------------------------------------------------------

# Script blocks and markers.
SCRIPTS = {"hi": "0900-097F", "bn": "0980-09FF", "ta": "0B80-0BFF", "te": "0C00-0C7F", "kn": "0C80-0CFF", "ml": "0D00-0D7F", "gu": "0A80-0AFF", "pa": "0A00-0A7F", "or": "0B00-0B7F"}
MARATHI_MARKERS = ("आहे", "करावे", "साठी", "मध्ये", "केबलचे", "प्रकारचे", "पावरसाठी", "बांधकामासाठी", "असलेले", "आणि", "किंवा", "जमिनीखालील", "ट्रान्सफॉर्मर")


def _block(span: str) -> str:
    low, high = span.split("-")
    return f"[\\u{low}-\\u{high}]"


def detect_script(text: Column) -> Column:
    """Language of the first character in one of the script blocks, else en."""
    every = "|".join(_block(s) for s in SCRIPTS.values())
    first = F.regexp_extract(F.coalesce(text, F.lit("")), f"({every})", 1)
    out = F.when(first == "", "en")
    for language, span in SCRIPTS.items():
        out = out.when(first.rlike(_block(span)), language)
    return out.otherwise("en")


def detect_query_language(text: Column) -> Column:
    """hi-IN or mr-IN by markers for Devanagari, te-IN, ta-IN, else en-IN."""
    text = F.coalesce(text, F.lit(""))
    marathi = F.lit(False)
    for marker in MARATHI_MARKERS:
        marathi = marathi | text.contains(marker)
    return (
        F.when(text.rlike(_block(SCRIPTS["hi"])), F.when(marathi, "mr-IN").otherwise("hi-IN"))
        .when(text.rlike(_block(SCRIPTS["te"])), "te-IN")
        .when(text.rlike(_block(SCRIPTS["ta"])), "ta-IN")
        .otherwise("en-IN")
    )

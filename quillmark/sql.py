"""The engine's functions for SQL: scalar functions and table functions.

``register(spark)`` makes them available to the session.  Scalar functions are
SQL expressions, so they stay inside generated code; table functions run in
Python, row by row (``segment_items``, ``page_links``, ``page_cells``) or in
Arrow batches (``text_grams``), and join laterally:

    SELECT d.doc_id, s.item FROM documents d, LATERAL segment_items(d.text) s
    SELECT * FROM text_grams(TABLE(SELECT doc_id, text FROM documents))
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from .functions import classify, ident, multilingual, text
from .operators.textindex import _CHARACTERS, _count_tokens
from .sources import html as H


def _role() -> str:
    title, context = ([f"WHEN rlike({column}, {ident.quoted('(?i)' + p)}) THEN {ident.quoted(role)}" for role, p in rules] for column, rules in (("title", classify.TITLE_RULES), ("context", classify.CONTEXT_RULES)))
    return f"CASE {' '.join([*title, *context])} ELSE {ident.quoted(classify.DEFAULT_ROLE)} END"


def _label() -> str:
    whens = " ".join(f"WHEN {ident.quoted(k)} THEN {ident.quoted(v)}" for k, v in classify.ROLE_LABELS.items())
    return f"CASE role {whens} ELSE 'Related product' END"


def _language(query: str) -> str:
    marathi = " OR ".join(f"contains({query}, {ident.quoted(m)})" for m in text.MARATHI_MARKERS)
    blocks = {k: f"rlike({query}, {ident.quoted(text._block(text.SCRIPTS[k]))})" for k in ("hi", "te", "ta")}
    return f"CASE WHEN {blocks['hi']} THEN CASE WHEN {marathi} THEN 'mr-IN' ELSE 'hi-IN' END WHEN {blocks['te']} THEN 'te-IN' WHEN {blocks['ta']} THEN 'ta-IN' ELSE 'en-IN' END"


def _normalized() -> str:
    trimmed = r"regexp_replace(coalesce(query, ''), '^\\s+|\\s+$', '')"
    translated = "s"
    for word, english in multilingual.GLOSSARY.items():
        translated = f"replace({translated}, {ident.quoted(word)}, {ident.quoted(english)})"
    technical = ident.quoted(multilingual.TECHNICAL)
    pieces = f"zip_with(split({trimmed}, {technical}, -1), regexp_extract_all({trimmed}, {technical}, 0), (s, t) -> concat(regexp_replace({translated}, {ident.quoted(multilingual.INDIC)}, ' '), coalesce(t, '')))"
    english = rf"trim(regexp_replace(array_join({pieces}, ''), '\\s+', ' '))"
    return f"CASE WHEN {_language(trimmed)} = 'en-IN' THEN {trimmed} ELSE coalesce(nullif({english}, ''), {trimmed}) END"


@udtf(returnType="position int, item string")
class SegmentItems:
    """The numbered items of a specification over ``least`` characters, or its beginning if it has none."""

    def eval(self, body: str, least: int = 60, whole: int = 2000):
        parts = re.split(text.ITEM_BREAK, body or "", flags=re.ASCII)
        fold = lambda x: re.sub(r"\s+", " ", x, flags=re.ASCII).strip(" ")
        items = [fold(p) for p in parts if len(re.sub(r"^\s+|\s+$", "", p, flags=re.ASCII)) > least]
        for n, item in enumerate(items or ([fold(body)[:whole]] if body is not None else []), 1):
            yield n, item


@udtf(returnType="position int, href string, label string")
class PageLinks:
    """The links of a page in order: target and text."""

    def eval(self, page: str):
        links = (n for n in H.parse(page or "").walk() if n.tag == "a" and n.attrs.get("href") is not None)
        for n, link in enumerate(links, 1):
            yield n, link.attrs["href"], link.text()


@udtf(returnType="table_no int, row_no int, cell_no int, cell string")
class PageCells:
    """The cells of a page's tables; a cell belongs to the nearest row around it."""

    def eval(self, page: str):
        root = H.parse(page or "")
        for t, table in enumerate((n for n in root.walk() if n.tag == "table"), 1):
            for r, row in enumerate((n for n in table.walk() if n.tag == "tr"), 1):
                for c, cell in enumerate((n for n in row.walk() if n.tag in ("td", "th")), 1):
                    yield t, r, c, cell.text()


@arrow_udtf(returnType="doc_id long, term string, tf long")
class TextGrams:
    """The character n-grams of each row's words with their counts, of a table (doc_id, text), in Arrow batches."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        for at in range(0, rows.num_rows, 512):
            part = rows.slice(at, 512)
            folded = pc.utf8_lower(pc.fill_null(part.column("text").cast(pa.string()), ""))
            terms, row, code, times = _count_tokens(pc.split_pattern_regex(folded, r"[ \t\n\v\f\r]+"), _CHARACTERS)
            yield pa.table({"doc_id": part.column("doc_id").cast(pa.int64()).take(pa.array(row)), "term": terms.take(pa.array(code)), "tf": pa.array(times, pa.int64())})


def register(spark: SparkSession) -> None:
    """Make all functions available to SQL in this session."""
    ident.register(spark)
    for name, arguments, kind, body in (
        ("reference_role", "title STRING, context STRING", "STRING", _role()),
        ("role_label", "role STRING", "STRING", _label()),
        ("query_language", "query STRING", "STRING", _language("coalesce(query, '')")),
        ("normalize_query", "query STRING", "STRING", _normalized()),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    for name, function in (("segment_items", SegmentItems), ("page_links", PageLinks), ("page_cells", PageCells), ("text_grams", TextGrams)):
        spark.udtf.register(name, function)

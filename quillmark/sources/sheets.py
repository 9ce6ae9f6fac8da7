"""Spreadsheets (xlsx, csv) as rows: bytes in, rows out, a typed error for what can't be read.

A workbook is a zip of XML files.  Cells are read as they are stored: shared and
inline texts, numbers as written, booleans; formulas give their stored result.
Rows are parsed one after the other, so a large sheet is never held as a tree.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ident
from .documents import MAX_BYTES, DocumentError, read_txt

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Bytes of an unpacked part of a workbook at most.
MAX_PART = 20 * MAX_BYTES
ROWS = "path string, sheet string, row_no int, cells array<string>, error string"


def _column(reference: str | None, default: int) -> int:
    """The place of a cell from its reference, B7 is 1."""
    letters = re.match(r"[A-Z]+", reference or "")
    if not letters:
        return default
    n = 0
    for c in letters[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _part(book: zipfile.ZipFile, name: str):
    if book.getinfo(name).file_size > MAX_PART:
        raise DocumentError(f"A part of the workbook is over {MAX_PART >> 20} MB")
    return book.open(name)


def _texts(node) -> str:
    """The text of a string item, without its phonetic hints."""
    return "".join(t.text or "" for run in (node, *node.findall(f"{_MAIN}r")) for t in run.findall(f"{_MAIN}t"))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with _part(book, "xl/sharedStrings.xml") as part:
        for _, node in ElementTree.iterparse(part):
            if node.tag == f"{_MAIN}si":
                out.append(_texts(node))
                node.clear()
    return out


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, file) of the sheets in the order of the workbook."""
    with _part(book, "xl/workbook.xml") as part:
        named = [(s.get("name") or "", s.get(_LINK)) for s in ElementTree.parse(part).iter(f"{_MAIN}sheet")]
    with _part(book, "xl/_rels/workbook.xml.rels") as part:
        files = {r.get("Id"): r.get("Target") or "" for r in ElementTree.parse(part).getroot()}
    return [(name, files[link].lstrip("/") if files[link].startswith("/") else f"xl/{files[link]}") for name, link in named if link in files and "worksheet" in files[link]]


def _cell(node, shared: list[str]) -> str | None:
    kind, value = node.get("t"), node.find(f"{_MAIN}v")
    if kind == "inlineStr":
        own = node.find(f"{_MAIN}is")
        return None if own is None else _texts(own)
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    return {"1": "true", "0": "false"}.get(value.text, value.text) if kind == "b" else value.text


def read_xlsx(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of every row that has a value."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            shared = _shared(book)
            for name, file in _sheets(book):
                with _part(book, file) as part:
                    last = 0
                    for _, row in ElementTree.iterparse(part):
                        if row.tag != f"{_MAIN}row":
                            continue
                        last = int(row.get("r") or last + 1)
                        cells: list[str | None] = []
                        for node in row.findall(f"{_MAIN}c"):
                            at = _column(node.get("r"), len(cells))
                            cells += [None] * (at + 1 - len(cells))
                            cells[at] = _cell(node, shared)
                        row.clear()
                        if any(c and c.strip() for c in cells):
                            yield name, last, cells
    except (zipfile.BadZipFile, KeyError, IndexError, ValueError, ElementTree.ParseError, zipfile.zlib.error) as e:
        if isinstance(e, DocumentError):
            raise
        raise DocumentError("Corrupted or invalid spreadsheet") from e


def read_csv(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    rows = csv.reader(io.StringIO(read_txt(content)))
    try:
        for n, row in enumerate(rows, 1):
            if any(c.strip() for c in row):
                yield "", n, [c or None for c in row]
    except csv.Error as e:
        raise DocumentError("Corrupted or invalid spreadsheet") from e


def _rows_of(path: str, content: bytes) -> Iterator[tuple]:
    readers = {"xlsx": read_xlsx, "csv": read_csv}
    kind = path.rsplit(".", 1)[-1].lower()
    try:
        if not content:
            raise DocumentError("The file is empty")
        if len(content) > MAX_BYTES:
            raise DocumentError(f"The file is over {MAX_BYTES >> 20} MB")
        if kind not in readers:
            raise DocumentError(f"Unsupported spreadsheet format '.{kind}'")
        for sheet, row, cells in readers[kind](content):
            yield path, sheet, row, cells, None
    except DocumentError as e:
        yield path, None, None, None, str(e)


def sheet_rows(files: DataFrame) -> DataFrame:
    """``ROWS`` of ``files`` (path, content): a row per row of a sheet; a file that can't be read gives one with its error, behind the rows before the damage."""
    kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]
    names = ["path", "sheet", "row_no", "cells", "error"]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for row in _rows_of(path, content.as_py() or b""):
                    held.append(row)
                    if len(held) >= 10_000:
                        yield packed(held)
                        held = []
        if held:
            yield packed(held)

    return files.select("path", "content").mapInArrow(run, ROWS)


def _named(header: Column, *parts: str) -> Column:
    """The place, from 1, of the first cell whose name has one of ``parts``; null if none has."""
    hit = lambda c: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(F.coalesce(c, F.lit(""))), p))
    return F.nullif(F.array_position(F.transform(header, hit), True), F.lit(0))


def listed_products(files: DataFrame) -> DataFrame:
    """(path, sheet, row_no, product, standard, error) of compulsory lists as spreadsheets.

    The header of a sheet is its first row that names a standard column, else
    its first row.  The columns are found by name, else the first and the last
    are taken.
    """
    rows = sheet_rows(files)
    standard = _named(F.col("cells"), "standard", "is no")
    first = rows.filter("error is null").groupBy("path", "sheet").agg(F.min_by("cells", F.struct(standard.isNull(), "row_no")).alias("header"), F.min(F.struct(standard.isNull().alias("unnamed"), "row_no")).alias("at"))
    first = first.select("path", "sheet", F.col("at.row_no").alias("header_row"), F.coalesce(_named(F.col("header"), "product"), F.lit(1)).cast("int").alias("p"), F.coalesce(_named(F.col("header"), "standard", "is no"), F.size("header")).cast("int").alias("s"))
    below = rows.filter("error is null").join(first, ["path", "sheet"]).filter("row_no > header_row")
    told = below.select("path", "sheet", "row_no", F.try_element_at("cells", F.col("p")).alias("product"), F.try_element_at("cells", F.col("s")).alias("standard"), F.lit(None).cast("string").alias("error"))
    failed = rows.filter("error is not null").select("path", "sheet", "row_no", F.lit(None).cast("string").alias("product"), F.lit(None).cast("string").alias("standard"), "error")
    return told.unionAll(failed)


def compulsory_products(files: DataFrame) -> DataFrame:
    """(is_number, product): every reference of each listed row, the last row of a key wins (by path, sheet and row)."""
    refs = listed_products(files).filter("error is null").select(F.struct("path", "sheet", "row_no").alias("seq"), "product", F.explode(ident.extract_references(F.col("standard"))).alias("is_number"))
    return refs.groupBy("is_number").agg(F.max_by("product", "seq").alias("product"))


def write_xlsx(rows: list[list[str | None]], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet whose cells are inline texts."""
    from xml.sax.saxutils import escape, quoteattr

    def letters(n: int) -> str:
        return (letters(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)

    def line(r: int, row: list[str | None]) -> str:
        cells = (f'<c r="{letters(i)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for i, v in enumerate(row) if v is not None)
        return f'<row r="{r}">{"".join(cells)}</row>'

    main, office = _MAIN[1:-1], "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(line(r, row) for r, row in enumerate(rows, 1))}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return out.getvalue()

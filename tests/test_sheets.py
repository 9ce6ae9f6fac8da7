import io
import zipfile

from quillmark.sources import sheets

FILES = "path string, content binary"


def frame(spark, files):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in files], FILES)


def shared_strings_book():
    """A workbook as spreadsheet programs write it: shared strings, rich text, numbers, booleans, gaps, two sheets."""
    m = sheets._MAIN[1:-1]
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{m}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="List" sheetId="1" r:id="a"/><sheet name="Notes" sheetId="2" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{m}"><si><t>S. No</t></si><si><t>Product name</t></si><si><t>Indian Standard</t></si><si><r><t>Cab</t></r><r><t>les</t></r><rPh sb="0" eb="1"><t>hint</t></rPh></si><si><t>IS 694:2010 and IS 1554</t></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{m}"><sheetData><row r="1"><c r="A1" t="str"><v>Compulsory list</v></c></row><row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c><c r="D3" t="s"><v>2</v></c></row>'
        '<row r="4"><c r="A4"><v>1.5</v></c><c r="B4" t="s"><v>3</v></c><c r="C4" t="b"><v>1</v></c><c r="D4" t="s"><v>4</v></c></row><row r="5"><c r="A5"/></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{m}"><sheetData><row><c t="inlineStr"><is><t>Wires</t></is></c><c><f>1+1</f><v>2</v></c></row><row><c t="inlineStr"><is><t>Steel</t></is></c><c t="inlineStr"><is><t>IS 694</t></is></c></row></sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return out.getvalue()


def test_workbooks_as_rows(spark):
    got = {(r["sheet"], r["row_no"]): r["cells"] for r in sheets.sheet_rows(frame(spark, [("a.xlsx", shared_strings_book())])).collect()}
    assert got == {
        ("List", 1): ["Compulsory list"], ("List", 3): ["S. No", "Product name", None, "Indian Standard"], ("List", 4): ["1.5", "Cables", "true", "IS 694:2010 and IS 1554"],
        ("Notes", 1): ["Wires", "2"], ("Notes", 2): ["Steel", "IS 694"],
    }


def test_header_by_name_and_last_row_wins(spark):
    files = [("a.xlsx", shared_strings_book()), ("b.csv", "﻿Item;x,IS No.,Product\n1,IS 1554,Wire\n,IS 9999,\"Rods, steel\"\n".encode()), ("c.csv", b"only,two\nPipes,IS 4985\n")]
    got = {r["is_number"]: r["product"] for r in sheets.compulsory_products(frame(spark, files)).collect()}
    assert got == {"IS 694": "Steel", "IS 1554": "Wire", "IS 9999": "Rods, steel", "IS 4985": "Pipes"}


def test_damaged_files_are_errors(spark):
    good = shared_strings_book()
    short = sheets.write_xlsx([["Product", "Standard"]] + [[f"p{i}", f"IS {i}"] for i in range(500)])
    files = [("a.xlsx", good[: len(good) // 2]), ("b.xlsx", b"PK\x03\x04"), ("c.xls", b"x"), ("d.csv", b""), ("e.xlsx", short.replace(b"xl/workbook.xml", b"xl/workbork.xml")), ("f.xlsx", short)]
    rows = sheets.listed_products(frame(spark, files)).collect()
    errors = {r["path"]: r["error"] for r in rows if r["error"]}
    assert errors == {"a.xlsx": "Corrupted or invalid spreadsheet", "b.xlsx": "Corrupted or invalid spreadsheet", "c.xls": "Unsupported spreadsheet format '.xls'", "d.csv": "The file is empty", "e.xlsx": "Corrupted or invalid spreadsheet"}
    assert sum(r["path"] == "f.xlsx" for r in rows) == 500
    assert sheets.compulsory_products(frame(spark, files).limit(0)).count() == 0


def test_round_trip_of_odd_cells(spark):
    table = [["a & <b>", None, "  padded ", "é𝔘"], [None, None, "x" * 40_000], ["\"q\"", "", "1"]]
    got = {r["row_no"]: r["cells"] for r in sheets.sheet_rows(frame(spark, [("t.xlsx", sheets.write_xlsx(table, "A & B"))])).collect()}
    assert got == {1: table[0], 2: table[1], 3: table[2]}

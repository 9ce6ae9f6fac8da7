"""Documents, pages, corpus files and the delta stream."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmark.sources import corpus, documents, html


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"


def test_txt_encodings():
    assert documents.extract_text("Käbel  \n 5".encode("latin-1"), "a.txt") == "Käbel\n5"
    assert documents.extract_text("x\x00y".encode("utf-16"), "a.TXT") == "xy"


def test_docx_merges_repeated_cells():
    cells = "".join(f"<w:tc>{P.format(t)}</w:tc>" for t in ("Rating", "Rating", "11 kV"))
    content = docx(P.format("Head") + f"<w:tbl><w:tr>{cells}</w:tr></w:tbl>")
    assert documents.extract_text(content, "a.docx") == "Head\nRating | 11 kV"


@pytest.mark.parametrize(
    ("content", "name", "message"),
    [(b"", "a.txt", "is empty"), (b"x", "a.xlsx", "Unsupported document format"), (b"nope", "a.docx", "Corrupted or invalid DOCX"), (b" \n ", "a.txt", "No readable text found")],
)
def test_document_errors(spark, content, name, message):
    with pytest.raises(documents.DocumentError, match=message):
        documents.extract_text(content, name)
    df = spark.createDataFrame([(name, bytearray(content))], "path string, content binary")
    row = documents.documents_to_text(df).first()
    assert row["text"] is None and message in row["error"]


def test_selectors_fall_back():
    root = html.parse("<div class='a b'><table><tr><td>x<br>y</td></tr></table></div><p id=k>z")
    assert [n.text() for n in html.select(root, "div.b table td")] == ["xy"]
    assert html.select_first(root, ("h1", "p#k"))[1] == 1
    assert html.select_first(root, ("h1",)) == ([], None)


def test_detail_page(spark):
    page = "<h1> Cable </h1><table><tr><td>Committee:</td><td>ETD 9</td></tr></table><div id='normative-references'>IS 5, IS 6:2001</div><ul class='amendments'><li>Amendment No. 1 May 2001</li></ul><h2>Scope</h2><p>All cables.</p>"
    row = html.detail_rows(spark.createDataFrame([("u", page)], "url string, html string")).first()
    assert (row["title"], row["meta"], row["normative_references"]) == ("Cable", {"meta_committee": "ETD 9"}, ["IS 5", "IS 6"])
    assert [(a["number"], a["date"]) for a in row["amendments"]] == [("1", "May 2001")]
    assert row["scope"] == "All cables."


def test_corpus_files(spark, tmp_path):
    assert corpus.read_records(spark, f"{tmp_path}/none.json", corpus.ENRICHED).count() == 0
    (tmp_path / "c.json").write_text('{"standards": [{"is_number": "IS 5", "withdrawn": false}, {"is_number": "IS 6"}]}')
    rows = corpus.read_records(spark, f"{tmp_path}/c.json", corpus.CATALOGUE, "standards")
    assert sorted(r["is_number"] for r in rows.collect()) == ["IS 5", "IS 6"]


def test_upsert_and_detection(spark):
    from quillmark.operators import cdc

    kind = "is_number string, title string, year int, status string, division string, amendments array<string>, normative_references array<string>, certification string, supersedes string, scope string"
    base = ("IS 1", "XLPE Cables", 2020, "current", "D", [], ["IS 8130", "IS 10810-7"], None, None, "Covers XLPE insulated cables.")
    edits = {"reordered": {6: ["IS 10810-7", "IS 8130"]}, "scope": {9: "Covers more."}, "metadata": {2: 2021}, "withdrawn": {3: "withdrawn", 1: "Other"}}
    stored = cdc.with_hashes(spark.createDataFrame([(k, *base[1:]) for k in edits], kind))
    fresh = [tuple(k if i == 0 else e.get(i, v) for i, v in enumerate(base)) for k, e in edits.items()] + [("new", *base[1:])]
    got = {r["is_number"]: (r["change_type"], r["reembed"], r["update_graph"]) for r in cdc.detect_changes(cdc.with_hashes(spark.createDataFrame(fresh, kind)), stored).collect()}
    assert got == {
        "reordered": ("unchanged", False, False),
        "scope": ("scope", True, False),
        "metadata": ("metadata", False, False),
        "withdrawn": ("withdrawn", True, True),
        "new": ("new", True, True),
    }


def test_gate_and_fusion_of_empty_arms(spark, tmp_path):
    from quillmark.operators import retrieve

    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "zzz")], "query_id long, text string")
    gated = retrieve.gate(asked, retrieve.retrieve(retrieve.build_indexes(docs, str(tmp_path)), asked), retrieve.PROFILES["hybrid"])
    assert {(r["query_id"], r["state"]) for r in gated.collect()} == {(1, "ok"), (2, "no_results")}
    assert gated.filter(F.col("query_id") == 2).first()["doc_id"] is None


def test_landed_service_pages(spark):
    body = '{"status": "SUCCESS", "totalRecord": 5, "data": [{"standardNumber": " IS 5 ", "standardId": 7, "standardName": "Cable"}]}'
    pages = spark.createDataFrame([("CED", 0, body), ("CED", 2, '{"status": "FAILED", "data": []}'), ("ETD", 0, "not json")], "department string, offset long, body string")
    from quillmark.functions.records import normalize_records

    rows = corpus.service_rows(pages, ("standardNumber", "standardId", "standardName", "isStatus"))
    got = normalize_records(rows.withColumnRenamed("department", "deptAliasName")).first()
    assert (got["is_number"], got["standard_id"], got["title"], got["matched_queries"], got["withdrawn"]) == ("IS 5", 7, "Cable", ["CED"], False)
    assert [tuple(r) for r in corpus.pages_left(pages, 2).collect()] == [("CED", 4)]


def test_end_tags_that_are_left_out(spark):
    from quillmark.sources import html

    page = "<table class=views-table><thead><tr><th>No<th>Title<th>Year<th>Status<tbody><tr><td><a href=a>IS 1</a><td>Title one<td>1990<td>Active<tr><td><p>IS 2<p><td>Title two<td>1991<td>Withdrawn</table><p>after"
    got = html.listing_rows(spark.createDataFrame([("http://x/", page, "D")], "url string, html string, division string")).collect()
    assert [(r["is_number"], r["title"], r["year"], r["status"]) for r in got] == [("IS 1", "Title one", 1990, "current"), ("IS 2", "Title two", 1991, "withdrawn")]
    nested = html.parse("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><p>x<div>y</div><p>z")
    assert [n.text() for n in html.select(nested, "ul li")] == ["abc", "b", "c", "d"]
    assert [n.text() for n in html.select(nested, "p")] == ["x", "z"]
    table = html.parse("<table><tr><td><table><tr><td>in</table><td>out</table>")
    assert [n.text() for n in html.select(table, "td")] == ["in", "in", "out"]


def test_versions_survive_an_interrupted_write(spark, tmp_path):
    base = f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        corpus.read_versioned(spark, base)
    corpus.write_versioned(spark.range(3), base)
    spark.range(9).write.parquet(f"{base}/v-without-pointer")
    assert corpus.read_versioned(spark, base).count() == 3
    corpus.write_versioned(spark.range(5), base)
    assert (corpus.read_versioned(spark, base).count(), corpus.read_versioned(spark, base, back=1).count()) == (5, 3)


def test_holders_of_passages(spark):
    from quillmark.operators import evaluate

    texts = [(1, "a b c d"), (2, "xa b cx d"), (3, "b c"), (4, "a  b c")]
    asked = [(1, "a b c"), (2, "b c"), (3, "zz"), (4, "a  b")]
    got = evaluate.holders(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((q, d) for q, p in asked for d, t in texts if p in t)


def test_files_are_read_once_and_in_few_tasks(spark, tmp_path):
    """Texts are kept when the scan returns, and many small files share a task."""
    import shutil

    folder = tmp_path / "files"
    folder.mkdir()
    for n in range(300):
        (folder / f"{n}.txt").write_text(f"text {n}")
    for name in ("a+b c%20.txt", "ü.txt"):
        (folder / name).write_bytes(b"")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    found = documents.scan_documents(spark, f"file://{folder}")
    shutil.rmtree(folder)
    rows = {r["path"].rpartition("/")[2]: (r["text"], r["error"]) for r in found.collect()}
    assert rows == {f"{n}.txt": (f"text {n}", None) for n in range(300)} | {name: (None, "The uploaded file is empty") for name in ("a+b c%20.txt", "ü.txt")}
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before

"""Documents as text: plain text in several encodings, DOCX, errors as values."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ident, text
from ..session import kept

MAX_BYTES = 20 * 1024 * 1024
# Encodings in the order tried.
ENCODINGS = ("utf-8", "utf-8-sig", "utf-16", "latin-1", "cp1252")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class DocumentError(ValueError):
    """A document that can't be read; the message is shown to the user."""


def clean(text: str) -> str:
    kept = "".join(c for c in text if c in "\n\r\t" or c.isprintable())
    return "\n".join(line.strip() for line in kept.splitlines()).strip()


def read_txt(content: bytes) -> str:
    marked = content.startswith((b"\xff\xfe", b"\xfe\xff"))
    # Without its byte order mark any even number of bytes would pass as UTF-16.
    for encoding in ENCODINGS:
        if encoding == "utf-16" and not marked:
            continue
        try:
            return clean(content.decode(encoding))
        except UnicodeDecodeError:
            continue
    raise DocumentError("The text file has an unknown encoding")


def _paragraph(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()


def read_docx(content: bytes) -> str:
    """Paragraphs outside tables first, then table rows with adjacent repeats merged."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise DocumentError("Corrupted or invalid DOCX file") from e
    body = root.find(f"{_W}body")
    lines = [t for n in (body if body is not None else []) if n.tag == f"{_W}p" and (t := _paragraph(n))]
    for row in root.iter(f"{_W}tr"):
        cells: list[str] = []
        for cell in row.findall(f"{_W}tc"):
            text = "\n".join(t for p in cell.iter(f"{_W}p") if (t := _paragraph(p)))
            if text and (not cells or cells[-1] != text):
                cells.append(text)
        if cells:
            lines.append(" | ".join(cells))
    return clean("\n".join(lines))


def read_pdf(content: bytes, pages: int | None = None) -> str:
    """Needs the optional library pypdf; ``pages``: the first ones alone."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise DocumentError("PDF documents need the optional library pypdf") from e
    reader = PdfReader(io.BytesIO(content))
    if reader.is_encrypted:
        raise DocumentError("The PDF is password-protected")
    return clean("\n".join(page.extract_text() or "" for page in reader.pages[:pages]))


def extract_text(content: bytes, filename: str, pages: int | None = None) -> str:
    """Text of one document; raises DocumentError with a readable message.  ``pages`` limits PDF documents."""
    if not content:
        raise DocumentError("The uploaded file is empty")
    if len(content) > MAX_BYTES:
        raise DocumentError(f"The file is over {MAX_BYTES // 2**20} MB")
    readers = {"txt": read_txt, "docx": read_docx, "pdf": read_pdf}
    kind = filename.rsplit(".", 1)[-1].lower()
    if kind not in readers:
        raise DocumentError(f"Unsupported document format '.{kind}'")
    text = read_pdf(content, pages) if kind == "pdf" else readers[kind](content)
    if not text:
        raise DocumentError("No readable text found in the document")
    return text


def documents_to_text(files: DataFrame, pages: int | None = None) -> DataFrame:
    """(path, text, error) for ``files`` (path, content); one of text and error is null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    out.append((path, extract_text(bytes(content), path, pages), None))
                except DocumentError as e:
                    out.append((path, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


#: Bytes that a file counts as besides its own when files are dealt to tasks, so that a task reads some thousand small ones.
OPEN_COST = 16 * 1024


def scan_documents(spark: SparkSession, folder: str, pages: int | None = None) -> DataFrame:
    """All documents under a folder, by Spark's own binary reader; larger files come back as errors without being read.

    The files are read once, and their texts kept in the shared scratch folder.
    That reader leaves out empty files: those that its listing names and it
    doesn't return are errors, too.  The listing stays in Spark's own index.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    small = documents_to_text(files.filter(F.col("length") <= MAX_BYTES), pages)
    large = files.filter(F.col("length") > MAX_BYTES).select("path", F.lit(None).cast("string").alias("text"), F.lit(f"The file is over {MAX_BYTES // 2**20} MB").alias("error"))
    name, before = "spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(name, OPEN_COST)
    try:
        read = kept(small.unionAll(large), "texts")
    finally:
        spark.conf.set(name, before)
    jvm = spark._jvm
    names = DataFrame(spark._jsparkSession.createDataset(jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(files._jdf.inputFiles()), jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    listed = names.select(F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B"))).alias("path"))
    empty = _plain(listed).join(_plain(read.select("path")).drop("path"), "plain", "left_anti").select("path", F.lit(None).cast("string").alias("text"), F.lit("The uploaded file is empty").alias("error"))
    return read.unionAll(empty)


def _plain(paths: DataFrame) -> DataFrame:
    """``paths`` with the path as it is without the differing slashes behind a scheme."""
    return paths.withColumn("plain", F.regexp_replace("path", r"^(\w+:)/+", "$1/"))


#: By rule a printed standard is read from its first pages.
RECORD_PAGES = 25


def standard_records(texts: DataFrame) -> DataFrame:
    """Records of printed standards (``texts``: path, text, error): number, title, scope, references, supersession, amendments, quality.

    A file that couldn't be read keeps its error and has no fields.
    """
    page = text.clean_pages(F.col("text"))
    rows = texts.select("path", "error", page.alias("page")).withColumns({"is_number": ident.canonical_key(F.col("page")), "title": text.header_title(F.col("page")), "scope": text.section_scope(F.col("page"))})
    rows = rows.withColumn("normative_references", F.when(F.col("page").isNotNull(), text.section_references(F.col("page"), F.col("is_number"))))
    quality = text.extraction_quality(F.col("is_number"), F.col("title"), F.col("scope"), F.col("normative_references"))
    return rows.select("path", "is_number", "title", "scope", "normative_references", text.superseded_key(F.col("page")).alias("supersedes"), F.when(F.col("page").isNotNull(), text.amendments(F.col("page"))).alias("amendments"), F.when(F.col("page").isNotNull(), quality).alias("extraction_quality"), "error")


def scan_records(spark: SparkSession, folder: str, pages: int | None = RECORD_PAGES) -> DataFrame:
    """The records of all documents under a folder, by path."""
    return standard_records(scan_documents(spark, folder, pages).orderBy("path"))


def local_folder(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path there) of a folder or URI."""
    plain = path.removeprefix("file://") if path.startswith("file:///") else re.sub("^file:/", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in plain else (fs.LocalFileSystem(), plain)


def land_files(files: DataFrame, folder: str) -> int:
    """Write ``files`` (name, content) under a folder that all executors see, each whole before it has its name; how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = local_folder(folder)
        made: set[str] = set()
        for batch in batches:
            for row in batch.to_pylist():
                place = f"{base}/{row['name']}"
                own = place.rpartition("/")[0]
                if own not in made:
                    store.create_dir(own, recursive=True)
                    made.add(own)
                with store.open_output_stream(f"{place}.part") as out:
                    out.write(row["content"] or b"")
                store.move(f"{place}.part", place)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    return files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_docx(lines: list[str]) -> bytes:
    """A document with a paragraph per line."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("word/document.xml", f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()

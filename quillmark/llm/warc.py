"""WARC archives with revisit records for repeated payloads.

Only headers (page id, URL, digest, length) are shuffled by payload digest to
find each payload's first page.  The pages are then joined with the revisits
found, which shuffles their payloads once; a revisit's payload is dropped after
that.  Archives are written by Spark's own text sink, whose line separator is
the blank lines that end a WARC record, so any Hadoop file system works and a
lost executor's files are replaced by the commit protocol.  Each archive file is
one gzip member, so records can't be read by offset; its records are so many
that their payloads stay within ``FILE_BYTES`` (a larger one has its own file).
Archives of others are read as well: plain or gzipped, with a member per record
or one for all, and with payload digests of other algorithms.  A file is read by
one task and, like any row of Spark's binary source, holds 2 GB at most.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_scratch_path

#: Payloads under this many bytes are always stored.
MIN_REVISIT_BYTES = 100
#: Bytes of payloads in one file at most, unless one payload is larger.
FILE_BYTES = 64 << 20
#: Payloads up to a size, and how many records of that size a file has.
BANDS = tuple((size, FILE_BYTES // size) for size in (32 << 10, 1 << 20, FILE_BYTES))
#: Fixed date of the fresh headers, so that a repeated run writes equal bytes.
WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _url() -> Column:
    return F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20]", "%20")


def resolve_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, refers_to, refers_to_url) per row of ``pages``.

    refers_to, with the URL of that page, is set where the payload has ``MIN_REVISIT_BYTES`` or more and a
    smaller page_id has the same payload.  Minima are combined map-side, so a
    payload that a third of all pages share costs one row per task.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    heads = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html.cast("binary"), 256).alias("payload_digest"), _url().alias("url"))
    first = heads.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("named"), F.count("*").alias("n")).filter("n > 1").select("payload_digest", "first", F.col("named.url").alias("first_url"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return heads.join(first, "payload_digest", "left").select("page_id", "payload_bytes", "payload_digest", F.when(again, F.col("first")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_to_url"))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def warc_records(pages: DataFrame, date: str = WARC_DATE) -> DataFrame:
    """(record, n): each page's WARC record, dated ``date``, without the blank lines at its end, and its payload's bytes."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    n = F.octet_length(html).cast("long")
    digest = F.sha2(html.cast("binary"), 256)
    revisits = resolve_revisits(pages).filter("refers_to is not null").select("page_id", "payload_digest", "refers_to", "refers_to_url").distinct()
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), _url().alias("url"), html.alias("html"), n.alias("n"), digest.alias("digest"))
    known = slim.join(revisits.withColumnRenamed("page_id", "later"), F.col("page_id").eqNullSafe(F.col("later")) & (F.col("digest") == F.col("payload_digest")), "left")
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "),
        _record_id(F.col("page_id")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "),
        F.col("url"),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.when(again, F.concat(F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), _record_id(F.col("refers_to")), F.lit(f"{CRLF}WARC-Refers-To-Target-URI: "), F.col("refers_to_url"), F.lit(f"{CRLF}WARC-Refers-To-Date: {date}"))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(CRLF * 2),
    )
    return known.select(F.concat(head, block).alias("record"), "n")


def write_warc(pages: DataFrame, path: str, date: str = WARC_DATE) -> None:
    """Write ``pages`` (page_id, url, html) as gzipped archives under ``path``, with ``date`` in all headers.

    Payloads are written band by band of their size, so that the number of
    records bounds the bytes of a file.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    longest = pages.agg(F.max(F.octet_length(html))).first()[0] or 0
    records, low = warc_records(pages, date), -1
    for size, count in BANDS:
        own = records.filter((F.col("n") > low) & ((F.col("n") <= size) if size < BANDS[-1][0] else F.lit(True)))
        if low < 0 or longest > low:
            own.select("record").write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", count).text(path)
        low = size


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an archive; raises on damage."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode().split(CRLF)
        headers = {k.lower(): v for k, v in (line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])}
        start, size = end + 4, int(headers["content-length"])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield headers, data[start : start + size]
        at = start + size + 4


def members(data: bytes) -> Iterator[bytes]:
    """The content of an archive file: plain, or each gzip member one after the other."""
    if not data.startswith(b"\x1f\x8b"):
        yield data
        return
    while data:
        unpack = zlib.decompressobj(31)
        out = unpack.decompress(data)
        if not unpack.eof:
            raise ValueError("a gzip member is cut short")
        yield out
        data = unpack.unused_data.lstrip(b"\0")


def _number(record_id: str | None) -> int | None:
    value = record_id.removeprefix("<urn:page:").removesuffix(">") if record_id else ""
    return int(value) if value.lstrip("-").isdecimal() else None


#: Digest algorithms that payloads are checked by, and the bytes of their digests.
ALGORITHMS = {"md5": 16, "sha1": 20, "sha256": 32, "sha384": 48, "sha512": 64}


def stated_digest(value: str | None) -> tuple[str | None, bytes | None]:
    """(algorithm, digest) of a digest header in hexadecimal or base 32; nothing if either isn't known."""
    name, _, text = (value or "").strip().partition(":")
    name, text = name.lower().replace("-", ""), text.strip()
    size = ALGORITHMS.get(name)
    try:
        raw = bytes.fromhex(text) if len(text) == 2 * (size or 0) else base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except ValueError:
        return None, None
    return (name, raw) if size and len(raw) == size else (None, None)


def _content(headers: dict[str, str], block: bytes) -> tuple[bytes, int, bool]:
    """(payload, its stated or real bytes, whether digests are over the payload as it stands here)."""
    if not headers.get("content-type", "application/http").lower().startswith("application/http"):
        return block, len(block), True
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
    size = int(stated[1]) if stated and headers["warc-type"] == "revisit" else len(payload)
    return payload, size, not re.search(rb"(?im)^transfer-encoding:", http)


def _row(headers: dict[str, str], block: bytes) -> tuple:
    payload, size, plain = _content(headers, block)
    again = headers["warc-type"] == "revisit"
    name, digest = stated_digest(headers.get("warc-payload-digest"))
    if again:
        told = digest.hex() if name == "sha256" else headers.get("warc-payload-digest")
    else:
        if name and plain and hashlib.new(name, payload).digest() != digest:
            raise ValueError(f"payload of {headers.get('warc-record-id')} does not match its digest")
        told = hashlib.sha256(payload).hexdigest()
    return _number(headers.get("warc-record-id")), headers.get("warc-target-uri"), headers["warc-type"], size, told, _number(headers.get("warc-refers-to")), None if again else payload


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for headers, block in (r for member in members(content.as_py()) for r in parse_warc(member)):
                if headers.get("warc-type") not in ("response", "revisit"):
                    continue
                rows.append(_row(headers, block))
                held += len(rows[-1][-1] or b"")
                if held > 16_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) per record.

    All files of ``path`` are read, but for those whose names begin with a dot
    or an underscore.  Payloads are checked against digests of ``ALGORITHMS``,
    in hexadecimal or base 32, unless a transfer encoding stands between;
    other digests are not checked.  payload_digest is the bare SHA-256, but for
    revisits that state another digest, which is given as it is.  A revisit's
    payload is null and is found at the response that ``refers_to`` names.
    Other records are left out; page_id is null where the record's id is not of
    this module.  A file that is no archive, or is cut short, is an error.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` and read the archives back: one row per page, without the payloads.

    A null html is the empty payload, a null url the empty one; pages without
    page_id can be revisits but are referred to by none.  Rows that repeat a
    page_id and its payload are all responses if that id is the payload's
    smallest.  An empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    path = new_scratch_path(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path).drop("payload", "url")

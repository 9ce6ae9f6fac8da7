"""Landed pages of a catalogue service as a Spark data source, for batch and stream.

A crawler lands each response of the paged service as one file,
``<department>/<offset>.json``, in a folder that all executors read.  Pages are
read in parallel, each in a partition of its own as long as there are few, then
many in each of ``PARTITIONS``; of a stream
the pages read are the resume point, kept in the query's checkpoint: a run that
is stopped goes on with the pages it has not committed, and departments that
fail are recorded and passed.

    spark.dataSource.register(LandedPages)
    spark.read.format("landed_pages").load(folder)
    spark.readStream.format("landed_pages").load(folder)
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery

from .documents import land_files, local_folder

SCHEMA = "department string, offset long, position int, status string, total long, record map<string,string>, error string"
_COLUMNS = pa.schema(
    [("department", pa.string()), ("offset", pa.int64()), ("position", pa.int32()), ("status", pa.string()), ("total", pa.int64()), ("record", pa.map_(pa.string(), pa.string())), ("error", pa.string())]
)
#: Documented bound of a page: a larger one is an error row.
MAX_BYTES = 64 << 20
#: Partitions of a scan or batch at most, and bytes of pages that a task turns into rows at a time.
PARTITIONS, CHUNK_BYTES = 256, 8 << 20


@dataclass
class Page:
    """One landed response."""

    department: str
    offset: int
    path: str


@dataclass
class Pages(InputPartition):
    """The responses that one task reads."""

    pages: list[Page]


def _parted(pages: list[Page]) -> list[Pages]:
    """``pages`` in partitions of almost equal numbers; one without pages if there are none."""
    parts = min(PARTITIONS, len(pages))
    return [Pages(pages[len(pages) * i // parts : len(pages) * (i + 1) // parts]) for i in range(parts)] or [Pages([])]


def landed(path: str, departments: tuple[str, ...] = ()) -> list[Page]:
    """The pages under ``path``, by department and offset; files still being written, with another ending, are none."""
    files, base = local_folder(path)
    if files.get_file_info(base).type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = []
    for info in files.get_file_info(fs.FileSelector(base, recursive=True)):
        parts = info.path[len(base) :].strip("/").split("/")
        if info.is_file and len(parts) == 2 and re.fullmatch(r"\d+\.json", parts[1]) and (not departments or parts[0] in departments):
            found.append(Page(parts[0], int(parts[1].removesuffix(".json")), info.path))
    return sorted(found, key=lambda p: (p.department, p.offset))


def land_pages(responses: DataFrame, folder: str) -> None:
    """Write ``responses`` (department, offset, body) as the files of a landing folder."""
    cores = responses.sparkSession.sparkContext.defaultParallelism
    land_files(responses.repartition(2 * cores).select(F.concat(F.col("department"), F.lit("/"), F.col("offset").cast("string"), F.lit(".json")).alias("name"), F.coalesce("body", F.lit("")).alias("content")), folder)


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def page_rows(page: Page, content: bytes) -> list[tuple]:
    """A row per record; a page without records, or one that failed or can't be read, is one row with its state."""
    try:
        body = json.loads(content)
        status, records = body.get("status"), body.get("data") or []
        total = body.get("totalRecords", body.get("totalRecord"))
        total = int(total) if isinstance(total, int) or str(total).isdecimal() else None
        if status != "SUCCESS":
            return [(page.department, page.offset, None, status, total, None, str(status or "no status"))]
        rows = [(page.department, page.offset, i, status, total, [(str(k), _text(v)) for k, v in r.items()], None) for i, r in enumerate(records)]
        return rows or [(page.department, page.offset, None, status, total, None, None)]
    except (ValueError, AttributeError, TypeError):
        return [(page.department, page.offset, None, None, None, None, "unreadable")]


def _batches(pages: list[Page], folder: str) -> Iterator[pa.RecordBatch]:
    files, _ = local_folder(folder)
    rows, held = [], 0
    for page in pages:
        size = files.get_file_info(page.path).size
        if size is not None and size > MAX_BYTES:
            rows.append((page.department, page.offset, None, None, None, None, f"over {MAX_BYTES >> 20} MB"))
        else:
            with files.open_input_stream(page.path) as stream:
                content = stream.read()
            rows += page_rows(page, content)
            held += len(content)
        if held >= CHUNK_BYTES:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_COLUMNS)], schema=_COLUMNS)


class _Reader(DataSourceReader):
    def __init__(self, folder: str, departments: tuple[str, ...]):
        self.folder, self.departments = folder, departments

    def partitions(self) -> list[Pages]:
        return _parted(landed(self.folder, self.departments))

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        yield from _batches(partition.pages, self.folder)


class _StreamReader(DataSourceStreamReader):
    """An offset names the pages of each department that have landed, so one that lands late, or out of order, is read too."""

    def __init__(self, folder: str, departments: tuple[str, ...]):
        self.folder, self.departments = folder, departments

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        pages: dict[str, list[str]] = {}
        for page in landed(self.folder, self.departments):
            pages.setdefault(page.department, []).append(str(page.offset))
        return {k: ",".join(v) for k, v in pages.items()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        done, asked = ({(k, int(n)) for k, v in x.items() for n in v.split(",")} for x in (start, end))
        fresh = asked - done
        return _parted([p for p in landed(self.folder, self.departments) if (p.department, p.offset) in fresh])

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        yield from _batches(partition.pages, self.folder)

    def commit(self, end: dict) -> None:
        """Nothing to do: landed pages stay, and the checkpoint holds the offsets."""


class LandedPages(DataSource):
    """Option: ``departments`` (separated by commas) to read alone."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def _own(self) -> tuple[str, tuple[str, ...]]:
        if not self.options.get("path"):
            raise ValueError("landed_pages needs a folder")
        names = self.options.get("departments", "")
        return self.options["path"], tuple(n.strip() for n in names.split(",") if n.strip())

    def reader(self, schema) -> DataSourceReader:
        return _Reader(*self._own())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(*self._own())


def ingest(spark: SparkSession, folder: str, store: str, checkpoint: str, fields: tuple[str, ...]) -> StreamingQuery:
    """One run over what has landed since the last: records to ``store``/records, failed pages to ``store``/failed.

    Each batch writes a folder of its own, which a repeated batch replaces, so
    a run that is killed leaves neither gaps nor repeats.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        records = batch.filter("record is not null").select("department", "offset", "position", *(F.try_element_at("record", F.lit(f)).alias(f) for f in fields))
        records.write.mode("overwrite").parquet(f"{store}/records/batch={number}")
        batch.filter("error is not null").select("department", "offset", F.col("error").alias("reason")).write.mode("overwrite").parquet(f"{store}/failed/batch={number}")
        batch.unpersist()

    spark.dataSource.register(LandedPages)
    stream = spark.readStream.format("landed_pages").load(folder)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query

"""Stored tables in buckets by their key, joined in place.

A version of a store is a bucketed table: rows lie in buckets by the hash of the
key, sorted by it.  An upsert shuffles the fresh rows alone; each stored bucket
is joined where it lies and written as a bucket of the next version.  Buckets
double in number when they hold more than ``ROWS`` rows on average, in the same
write.  Versions are named by rising numbers and read only when complete, so an
interrupted write leaves the store as it was.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.corpus import exists
from . import cdc

#: Rows of a bucket on average, at most; buckets of a new store.
ROWS, FIRST = 1_000_000, 8


def versions(spark: SparkSession, base: str) -> list[tuple[int, int]]:
    """(number, buckets) of the complete versions under ``base``, oldest first."""
    if not exists(spark, base):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    names = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    found = [re.fullmatch(r"v(\d+)-of-(\d+)", n) for n in names]
    return sorted((int(m[1]), int(m[2])) for m in found if m and exists(spark, f"{base}/{m[0]}/_SUCCESS"))


def _place(base: str, number: int, buckets: int) -> str:
    return f"{base}/v{number:06}-of-{buckets}"


def open_store(spark: SparkSession, base: str, schema: StructType, key: str) -> DataFrame:
    """The newest version, known to Spark as bucketed; an empty table if there is none."""
    found = versions(spark, base)
    if not found:
        return spark.createDataFrame([], schema)
    number, buckets = found[-1]
    name = f"quillmark_store_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{_place(base, number, buckets)}'")
    return spark.table(name)


def write_store(rows: DataFrame, base: str, key: str, buckets: int) -> None:
    """``rows`` as the next version; those of a key must lie in one task, or meet there first."""
    found = versions(rows.sparkSession, base)
    name = f"quillmark_store_{uuid.uuid4().hex}"
    place = _place(base, found[-1][0] + 1 if found else 1, buckets)
    rows.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", place).saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")


def upsert_store(spark: SparkSession, base: str, fresh: DataFrame, key: str = "is_number", merge: Callable[[DataFrame, DataFrame, str], DataFrame] = cdc.upsert) -> DataFrame:
    """Merge ``fresh`` (one row per key) into the store under ``base``; the rows that were written, unread.

    ``merge`` joins stored and fresh rows by the key, as ``cdc.upsert`` does.
    """
    found = versions(spark, base)
    stored = open_store(spark, base, fresh.schema, key)
    buckets = found[-1][1] if found else FIRST
    total = stored.count() + fresh.count()
    while total > ROWS * buckets:
        buckets *= 2
    merged = merge(stored, fresh, key)
    # a store that grows, or begins, is dealt out anew
    write_store(merged if found and buckets == found[-1][1] else merged.repartition(buckets, key), base, key, buckets)
    return open_store(spark, base, merged.schema, key)


def drop_versions(spark: SparkSession, base: str, keep: int = 2) -> list[int]:
    """Delete all but the newest ``keep`` complete versions; the numbers that are gone."""
    gone = versions(spark, base)[:-keep]
    for number, buckets in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(_place(base, number, buckets))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return [n for n, _ in gone]

"""Shared helpers: scratch tables in the cluster's shared folder, ids, words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where a local session names none (unit tests) a temporary folder is
    made and set as the checkpoint folder; on a cluster, whose machines don't
    share one, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/quillmark-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    This cuts lineage: a lost executor costs at most the tasks of the stage it
    was running, and ids made by ``monotonically_increasing_id`` stay fixed.
    """
    spark = df.sparkSession
    path = new_scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that no later step reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc_mod(id_col: Column, modulus: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``modulus``."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def split_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes with A-Z lower-cased."""
    return text.lower().split() if text else []


class WordHashes(dict):
    """64-bit hash of each word, kept for words seen often; bounded size."""

    limit = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


#: Odd multipliers that tell the five places of a shingle apart.
PLACE = np.random.default_rng(20240501).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def shingle_hashes(words: list[bytes], hashes: WordHashes, width: int = 5) -> np.ndarray:
    """A hash per word shingle, in text order.

    Fewer words than ``width``: the whole sequence is the one shingle.
    No words: empty.
    """
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    with np.errstate(over="ignore"):
        if n < width:
            return mix64(np.array([(values * PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
        out = values[: n - width + 1] * PLACE[0]
        for j in range(1, width):
            out += values[j : n - width + 1 + j] * PLACE[j]
        return mix64(out)


def run_hashes(words: list[bytes], hashes: WordHashes, length: int) -> np.ndarray:
    """A hash per run of ``length`` words, equal to that of the one shingle of so short a text."""
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    count = max(len(words) - length + 1, 0)
    with np.errstate(over="ignore"):
        out = np.full(count, length, np.uint64)
        for j in range(length):
            out += values[j : j + count] * PLACE[j]
        return mix64(out)


#: Rows of an Arrow batch at most where rows hold whole texts.
BATCH_ROWS = 1_000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering the session's Arrow batches to ``BATCH_ROWS`` rows if they are larger.

    Executors hold a batch of whole texts several times, outside the heap too.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def pieces(batches, rows: int = 512):
    """Slices of Arrow batches of texts, so that few rows at a time become Python objects.

    Workers outlive their task; at its end what it freed goes back to the system.
    """
    import ctypes

    import pyarrow as pa

    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


def column_bytes(batch, name: str) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes."""
    import pyarrow as pa

    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()

"""Delta synchronisation: landed files, change detection, idempotent upserts.

Each micro-batch is deduplicated, compared with the stored table, upserted and
audited.  A batch writes its own version of those parts of the table that its
keys lie in, named by its batch id, so a batch that is run again after a failure
replaces its own output only, and parts that it doesn't touch stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import cdc
from ..sources.corpus import exists


#: Parts of a new store by a hash of the key, and rows of a part on average at which their number doubles.
BUCKETS, BUCKET_ROWS = 8, 1_000_000


def _bucket(key: str, of: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(of)).cast("int")


def _version(base: str, batch: int) -> str:
    return f"{base}/batch={batch}"


def _children(spark: SparkSession, base: str, prefix: str) -> list[int]:
    """The numbers of the folders ``prefix``N under ``base``."""
    if not exists(spark, base):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    names = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix)]


def _layout(spark: SparkSession, base: str, before: int | None = None) -> tuple[int, dict[int, list[int]]]:
    """(number of parts, batches that wrote each part, oldest first); a batch with more parts than the one before wrote all of them."""
    of, written = BUCKETS, {}
    for batch in sorted(_children(spark, base, "batch=")):
        if (before is None or batch < before) and exists(spark, f"{_version(base, batch)}/_SUCCESS"):
            for own in _children(spark, _version(base, batch), "of="):
                if own != of:
                    of, written = own, {}
                for k in _children(spark, f"{_version(base, batch)}/of={own}", "bucket="):
                    written.setdefault(k, []).append(batch)
    return of, written


def current(spark: SparkSession, base: str, schema: StructType, before: int | None = None, buckets: set[int] | None = None) -> DataFrame:
    """The stored table as of the newest batch, or the newest one before ``before``; ``buckets``: these parts alone.

    Each part is read from the newest complete batch that wrote it.
    """
    of, written = _layout(spark, base, before)
    paths = [f"{_version(base, batches[-1])}/of={of}/bucket={k}" for k, batches in sorted(written.items()) if buckets is None or k in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def drop_replaced(spark: SparkSession, base: str, before: int) -> int:
    """Delete what batches before ``before`` have replaced, so that a part is kept once besides the newest batch's; the parts deleted."""
    of, written = _layout(spark, base, before)
    files = spark._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    kept = {batches[-1]: set() for batches in written.values()}
    for k, batches in written.items():
        kept[batches[-1]].add(k)
    gone = 0
    for batch in _children(spark, base, "batch="):
        for own in _children(spark, _version(base, batch), "of=") if batch < before else ():
            for k in _children(spark, f"{_version(base, batch)}/of={own}", "bucket="):
                if own != of or k not in kept.get(batch, ()):
                    gone += files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{_version(base, batch)}/of={own}/bucket={k}"), True)
    return gone


def logged(spark: SparkSession, log: str) -> DataFrame:
    """All changes that the batches have logged; ``batch`` is the batch's number."""
    return spark.read.option("basePath", log).parquet(f"{log}/batch=*")


def delta_writer(store: str, log: str, key: str = "is_number", seq: str | None = None, on_change: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` over records with the columns of the stored table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if seq:
            newest = Window.partitionBy(key).orderBy(F.desc(seq))
            batch = batch.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n", seq)
        # the batch is sorted out and hashed once for all that reads it
        fresh = cdc.with_hashes(batch).persist()
        try:
            _apply(fresh, batch_id)
        finally:
            fresh.unpersist()

    def _apply(fresh: DataFrame, batch_id: int) -> None:
        spark = fresh.sparkSession
        of, written = _layout(spark, store, before=batch_id)
        wanted, total = of, current(spark, store, fresh.schema, before=batch_id).count() + fresh.count()
        while total > BUCKET_ROWS * wanted:
            wanted *= 2
        # a store that grows is dealt out anew as a whole
        touched = {r[0] for r in fresh.select(_bucket(key, of)).distinct().collect()} if wanted == of else None
        stored = current(spark, store, fresh.schema, before=batch_id, buckets=touched)
        changes = cdc.detect_changes(fresh, stored, key)
        dealt = cdc.upsert(stored, fresh, key).withColumn("of", F.lit(wanted)).withColumn("bucket", _bucket(key, wanted)).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("of", "bucket").parquet(_version(store, batch_id))
        changes.filter("change_type <> 'unchanged'").write.mode("overwrite").parquet(_version(log, batch_id))
        drop_replaced(spark, store, before=batch_id)
        if on_change:
            on_change(changes, batch_id)

    return write


def run_delta(spark: SparkSession, landing: str, schema: StructType, writer: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int | None = 1) -> StreamingQuery:
    """Process all files that have landed since the last run, then stop (a scheduled delta job); without ``files_per_batch`` as one batch."""
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(landing)
    query = stream.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query

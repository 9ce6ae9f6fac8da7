"""Change detection with keyed state: the stream remembers what it has seen of each key.

Where ``delta`` compares a batch with the stored table, this keeps the digests of
each key's last record in the state store, so that a batch reads nothing but its
own records.  Keys that no record names for ``keep`` expire and are new when they
come again.  What is remembered of a key is bounded: a digest for each field.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import cdc

#: The state store that transformWithState needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = (*cdc.CONTENT_FIELDS, "scope")
_STATE = "digests array<long>, gone boolean"


class LastRecord(StatefulProcessor):
    """For each key the newest record of a batch, and how it differs from the last one."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _STATE, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = max(rows, key=lambda r: (r.seq, r.digests))
        held = self.last.get()
        was = list(held[0]) if held else None
        changed = ["*"] if was is None else [f for f, a, b in zip(FIELDS, was, newest.digests, strict=True) if a != b]
        if was is None or changed or bool(held[1]) != newest.gone:
            self.last.update((list(newest.digests), newest.gone))
        yield Row(key=key[0], seq=newest.seq, change_type=self._named(changed, newest.gone and not (held and held[1])), changed_fields=changed)

    @staticmethod
    def _named(changed: list[str], went: bool) -> str:
        if changed == ["*"]:
            return "new"
        if not changed:
            return "unchanged"
        for name, hit in (("withdrawn", went), ("scope", "scope" in changed), ("references", "normative_references" in changed), ("certification", "certification" in changed)):
            if hit:
                return name
        return "metadata"

    def close(self) -> None:
        pass


def digested(records: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, seq, digests, gone): a digest for each field of ``FIELDS``, the last one of title and scope together."""
    r = records.alias("r")
    fields = [F.xxhash64(F.to_json(F.struct(cdc._canonical("r", f).alias("v")), {"ignoreNullFields": "false"})) for f in cdc.CONTENT_FIELDS]
    return r.select(F.col(f"r.{key}").alias("key"), F.col(f"r.{seq}").cast("long").alias("seq"), F.array(*fields, F.xxhash64(cdc.scope_hash())).alias("digests"), cdc._was_gone("r").alias("gone"))


def changes(stream: DataFrame, key: str = "is_number", seq: str = "seq", keep_ms: int | None = None) -> DataFrame:
    """(key, seq, change_type, changed_fields) of each batch of a stream of records, unchanged ones included.

    Several records of a key in one batch count as the one of highest ``seq``.
    The session's state store must be ``PROVIDER``.
    """
    out = T.StructType([T.StructField("key", stream.schema[key].dataType), T.StructField("seq", T.LongType()), T.StructField("change_type", T.StringType()), T.StructField("changed_fields", T.ArrayType(T.StringType()))])
    found = digested(stream, key, seq).groupBy("key").transformWithState(LastRecord(keep_ms), out, "Append", "ProcessingTime" if keep_ms else "None")
    return found.withColumnRenamed("key", key)


def distinct_records(stream: DataFrame, key: str, time: str, lateness: str) -> DataFrame:
    """The first record of each key; repeats within ``lateness`` of it are dropped, and its state after that."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def run_changes(spark: SparkSession, found: DataFrame, checkpoint: str, path: str) -> StreamingQuery:
    """Append ``found`` to a table until all that has landed is read.

    Batches without data are off meanwhile: state that expires by the clock would
    ask for them without end.
    """
    own = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        query = found.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)

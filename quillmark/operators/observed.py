"""Counters of a run from the pass that does its work: observed metrics and a listener."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from . import merge


def merge_and_count(stored: DataFrame, rows: DataFrame, key: str, seq: str, fields: list[str], path: str, last_wins: tuple[str, ...] = merge.LAST_WINS) -> DataFrame:
    """Write the merged corpus under ``path``; one row: raw rows, keys new to ``stored``, rows merged and keys in all.

    ``stored`` (key and ``fields``, in no order) comes before all ``rows`` (with
    ``seq``).  Both are read once; the counters are observed while the merged
    rows are written.
    """
    spark = rows.sparkSession
    old = stored.select(key, F.struct(F.lit(0).alias("fresh"), F.lit(None).cast("long").alias("seq")).alias("__at"), *fields)
    new = rows.select(key, F.struct(F.lit(1).alias("fresh"), F.col(seq).cast("long").alias("seq")).alias("__at"), *fields)
    arrived = {"__raw": F.count_if(F.col("__at.fresh") == 1), "__known": F.count_if(F.col("__at.fresh") == 0)}
    merged = merge.merge_arrivals(old.unionByName(new), key, "__at", fields, last_wins, queries=None, also=arrived)
    seen = Observation("merge")
    counted = merged.observe(seen, F.coalesce(F.sum("__raw"), F.lit(0)).alias("raw"), F.count_if(F.col("__known") == 0).alias("new"), F.count(F.lit(1)).alias("total"))
    counted.drop("__raw", "__known", "arrivals").write.mode("overwrite").parquet(path)
    found = seen.get
    return spark.createDataFrame([(found["raw"], found["new"], found["raw"] - found["new"], found["total"])], "raw long, new long, merged long, total long")


def observed_run(stream: DataFrame, changed: Column, name: str = "run") -> DataFrame:
    """``stream``, counting the records and the changed ones of each batch."""
    return stream.observe(name, F.count(F.lit(1)).alias("records_found"), F.count_if(changed).alias("records_changed"))


class RunListener(StreamingQueryListener):
    """Appends a row to the table of runs for each batch of a query that observes ``name``, when the query ends."""

    def __init__(self, spark: SparkSession, runs: str, mode: str, source: str, name: str = "run"):
        self.spark, self.runs, self.mode, self.source, self.name = spark, runs, mode, source, name
        self.rows: list[tuple] = []
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None and event.progress.numInputRows:
            self.rows.append((self.mode, self.source, event.progress.batchId, event.progress.timestamp, seen.records_found, seen.records_changed, True))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.rows.append((self.mode, self.source, None, None, 0, 0, False))
        if self.rows:
            kinds = "mode string, source string, batch long, started string, records_found long, records_changed long, healthy boolean"
            self.spark.createDataFrame(self.rows, kinds).coalesce(1).write.mode("append").parquet(self.runs)
        self.ended.set()


def run_and_record(stream: DataFrame, changed: Column, path: str, checkpoint: str, runs: str, mode: str = "delta", source: str = "portal") -> StreamingQuery:
    """Append the stream to ``path`` until all that has landed is read, and its run to ``runs``."""
    spark = stream.sparkSession
    listener = RunListener(spark, runs, mode, source)
    spark.streams.addListener(listener)
    try:
        query = observed_run(stream, changed).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        listener.ended.wait(60)
        spark.streams.removeListener(listener)
    return query

"""Event windows with watermarks: an extension over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def land_events(spark: SparkSession, path: str, landing: str, files: int = 3) -> str:
    """Copy the events table into a landing folder, as files that arrive together."""
    spark.read.parquet(path).repartition(files).write.mode("append").parquet(landing)
    return landing


def read_events(spark: SparkSession, landing: str) -> DataFrame:
    """A stream over landed event files, event time as a timestamp."""
    schema = spark.read.parquet(landing).schema
    return spark.readStream.schema(schema).parquet(landing).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Count and sum per event type and window; a window is out once the watermark has passed it."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Sessions per user, closed by a gap without events."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
    )


def collect_stream(stream: DataFrame, checkpoint: str, path: str, spark: SparkSession) -> DataFrame:
    """Run a stream over what is available into Parquet and read it back."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)

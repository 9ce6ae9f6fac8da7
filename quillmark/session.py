"""Session builder with the settings the engine expects."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names.

    Where a local session names none (tests) a temporary folder is set; on a
    cluster, whose machines don't share one, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quillmark-{uuid.uuid4().hex}/{name}"


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """``df`` written to the shared scratch folder and read back, so that its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew if it lies in fewer parts than there are cores (tables of few files)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def build_session(app: str = "quillmark", cores: int | None = None, shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session; on a cluster the master and memory come from spark-submit."""
    n = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
    )
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{n}]")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

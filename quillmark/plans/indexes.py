"""Text indexes of the document table, built once per session and table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.retrieve import Indexes
from ..operators.textindex import Bm25Index, TfidfIndex, build_bm25, build_tfidf, char_grams, word_grams
from ..operators.vectorindex import VectorIndex, build_vector_index
from ..session import scratch
from .tables import documents

_BUILT: dict[tuple[str, str, str], object] = {}


def _state(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files: another state asks for another index."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, out = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True), []
    while found.hasNext():
        file = found.next()
        out.append(f"{file.getPath()}:{file.getLen()}:{file.getModificationTime()}")
    return "|".join(sorted(out))


def _once(spark: SparkSession, sf_dir: str, kind: str, build: Callable[[str], object], source: str = "documents"):
    """The index of this kind; later queries of the session read the tables that the first one wrote, as long as the table is the same."""
    key = (spark.sparkContext.applicationId, _state(spark, f"{sf_dir}/{source}.parquet"), kind)
    if key not in _BUILT:
        _BUILT[key] = build(scratch(spark, f"index-{kind}"))
    return _BUILT[key]


def bm25(spark: SparkSession, sf_dir: str) -> Bm25Index:
    return _once(spark, sf_dir, "bm25", lambda path: build_bm25(documents(spark, sf_dir), path))


def words(spark: SparkSession, sf_dir: str) -> TfidfIndex:
    return _once(spark, sf_dir, "word", lambda path: build_tfidf(documents(spark, sf_dir), path, word_grams))


def characters(spark: SparkSession, sf_dir: str) -> TfidfIndex:
    return _once(spark, sf_dir, "char", lambda path: build_tfidf(documents(spark, sf_dir), path, char_grams))


def vectors(spark: SparkSession, sf_dir: str, pool: DataFrame) -> VectorIndex:
    return _once(spark, sf_dir, "vectors", lambda path: build_vector_index(pool, path, keep=("label",)), "embeddings")


def of_profile(spark: SparkSession, sf_dir: str, profile: str) -> Indexes:
    if profile == "production":
        return Indexes(bm25=bm25(spark, sf_dir))
    return Indexes(word=words(spark, sf_dir), char=characters(spark, sf_dir))

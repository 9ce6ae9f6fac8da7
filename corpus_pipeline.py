"""The corpus pipeline: from raw documents to sharded training text.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns a DataFrame; all but the last return the columns of documents.

Extra columns, whatever their names, are carried along; only columns named shard
or slot are replaced in the end.  An empty table goes through as an empty table.
Texts are used whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import decontaminate, minhash, mixing, sharding, toxicity
from quillmark.llm.common import materialize, read_table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at the threshold or above go.

    Null and empty texts have the score of a text without features, far below
    the threshold, and stay; equal rows go or stay together.
    """
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, stays of each group.

    Texts without words and rows without doc_id stay; rows that repeat a doc_id
    are one document and stay or go together.
    """
    return minhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null, empty and wordless texts stay; equal rows go or stay together.
    """
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares meet the target marginals.

    Null categories count as the empty category, null texts have no tokens; rows
    of one doc_id in one cell are kept or left together.
    """
    return mixing.sample_mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot.

    Rows without doc_id share the place of the empty key; rows of one doc_id are
    told apart by length and text, and equal rows may change places.
    """
    return sharding.assign_shards(docs, tie=("n_chars", "text"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can express neither the classifier nor the window fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

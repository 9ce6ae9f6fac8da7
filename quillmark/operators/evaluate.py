"""Retrieval-quality metrics over ranked results and expected labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contain import containing

HITS, RECALLS = (1, 3, 5), (3, 5)


def holders(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents (doc_id, text) that hold a passage (query_id, text) as it stands."""
    return containing(docs, passages.select("query_id", F.col("text").alias("pattern")))


def case_metrics(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query of ``expected`` (query_id, doc_id): hit@k, recall@k and reciprocal rank.

    ``ranked``: query_id, doc_id, rank.  A query without expected documents has
    recall 1 by convention; one that finds none has reciprocal rank 0.
    """
    wanted = expected.select("query_id", "doc_id").distinct()
    found = wanted.join(ranked.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    hits = [F.max(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))).alias(f"hit_{k}") for k in HITS]
    recalls = [(F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"recall_{k}") for k in RECALLS]
    return found.groupBy("query_id").agg(*hits, *recalls, F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"))


def macro_metrics(cases: DataFrame) -> DataFrame:
    """Means over queries, rounded to four digits."""
    names = [f"hit_{k}" for k in HITS] + [f"recall_{k}" for k in RECALLS]
    return cases.agg(F.count("*").alias("cases"), *(F.round(F.avg(n), 4).alias(n) for n in names), F.round(F.avg("rr"), 4).alias("mrr"))


def failures(cases: DataFrame) -> DataFrame:
    """Queries without a hit among the first three."""
    return cases.filter("hit_3 = 0").select("query_id")

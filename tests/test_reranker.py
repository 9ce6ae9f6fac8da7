from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import reranker
from quillmark.operators import retrieve as R

SF = "/root/testdata/sf0.01"


def test_features_of_a_pair():
    assert reranker.pair_features("red Steel rod", "a RED steel rod, b", 2.0) == (1.0, 1.0, 1.0, 1.0, float(np.log1p(5)), 2.0)
    assert reranker.pair_features("red steel rod", "rod steel red", 0.5)[:4] == (1.0, 0.0, 0.0, 0.0)
    assert reranker.pair_features(None, None, None) == (0.0,) * 6 and reranker.pair_features("x", "y", 1.0)[0] == 0.0


def test_scorer_reorders_and_empty_classes_have_no_model(spark):
    docs = spark.createDataFrame([(1, "rod steel red other words"), (2, "the red steel rod stands"), (3, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "red steel rod")], "query_id long, text string")
    fused = spark.createDataFrame([(7, 1, 3.0), (7, 2, 2.0), (7, 3, 1.0)], "query_id long, doc_id long, fused double")
    model = reranker.fit(np.array([[1, 1, 1, 1, 2, 1], [1, 0, 0, 0, 2, 1], [0, 0, 0, 0, 1, 1]], float), np.array([1, 0, 0]))
    got = R.rerank(fused, reranker.scorer(model), 2, texts=lambda rows: reranker.with_texts(rows, queries, docs))
    assert [(r["doc_id"], r["position"]) for r in got.orderBy("position").collect()] == [(2, 1), (1, 2)] and "text" not in got.columns
    pairs = reranker.with_texts(fused, queries, docs)
    assert reranker.train(pairs, fused.limit(0)) is None
    assert reranker.train(pairs, fused.filter("doc_id = 2"), most=3).weight.shape == (6,)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
def test_more_first_places_are_right_on_unseen_items(spark):
    from quillmark.operators import evaluate
    from quillmark.plans import retrieval
    from quillmark.plans.tables import benchmark_queries, documents

    right = evaluate.holders(documents(spark, SF), benchmark_queries(spark, SF)).withColumn("right", F.lit(1))
    unseen = F.crc32(F.col("query_id").cast("string").cast("binary")) % 2 == 1
    ranked = [retrieval.reranked(spark, SF, scorer).filter(unseen & (F.col("position") == 1)) for scorer in (None, retrieval.fitted_scorer(spark, SF))]
    hits = [rows.join(right, ["query_id", "doc_id"]).count() for rows in ranked]
    assert hits[1] > hits[0], hits


def test_pairs_are_chosen_without_their_texts(spark):
    pairs = spark.range(40).selectExpr("id % 4 AS query_id", "id AS doc_id", "'asked' AS query", "repeat('text ', 100) AS text", "1.0D AS fused")
    got = reranker.bounded(pairs, 7)
    taken = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "TakeOrderedAndProject" in line]
    assert taken and not any("text" in line for line in taken)
    want = pairs.orderBy(F.xxhash64("query_id", "doc_id"), "query_id", "doc_id").limit(7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

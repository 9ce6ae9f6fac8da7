import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import retrieve as R
from quillmark.operators import vectorindex as V

KIND = "doc_id long, vector array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], i % 3) for i, v in rows], KIND)


def asked_of(df, every=50):
    return df.filter(f"doc_id % {every} = 0").selectExpr("doc_id AS query_id", "vector AS query_vector")


@pytest.mark.parametrize("kind", ["isotropic", "clustered"])
def test_recall_against_the_exact_search(spark, tmp_path, kind):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(3_000, 24))
    if kind == "clustered":
        rows += rng.normal(size=(40, 24))[rng.integers(40, size=3_000)] * 4
    df = frame(spark, list(enumerate(rows)))
    index = V.build_vector_index(df, f"{tmp_path}/v")
    exact = R.knn(df.select("doc_id", "vector"), asked_of(df), 10)
    wanted, found = V.recall_of(V.search(index, asked_of(df), 10), exact).agg({"wanted": "sum", "found": "sum"}).select("sum(wanted)", "sum(found)").first()
    assert wanted == 600 and found / wanted >= 0.9
    if kind == "clustered":
        assert index.codec.probes < len(index.codec.centres) / 2


def test_all_cells_and_deep_refinement_are_exact(spark, tmp_path):
    rng = np.random.default_rng(3)
    same = rng.normal(size=8)
    rows = [(i, same if i % 3 == 0 else rng.normal(size=8)) for i in range(900)] + [(2_000, None), (2_001, np.zeros(8)), (2_002, same), (2_002, same)]
    df = frame(spark, rows)
    index = V.build_vector_index(df, f"{tmp_path}/v", keep=("label",))
    exact = sorted(map(tuple, R.knn(df.select("doc_id", "vector", "label"), asked_of(df), 7, where=F.col("label") == 1).collect()))
    got = V.search(index, asked_of(df), 7, probes=10**6, refine=200, where=F.col("label") == 1)
    assert sorted(map(tuple, got.select("query_id", "doc_id", "score", "rank").collect())) == exact
    assert index.rows.filter("cell = 0").count() <= 903


def test_nothing_to_index_or_to_ask(spark, tmp_path):
    df = frame(spark, [(1, None), (2, np.zeros(4))])
    assert V.build_vector_index(df, f"{tmp_path}/a") is None and V.build_vector_index(df.limit(0), f"{tmp_path}/b") is None
    one = frame(spark, [(1, [1, 0, 0, 0])])
    index = V.build_vector_index(one, f"{tmp_path}/c")
    assert V.search(index, asked_of(one, 1).limit(0), 3).count() == 0
    assert [tuple(r) for r in V.search(index, asked_of(one, 1), 3).collect()] == [(1, 1, 1.0, 1)]


def test_blocks_of_queries_and_pruned_cells(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    df = frame(spark, list(enumerate(rng.normal(size=(600, 16)))))
    index = V.build_vector_index(df, f"{tmp_path}/v")
    whole = sorted(map(tuple, V.search(index, asked_of(df, 25), 4).collect()))
    monkeypatch.setattr(V, "QUERY_BYTES", 60_000)
    assert sorted(map(tuple, V.search(index, asked_of(df, 25), 4).collect())) == whole
    few = V.search(index, asked_of(df, 300), 4, probes=1)
    assert few.count() and "PartitionFilters: [cell" in few._jdf.queryExecution().toString()

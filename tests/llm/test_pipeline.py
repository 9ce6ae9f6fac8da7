"""The pipeline against its stages worked out one by one on the smallest tables."""

from pathlib import Path

import pytest

import corpus_pipeline
from quillmark.llm import decontaminate, minhash, mixing, sharding, toxicity
from quillmark.llm.common import read_table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def test_stages_take_effect_and_reach_the_end(spark):
    docs = read_table(spark, SF, "documents").cache()
    rows = docs.collect()
    toxic = {r["doc_id"] for r in toxicity.toxicity_scores(docs, read_table(spark, SF, "labels")).collect() if r["predicted"]}
    left = [r for r in rows if r["doc_id"] not in toxic]
    twin = {r["doc_id"] for r in minhash.near_duplicates(spark.createDataFrame(left, docs.schema)).collect() if not r["kept"]}
    left = [r for r in left if r["doc_id"] not in twin]
    leaked = {r["doc_id"] for r in decontaminate.contamination(spark.createDataFrame(left, docs.schema), read_table(spark, SF, "benchmark")).collect() if r["contaminated"]}
    left = [r for r in left if r["doc_id"] not in leaked]
    sampled = {r["doc_id"] for r in mixing.mixed(spark.createDataFrame(left, docs.schema)).collect() if r["kept"]}
    ended = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(spark.createDataFrame([r for r in left if r["doc_id"] in sampled], docs.schema), tie=("n_chars", "text")).collect()}
    assert toxic and twin and leaked and 0 < len(sampled) < len(left)
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*docs.columns, "shard", "slot"]
    assert {r["doc_id"]: r["shard"] for r in got.collect()} == ended


def test_all_stages_but_the_last_return_documents(spark):
    docs = read_table(spark, SF, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def documents_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 toxic", "'x' item_id", "2 shard", "3 _mix", "'d' digest", "4 weight")


def test_stages_with_nulls_long_texts_repeated_rows_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "a", len(long)), (4, long, "en", "b", len(long)), (5, "plain words only here", "en", "a", 21), (5, "plain words only here", "en", "a", 21), (None, "no number", "en", "a", 9)]
    docs = documents_of(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        left = sorted(r["doc_id"] or 0 for r in kept.collect())
        if name == "near_duplicates":
            assert left == [0, 1, 2, 3, 5, 5]
        elif name in ("toxicity", "decontamination"):
            assert left == [0, 1, 2, 3, 4, 5, 5]
        else:
            assert set(left) <= {0, 1, 2, 3, 4, 5}
    ended = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(ended) == len(rows) and {c for c in docs.columns} <= set(ended[0].asDict())


def test_stages_of_empty_tables(spark):
    docs = documents_of(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0

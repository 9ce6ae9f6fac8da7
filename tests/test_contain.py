import random
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest

from quillmark.operators import contain, evaluate
from quillmark.sources import corpus

TEXT, PATTERN = "doc_id long, text string", "query_id long, pattern string"


def brute(texts, patterns):
    return sorted((q, d) for d, t in texts for q, p in patterns if t is not None and p is not None and p in t)


@pytest.mark.parametrize("size", [1 << 24, 60])
def test_pairs_are_those_of_plain_comparison(spark, monkeypatch, size):
    monkeypatch.setattr(contain, "BLOCK_BYTES", size)
    rng = random.Random(7)
    texts = [(i, "".join(rng.choice("ab é𝔘\n") for _ in range(rng.choice([0, 3, 30, 400])))) for i in range(150)] + [(900, None), (901, "ab" * 200_000), (1, "ab é"), (1, "ab é")]
    patterns = [(i, rng.choice([t for _, t in texts[:150]])[rng.randrange(20) :][: rng.choice([1, 2, 5, 8, 9, 40])]) for i in range(60)] + [(100, "zz"), (101, None), (102, "\0"), (103, "abababababababababab"), (104, "")]
    got = contain.containing(spark.createDataFrame(texts, TEXT).repartition(3), spark.createDataFrame(patterns, PATTERN))
    assert got.columns == ["query_id", "doc_id"]
    assert sorted(map(tuple, got.collect())) == brute(texts, patterns)


def test_empty_tables_and_plans_without_nested_loops(spark):
    texts, patterns = spark.createDataFrame([(1, "some text here")], TEXT), spark.createDataFrame([(5, "text")], PATTERN)
    assert contain.containing(texts.limit(0), patterns).count() == contain.containing(texts, patterns.limit(0)).count() == 0
    found = evaluate.holders(texts, patterns.withColumnRenamed("pattern", "text"))
    assert [tuple(r) for r in found.collect()] == [(5, 1)]
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Exchange" not in found._jdf.queryExecution().toString()


def test_tenders_by_part_of_their_id(spark):
    tenders = spark.createDataFrame([("GEM/2024/B/1", "one", "spec 1"), ("GEM/2024/B/12", "two", "spec 2"), ("X", "three", "spec 3")], "tender_id string, title string, raw_specification string")
    requests = spark.createDataFrame([("GEM/2024/B/12",), ("gem/2024/b/1",), ("prefix gem/2024/b/12 suffix",), ("nothing",), ("max",)], "request string")
    found = corpus.fetch_tenders(requests, tenders)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    got = {r["request"]: (r["tender_id"], r["found"]) for r in found.collect()}
    assert got == {
        "GEM/2024/B/12": ("GEM/2024/B/12", "equal"), "gem/2024/b/1": ("GEM/2024/B/1", "similar"), "prefix gem/2024/b/12 suffix": ("GEM/2024/B/1", "similar"),
        "nothing": ("nothing", "made"), "max": ("X", "similar"),
    }


def test_few_texts_at_a_time_become_objects():
    texts = [f"{i:03d}" + "word " * 20_000 for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(texts)], ["doc_id", "text"])
    posted = contain._Posted.of(pa.array([1, 2]), ["017word w", "none of them"], texts[:5])
    tracemalloc.start()
    found = [r for b in contain._holding(SimpleNamespace(value=posted), ["query_id", "doc_id"])(iter([batch])) for r in b.to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [{"query_id": 1, "doc_id": 17}] and most < 30_000_000, most

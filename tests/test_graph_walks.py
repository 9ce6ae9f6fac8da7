"""The depth-free closure against breadth-first search, and counters of a run."""

import random
from collections import deque

from pyspark.sql import functions as F

from quillmark.operators import graph, merge, observed
from quillmark.session import kept

EDGES = "src long, dst long, role string"


def brute(edges, roots):
    out = {}
    for root in roots:
        for first, kind in {(b, r) for a, b, r in edges if a == root and b != root}:
            todo, seen = deque([(first, 1)]), {first}
            while todo:
                node, hop = todo.popleft()
                key = (root, kind, node)
                out[key] = min(out.get(key, hop), hop)
                for a, b, _ in edges:
                    if a == node and b != root and b not in seen:
                        seen.add(b)
                        todo.append((b, hop + 1))
    return out


def test_closure_of_cycles_hubs_and_chains(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 8)
    rng = random.Random(3)
    edges = [(i, i + 1, "next") for i in range(12)] + [(12, 3, "back"), (5, 5, "self")] + [(30, 40 + j, rng.choice("ab")) for j in range(20)] + [(2, 30, "hub"), (45, 30, "hub"), (41, 2, "x"), (41, 2, "x")]
    roots = [0, 2, 5, 30, 41, 99]
    df, own = spark.createDataFrame(edges, EDGES), spark.createDataFrame([(r,) for r in roots + [0]], "root long")
    got = {(r["root"], r["first_type"], r["node"]): r["hop"] for r in graph.full_closure(df, own, kept).collect()}
    assert got == brute(edges, roots) and max(got.values()) > 10
    two = graph.full_closure(df, own, kept, rounds=2)
    assert {(r["root"], r["first_type"], r["node"]): r["hop"] for r in two.collect()} == {k: h for k, h in got.items() if h <= 2}
    assert graph.full_closure(df.limit(0), own, kept).count() == graph.full_closure(df, own.limit(0), kept).count() == 0


def test_counters_are_those_of_the_separate_count(spark, tmp_path):
    rows = spark.createDataFrame([(i % 7, i, None if i % 2 else f"t{i}", f"v{i}") for i in range(40)], "key long, seq long, title string, valid_upto string")
    stored = spark.createDataFrame([(k, None, "old") for k in (1, 2, 50)], "key long, title string, valid_upto string")
    got = observed.merge_and_count(stored, rows, "key", "seq", ["title", "valid_upto"], f"{tmp_path}/m")
    assert got.collect() == merge.merge_counters(rows, stored, "key").collect()
    merged = {r["key"]: (r["title"], r["valid_upto"]) for r in spark.read.parquet(f"{tmp_path}/m").collect()}
    assert merged[50] == (None, "old") and merged[1] == ("t8", "v36") and merged[0] == ("t0", "v35") and len(merged) == 8
    empty = observed.merge_and_count(stored.limit(0), rows.limit(0), "key", "seq", ["title"], f"{tmp_path}/e").first()
    assert tuple(empty) == (0, 0, 0, 0)


def test_a_failed_run_is_recorded_as_unhealthy(spark, tmp_path):
    import pytest

    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "x")], "id long, t string").write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, t string").parquet(f"{tmp_path}/in").withColumn("bad", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        observed.run_and_record(stream, F.lit(True), f"{tmp_path}/out", f"{tmp_path}/c", f"{tmp_path}/runs")
    assert [(r["mode"], r["healthy"]) for r in spark.read.parquet(f"{tmp_path}/runs").collect()] == [("delta", False)]


def test_closure_of_a_long_chain_takes_few_rounds(spark):
    """The rounds grow with the logarithm of the depth, where no root lies on a cycle."""
    written = []

    def noted(df):
        written.append(1)
        return kept(df)

    chain = spark.createDataFrame([(i, i + 1, "next") for i in range(40)], EDGES)
    got = graph.full_closure(chain, spark.createDataFrame([(0,), (35,)], "root long"), noted).collect()
    assert {(r["root"], r["node"]): r["hop"] for r in got} == {(root, n): n - root for root in (0, 35) for n in range(root + 1, 41)} and len(written) < 20


def test_similarity_of_pairs_reads_them_once(spark, tmp_path):
    vectors = spark.createDataFrame([(1, [1, 2, 9], [0.6, 0.8, 0.0]), (2, [2, 1], [0.6, 0.8]), (3, [5], [1.0])], "doc_id long, numbers array<long>, ws array<double>")
    seen = spark.sparkContext.accumulator(0)

    def counted(n):
        seen.add(1)
        return n

    rows = [(1, 2), (2, 1), (1, 2), (1, 3), (1, 4), (4, 1), (4, 4)]
    pairs = spark.createDataFrame(rows, "root long, at long").select("root", F.udf(counted, "long")("at").alias("node"))
    got = sorted((r["root"], r["node"], round(r["similarity"], 9)) for r in graph.pair_similarity(pairs, vectors, "root", "node").collect())
    assert got == sorted((a, b, 0.96 if {a, b} == {1, 2} else 0.0) for a, b in rows) and seen.value == len(rows)


def test_paths_are_dealt_out_in_bounded_parts(spark, monkeypatch):
    """The shortest paths by first type are those of a walk, and more rows lie in more parts."""
    monkeypatch.setattr(graph, "PATHS", 20, raising=False)
    rng = random.Random(5)
    edges = [(rng.randrange(30), rng.randrange(30), rng.choice("xyz")) for _ in range(90)] + [(1, 2, "x")] * 2
    for depth in (1, 2, 3):
        out = graph.first_type_closure(spark.createDataFrame(edges, EDGES), spark.range(30).withColumnRenamed("id", "root"), depth, limit=7)
        assert out.rdd.getNumPartitions() >= 92 * (3**depth - 1) / 2 / 20
        want = set()
        for root in range(30):
            found, ends = {}, {(b, r) for a, b, r in edges if a == root}
            for hop in range(1, depth + 1):
                for end in ends:
                    found.setdefault(end, hop)
                ends = {(b, r) for node, r in ends for a, b, _ in edges if a == node}
            ranked = sorted((hop, node, r) for (node, r), hop in found.items() if node != root)[:7]
            want |= {(root, node, r, hop, n + 1) for n, (hop, node, r) in enumerate(ranked)}
        assert {tuple(r) for r in out.select("root", "node", "first_type", "hop", "place").collect()} == want

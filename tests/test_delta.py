"""Batches of the delta stream: replay and parts that aren't touched."""

from pathlib import Path

from pyspark.sql import functions as F

from quillmark.operators import cdc
from quillmark.operators import store as table
from quillmark.streaming import changes, delta

KIND = "is_number string, title string, year int, status string, division string, amendments array<string>, normative_references array<string>, certification string, supersedes string, scope string"


def records(spark, pairs):
    return spark.createDataFrame([(k, t, 2000, "current", "D", [], [], None, None, "s") for k, t in pairs], KIND)


def test_replayed_batches_and_untouched_parts(spark, tmp_path):
    store, log = f"{tmp_path}/store", f"{tmp_path}/log"
    write = delta.delta_writer(store, log)
    write(records(spark, [(f"k{i}", "old") for i in range(300)]), 0)
    for _ in range(2):  # the second time as after a failure
        write(records(spark, [("k7", "new"), ("k999", "fresh"), ("k8", "old")]), 1)
    schema = records(spark, []).withColumns({"content_hash": F.lit(""), "scope_hash": F.lit("")}).schema
    got = {r["is_number"]: r["title"] for r in delta.current(spark, store, schema).collect()}
    assert len(got) == 301 and (got["k7"], got["k8"], got["k999"]) == ("new", "old", "fresh")
    assert {r["title"] for r in delta.current(spark, store, schema, before=1).collect()} == {"old"}
    assert len(list(Path(store, "batch=1").glob("of=*/bucket=*"))) <= 3 < len(list(Path(store, "batch=0").glob("of=*/bucket=*")))
    logged = {(r["batch"], r["is_number"]): r["change_type"] for r in delta.logged(spark, log).filter("batch = 1").collect()}
    assert logged == {(1, "k7"): "scope", (1, "k999"): "new"}
    write(records(spark, []), 2)
    assert delta.current(spark, store, schema).count() == 301


def landed(spark, folder, rows):
    spark.createDataFrame(rows, KIND + ", seq long").coalesce(1).write.mode("append").parquet(folder)


def test_state_tells_changes_as_the_stored_table_does(spark, tmp_path):
    """Two runs with one checkpoint: the second knows what the first has seen, without a table."""
    landing, path, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "c"))
    base = ("t", 2000, "current", "D", ["a1"], ["IS 1", "IS 2"], None, None, "s")
    edits = {"same": {}, "order": {5: ["IS 2", "IS 1"]}, "title": {0: "u"}, "space": {0: " t "}, "year": {1: None}, "gone": {2: "withdrawn"}, "refs": {5: ["IS 1"]}, "cert": {6: "x"}, "scope": {8: "z"}, "gone and scope": {2: "superseded", 8: "z"}}
    first = [(k, *base, 1) for k in edits]
    second = [(k, *(change.get(i, v) for i, v in enumerate(base)), 3) for k, change in edits.items()] + [("same", "older", *base[1:], 2), ("fresh", *base, 4)]
    schema = spark.createDataFrame([], KIND + ", seq long").schema
    for rows in (first, second):
        landed(spark, landing, rows)
        found = changes.changes(spark.readStream.schema(schema).parquet(landing))
        changes.run_changes(spark, found, checkpoint, path)
    got = {(r["is_number"], r["seq"]): (r["change_type"], sorted(r["changed_fields"])) for r in spark.read.schema(found.schema).parquet(path).collect()}
    assert all(got[k, 1] == ("new", ["*"]) for k in edits) and got["fresh", 4] == ("new", ["*"]) and len(got) == 2 * len(edits) + 1
    hashed = [cdc.with_hashes(spark.createDataFrame([r[:-1] for r in rows if r[-1] != 2], KIND)) for rows in (second, first)]
    for r in cdc.detect_changes(*hashed).filter("is_number <> 'fresh'").collect():
        assert got[r["is_number"], 3] == (r["change_type"], sorted(r["changed_fields"])), r


def test_state_expires(spark, tmp_path):
    landing, path, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "c"))
    schema = spark.createDataFrame([], KIND + ", seq long").schema
    for n in range(2):
        landed(spark, landing, [("k", "t", 2000, "current", "D", [], [], None, None, "s", n)])
        found = changes.changes(spark.readStream.schema(schema).parquet(landing), keep_ms=1)
        changes.run_changes(spark, found, checkpoint, path)
    assert [r["change_type"] for r in spark.read.schema(found.schema).parquet(path).collect()] == ["new", "new"]


def test_parts_grow_with_the_store_and_replaced_ones_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delta, "BUCKET_ROWS", 10)
    store, log = f"{tmp_path}/store", f"{tmp_path}/log"
    write = delta.delta_writer(store, log)
    schema = records(spark, []).withColumns({"content_hash": F.lit(""), "scope_hash": F.lit("")}).schema
    for n in range(4):
        write(records(spark, [(f"k{i}", f"t{n}") for i in range(60 * n + 1)]), n)
        got = {r["is_number"]: r["title"] for r in delta.current(spark, store, schema).collect()}
        assert got == {f"k{i}": f"t{n}" for i in range(60 * n + 1)}
    sizes = {int(p.name.removeprefix("of=")) for p in Path(store, "batch=3").glob("of=*")}
    assert sizes == {32} and {r["title"] for r in delta.current(spark, store, schema, before=3).collect()} == {"t2"}
    assert not list(Path(store, "batch=0").glob("of=*/bucket=*")) and not list(Path(store, "batch=1").glob("of=*/bucket=*"))


def test_upsert_joins_the_stored_side_in_place(spark, tmp_path, monkeypatch):
    base = f"{tmp_path}/store"
    hashed = lambda pairs: cdc.with_hashes(records(spark, pairs))
    table.upsert_store(spark, base, hashed([(f"k{i}", "old") for i in range(200)]))
    fresh = hashed([("k7", "new"), ("k999", "fresh")])
    stored = table.open_store(spark, base, fresh.schema, "is_number")
    monkeypatch.setattr(table, "FIRST", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = cdc.upsert(stored, fresh)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    got = {r["is_number"]: r["title"] for r in table.upsert_store(spark, base, fresh).collect()}
    assert len(got) == 201 and (got["k7"], got["k8"], got["k999"]) == ("new", "old", "fresh")
    monkeypatch.setattr(table, "ROWS", 10)
    table.upsert_store(spark, base, hashed([("k5", "grown")]))
    assert [b for _, b in table.versions(spark, base)] == [8, 8, 32]
    again = table.upsert_store(spark, base, hashed([("k6", "grown")]))
    assert {r["title"] for r in again.filter("is_number in ('k5', 'k6')").collect()} == {"grown"} and again.count() == 201
    assert table.drop_versions(spark, base) == [1, 2] and [n for n, _ in table.versions(spark, base)] == [3, 4]


def test_a_batch_is_worked_out_once_and_takes_all_files(spark, tmp_path):
    landing, store, log = (f"{tmp_path}/{n}" for n in ("in", "store", "log"))
    seen, batches = spark.sparkContext.accumulator(0), []

    def title(k):
        seen.add(1)
        return f"t{k}"

    rows = records(spark, [(f"k{i}", "t") for i in range(40)]).repartition(4)
    rows.write.parquet(landing)
    write = delta.delta_writer(store, log)

    def noted(batch, number):
        batches.append(number)
        write(batch.withColumn("title", F.udf(title, "string")("is_number")), number)

    delta.run_delta(spark, landing, rows.schema, noted, f"{tmp_path}/c", files_per_batch=None)
    assert batches == [0] and seen.value == 40

import json
import time
from pathlib import Path

import pytest

from quillmark.sources import service as S


def land(folder, department, offset, body):
    place = Path(folder) / department
    place.mkdir(parents=True, exist_ok=True)
    (place / f"{offset}.json").write_text(body if isinstance(body, str) else json.dumps(body))


def page(*numbers, total=3):
    return {"status": "SUCCESS", "totalRecords": total, "data": [{"standardNumber": f"IS {n}", "nested": {"a": [n]}, "none": None} for n in numbers]}


def stored(spark, store, part="records"):
    return spark.read.parquet(f"{store}/{part}/batch=*")


def test_pages_as_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    land(folder, "ETD", 0, page(1, 2))
    land(folder, "ETD", 100, page())
    land(folder, "CED", 0, {"status": "FAILED", "data": []})
    land(folder, "CED", 100, "not json")
    land(folder, "MED", 0, "[1]")
    land(folder, "MED", 7, {"status": "SUCCESS", "totalRecord": "12", "data": ["text"]})
    (tmp_path / "in/ETD/200.json.part").write_text("half")
    spark.dataSource.register(S.LandedPages)
    rows = {(r["department"], r["offset"], r["position"]): r for r in spark.read.format("landed_pages").load(folder).collect()}
    assert len(rows) == 7
    assert rows["ETD", 0, 1]["record"] == {"standardNumber": "IS 2", "nested": '{"a": [2]}', "none": None} and rows["ETD", 0, 1]["total"] == 3
    assert rows["ETD", 100, None]["error"] is None and rows["CED", 0, None]["error"] == "FAILED"
    assert {rows[k]["error"] for k in (("CED", 100, None), ("MED", 0, None), ("MED", 7, None))} == {"unreadable"}
    own = spark.read.format("landed_pages").option("departments", "ETD, MED").load(folder)
    assert {r["department"] for r in own.collect()} == {"ETD", "MED"} and own.rdd.getNumPartitions() == 4
    Path(tmp_path / "none").mkdir()
    assert spark.read.format("landed_pages").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("landed_pages").load(str(tmp_path / "nowhere")).count()


def test_a_stopped_run_goes_on(spark, tmp_path):
    """A batch that fails is run again by the next run; pages that land late or out of order are read once."""
    folder, store, checkpoint = (str(tmp_path / n) for n in ("in", "store", "checkpoint"))
    land(folder, "ETD", 0, page(1, 2))
    land(folder, "ETD", 200, page(5))
    S.ingest(spark, folder, store, checkpoint, ("standardNumber",))
    assert sorted(r["standardNumber"] for r in stored(spark, store).collect()) == ["IS 1", "IS 2", "IS 5"]

    land(folder, "ETD", 100, page(3, 4))
    land(folder, "CED", 0, {"status": "ERROR"})
    calls = []

    def fails(batch, number):
        calls.append((number, batch.count()))
        raise RuntimeError("killed")

    query = spark.readStream.format("landed_pages").load(folder).writeStream.foreachBatch(fails).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination()
    assert calls == [(1, 3)]
    land(folder, "MED", 0, page(9))
    S.ingest(spark, folder, store, checkpoint, ("standardNumber",))
    S.ingest(spark, folder, store, checkpoint, ("standardNumber",))
    assert sorted(r["standardNumber"] for r in stored(spark, store).collect()) == [f"IS {n}" for n in (1, 2, 3, 4, 5, 9)]
    assert [(r["department"], r["offset"], r["reason"]) for r in stored(spark, store, "failed").collect()] == [("CED", 0, "ERROR")]


def test_nothing_landed_yet(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    S.ingest(spark, str(folder), store, str(tmp_path / "c"), ("standardNumber",))
    land(folder, "ETD", 0, page(1))
    S.ingest(spark, str(folder), store, str(tmp_path / "c"), ("standardNumber",))
    assert stored(spark, store).count() == 1


def test_many_pages_share_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "PARTITIONS", 3, raising=False)
    folder = str(tmp_path / "in")
    for n in range(10):
        land(folder, "ETD", n, page(n))
    parts = S._Reader(folder, ()).partitions()
    assert len(parts) == 3
    assert sorted(r for part in parts for batch in S._Reader(folder, ()).read(part) for r in batch.column(1).to_pylist()) == list(range(10))
    assert len(S._StreamReader(folder, ()).partitions({"ETD": "0,1"}, {"ETD": ",".join(map(str, range(10)))})) == 3


def test_fresh_pages_of_many_are_told_apart_at_once(monkeypatch):
    pages = [S.Page("ETD", n, f"/in/ETD/{n}.json") for n in range(20_000)]
    monkeypatch.setattr(S, "landed", lambda path, departments=(): pages)
    offset = lambda numbers: {"ETD": ",".join(map(str, numbers))}
    began = time.monotonic()
    parts = S._StreamReader("/in", ()).partitions(offset(range(0, 20_000, 2)), offset(range(20_000)))
    assert time.monotonic() - began < 2
    assert [p.offset for part in parts for p in part.pages] == list(range(1, 20_000, 2))

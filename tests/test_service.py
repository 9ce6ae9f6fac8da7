"""The corpus service on a small corpus."""

import pytest
from pyspark.sql import functions as F

from quillmark.functions.multilingual import normalize_query
from quillmark.service import Service

CERT = "struct<scheme:string,scheme_label:string,mandatory:boolean,product:string>"
KIND = f"is_number string, canonical_key string, title string, year int, status string, division string, scope string, normative_references array<string>, amendments array<struct<number:string,date:string>>, certification {CERT}, superseded_by string, valid_upto string, tier string, seq long"


@pytest.fixture(scope="module")
def service(spark):
    rows = [
        ("IS 1", "IS 1", "PVC insulated cables", 1990, "current", "ETD", "Covers copper cables with PVC insulation for fixed wiring", ["IS 2", "IS 3"], [("1", None), ("2", "May 2001")], ("ISI", None, True, None), None, None, "enriched", 1),
        ("IS 2", "IS 2", "Methods of test for cables", 1991, "withdrawn", "ETD", "Test methods", ["IS 3"], [], None, "IS 9", None, "enriched", 2),
        ("IS 3", "IS 3", "Glossary of terms", None, "current", "ETD", "Terms", [], [], None, None, "2001-01-01", "enriched", 3),
        ("IS 4:2001", "IS 4", "Portland cement", 2001, "current", "CED", None, [], [], None, None, None, "catalogue", 4),
    ]
    return Service(spark.createDataFrame(rows, KIND))


def test_recommend(spark, service):
    asked = spark.createDataFrame([(1, "copper cables with PVC insulation"), (2, "zzzz qqqq")], "query_id long, text string")
    got = {(r["query_id"], r["position"]): r for r in service.recommend(asked).collect()}
    best = got[1, 1]
    assert best["is_number"] == "IS 1" and best["latest_version"] == "IS 1:1990 (Amdt 2, May 2001)"
    assert best["allied"] == {"Test method": ["IS 2"], "Terminology": ["IS 3"]}
    assert "ISI Mark" in best["clause"] and "IS 2" in best["clause"] and best["key_attributes"] == ["cables", "copper", "insulation", "with"]
    assert [r["state"] for (q, _), r in got.items() if q == 2] == ["no_results"]


def test_validate(spark, service):
    docs = spark.createDataFrame([(1, "as per IS 1:1990, IS 2 and IS 77")], "doc_id long, text string")
    issues, suggested, summary = service.validate(docs, F.lit("2026-01-01"))
    assert [(r["is_number"], r["severity"]) for r in issues.orderBy("position").collect()] == [("IS 2", "high"), ("IS 1", "medium"), ("IS 77", "info")]
    assert [(r["is_number"], r["role"], r["referenced_by"]) for r in suggested.collect()] == [("IS 3", "Terminology", "IS 1")]
    assert summary.first()["total_cited"] == 3


def test_detail_list_and_documents(spark, service):
    found = {r["request"]: (r["is_number"], r["step"]) for r in service.detail(spark.createDataFrame([("IS 4",), ("IS 1:1990",), ("IS 8",)], "request string")).collect()}
    assert found == {"IS 4": ("IS 4:2001", 3), "IS 1:1990": ("IS 1", 1), "IS 8": (None, None)}
    assert [r["is_number"] for r in service.list("ETD", " pvc ").collect()] == ["IS 1"]
    docs = spark.createDataFrame([(7, "Head\n1. Supply of copper cables with PVC insulation for fixed wiring in offices\n2. x")], "doc_id long, text string")
    assert {r["query_id"] for r in service.recommend_documents(docs).collect()} == {"7#0"}


def test_feedback_is_checked(spark, service, tmp_path):
    rows = spark.createDataFrame([("r", "IS 1", "accept", None)], "recommendation_id string, is_number string, verdict string, comment string")
    service.feedback(rows, f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").count() == 1
    with pytest.raises(ValueError):
        service.feedback(rows.withColumn("verdict", F.lit("odd")), f"{tmp_path}/f")


def test_queries_in_other_languages(spark):
    asked = ["  PVC cable ", "3 core तांबा केबल IS 694:2010 साठी", "1100 V केबल", None]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string")
    got = [tuple(r[0]) for r in df.orderBy("i").select(normalize_query(F.col("q"))).collect()]
    assert got[0] == ("PVC cable", "en-IN", "PVC cable")
    assert got[1] == ("3 core copper cable IS 694:2010", "mr-IN", asked[1])
    assert got[2][:2] == ("1100 V cable", "hi-IN") and got[3] == ("", "en-IN", "")

"""The functions in SQL agree with the column functions."""

from pyspark.sql import functions as F

from quillmark import sql
from quillmark.functions import classify, ident, multilingual, text

TEXTS = [None, "", "  ", "IS 1554 (Part 1):1988 and is:383-2016", "this 12", "भूमिगत केबल 1.1 kV साठी", "கேபிள்", "Methods of test for cement", "1. " + "long item " * 9 + "\n 2) short\nItem 3 " + "another " * 12, "no items here", "x" * 3000]


def test_scalar_functions(spark):
    sql.register(spark)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    t = F.col("t")
    got = rows.selectExpr("id", "canonical_key(t) k", "standard_family(t) f", "designator_year(t) y", "extract_references(t) r", "same_designation(t, 'IS 1554-1') s", "reference_role(t, 'shall be tested') c", "role_label(reference_role(t, null)) l", "query_language(t) g", "normalize_query(t) n")
    want = rows.select(
        "id", ident.canonical_key(t).alias("k"), ident.standard_family(t).alias("f"), ident.designator_year(t).alias("y"), ident.extract_references(t).alias("r"), ident.same_designation(t, F.lit("IS 1554-1")).alias("s"),
        classify.classify_reference(t, F.lit("shall be tested")).alias("c"), classify.role_label(classify.classify_reference(t)).alias("l"), text.detect_query_language(t).alias("g"), multilingual.normalize_query(t)["normalized"].alias("n"),
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_table_functions(spark):
    sql.register(spark)
    rows = spark.createDataFrame([r for r in enumerate(TEXTS) if r[1] is not None], "id long, t string")
    got = {(r["id"], r["position"]): r["item"] for r in spark.sql("SELECT id, s.position, s.item FROM {rows}, LATERAL segment_items(t) s", rows=rows).collect()}
    want = {(r["id"], r["pos"] + 1): r["col"] for r in rows.select("id", F.posexplode(text.segment_items(F.col("t")))).collect()}
    assert got == want
    assert spark.sql("SELECT * FROM segment_items(CAST(NULL AS STRING))").count() == 0
    page = "<table><tr><td>a<td>b</tr><tr><th>c</th></table><a href='/x'>one <b>two</b></a><a name='n'>no</a>"
    cells = spark.sql("SELECT * FROM page_cells(:page)", args={"page": page}).collect()
    assert [tuple(c) for c in cells] == [(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "c")]
    assert [tuple(r) for r in spark.sql("SELECT * FROM page_links(:page)", args={"page": page}).collect()] == [(1, "/x", "onetwo")]
    spark.createDataFrame([(1, "Ab ab"), (2, None), (None, "ab")], "doc_id long, text string").createOrReplaceTempView("quillmark_texts")
    grams = {(r["doc_id"], r["term"]): r["tf"] for r in spark.sql("SELECT * FROM text_grams(TABLE(SELECT doc_id, text FROM quillmark_texts))").collect()}
    assert grams == {(1, " ab"): 2, (1, "ab "): 2, (1, " ab "): 2, (None, " ab"): 1, (None, "ab "): 1, (None, " ab "): 1}


def test_pages_of_one_small_file_are_parsed_by_all_cores(spark):
    from quillmark.plans.sqlfunctions import page_cells_sql

    assert page_cells_sql(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism

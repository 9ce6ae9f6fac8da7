"""Table-driven cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from quillmark.functions import classify, ident, records, text

KEYS = [
    ("IS 1554 (Part 1) : 1988", "IS 1554-1", 1988),
    ("IS:1554-1", "IS 1554-1", None),
    ("IS 1554 Part 1", "IS 1554-1", None),
    ("IS1554", "IS 1554", None),
    ("IS 732:2019", "IS 732", 2019),
    ("IS 10810-7", "IS 10810-7", None),
    ("IS 8130 (Part 2)", "IS 8130-2", None),
    ("IS 1554-1988", "IS 1554", 1988),
    ("IS 10322 (Part 5/Sec 1):2012", "IS 10322-5-1", 2012),
    ("IS 10322-5-1", "IS 10322-5-1", None),
    ("IS/ISO 9001:2015", "IS/ISO 9001", 2015),
    ("IS/IEC 60079 (Part 1):2014", "IS/IEC 60079-1", 2014),
    ("SP 34:1987", "SP 34", 1987),
    ("IS/QC 260400:2000", "IS/QC 260400", 2000),
    ("no standard here", None, None),
    ("", None, None),
    (None, None, None),
]


def one(spark, rows, kind, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", column).collect())]


def test_keys_and_years(spark):
    raw = [k[0] for k in KEYS]
    assert one(spark, raw, "string", ident.canonical_key(F.col("v"))) == [k[1] for k in KEYS]
    assert one(spark, raw, "string", ident.designator_year(F.col("v"))) == [k[2] for k in KEYS]
    assert one(spark, ["IS 10322-5-1", None], "string", ident.standard_family(F.col("v"))) == ["IS 10322", None]


def test_long_numbers_are_whole(spark):
    """A number isn't cut after its sixth digit, in columns and in SQL."""
    raw = ["IS 1000130", "IS 1000050 (Part 7) : 1990", "SP 12345678-1975", "is:1000031-6"]
    keys, families, years = ["IS 1000130", "IS 1000050-7", "SP 12345678", "IS 1000031-6"], ["IS 1000130", "IS 1000050", "SP 12345678", "IS 1000031"], [None, 1990, 1975, None]
    assert [one(spark, raw, "string", f(F.col("v"))) for f in (ident.canonical_key, ident.standard_family, ident.designator_year)] == [keys, families, years]
    assert one(spark, ["see IS 1000130 and SP 7:1982"], "string", ident.extract_references(F.col("v"))) == [["IS 1000130", "SP 7"]]
    ident.register(spark)
    assert [one(spark, raw, "string", F.expr(f"{name}(v)")) for name in ("canonical_key", "standard_family", "designator_year")] == [keys, families, years]


def test_references_keep_order_and_are_distinct(spark):
    texts = ["Conforms to IS 694:2010 and IS 8130 (Part 2), tested per IS 10810-7.", "IS 456 and IS 456:2000", "none", None]
    assert one(spark, texts, "string", ident.extract_references(F.col("v"))) == [["IS 694", "IS 8130-2", "IS 10810-7"], ["IS 456"], [], []]


def test_strict_designator_needs_a_boundary(spark):
    assert one(spark, ["this 12"], "string", ident.canonical_key(F.col("v"))) == ["IS 12"]
    assert one(spark, ["this 12"], "string", ident.canonical_key(F.col("v"), strict=True)) == [None]


@pytest.mark.parametrize(
    ("title", "context", "role"),
    [
        ("Methods of test for cables Part 7", None, "test_method"),
        ("Methods of test for safety of household appliances", None, "test_method"),
        ("Safety requirements for LV switchgear", None, "safety"),
        ("PVC insulated cables Part 1", None, "related_product"),
        (None, "shall be tested in accordance with", "test_method"),
    ],
)
def test_roles(spark, title, context, role):
    df = spark.createDataFrame([(title, context)], "t string, c string")
    assert df.select(classify.classify_reference(F.col("t"), F.col("c"))).first()[0] == role


def test_status_and_dedup_keys(spark):
    got = one(spark, ["Withdrawn", "superseded by X", "under REVISION", "ok", None], "string", records.normalize_status(F.col("v")))
    assert got == ["withdrawn", "superseded", "under_revision", "current", "current"]
    df = spark.createDataFrame([(" is 5 ", 1, "t"), ("", 2, "t"), (None, None, " t ")], "n string, i int, t string")
    assert [r[0] for r in df.select(records.dedup_key(F.col("n"), F.col("i"), F.col("t"))).collect()] == ["NUM:IS 5", "ID:2", "TITLE:T"]


def test_search_tokens(spark):
    got = one(spark, ["Cable IS 1554-1 rated 1.1 kV", "this 12"], "string", text.search_tokens(F.col("v")))
    assert got == [["is1554-1", "cable", "rated", "1.1", "kv"], ["is12", "th"]]


def test_languages(spark):
    texts = ["3 core cable", "3 core केबल", "जमिनीखालील केबल", "கேபிள்", "కేబుల్", None]
    assert one(spark, texts, "string", text.detect_query_language(F.col("v"))) == ["en-IN", "hi-IN", "mr-IN", "ta-IN", "te-IN", "en-IN"]
    assert one(spark, ["a গ केबल", "plain"], "string", text.detect_script(F.col("v"))) == ["bn", "en"]


def test_amendments_first_mention_wins(spark):
    got = one(spark, ["Amendment No. 1 March 1995. Amendment 2; Amendment No. 1 2001"], "string", text.amendments(F.col("v")))
    assert [(r["number"], r["date"]) for r in got[0]] == [("1", "March 1995"), ("2", None)]

"""The SQL of these operators agrees with them, on the smallest tables and on odd ones."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quillmark.llm import audit, chat, decontaminate, oracles, registry, repair, sharding

SF = "/root/testdata/sf0.001"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in (r[i] for i in order)]) for r in rows)


def agree(got, con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(names, cursor.fetchall())


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    agree(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name])


def tables(texts, items=()):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(texts, columns=["doc_id", "text"]).astype({"doc_id": "Int64", "text": "string"}))
    con.register("benchmark", pd.DataFrame(list(items) or [(1, "x")], columns=["item_id", "text"]).astype({"item_id": "Int64", "text": "string"}))
    return con


def test_odd_documents_and_items(spark):
    items = [(1, "one two"), (2, "a b c d e f g h"), (3, "A b c d e f g i"), (3, "a b c d e"), (4, None), (5, " ")]
    texts = [(1, "x one TWO y"), (2, "a b c d e f g h"), (3, "z z a b c d e f g i z"), (4, "a b c"), (5, None), (6, ""), (6, "a b c d e a b c d e"), (None, "one two"), (7, "a b c d e f g")]
    got = decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    agree(got, tables(texts, items), oracles.OP9)


def test_shards_of_odd_rows(spark):
    texts = [(i * 5, f"text {i} é") for i in range(60)] + [(None, None), (None, "x"), (3, ""), (3, "y"), (3, "z")]
    agree(sharding.shard_documents(spark.createDataFrame(texts, "doc_id long, text string")), tables(texts), oracles.OP8)


def test_audit_of_odd_documents(spark):
    words = " ".join(f"w{i}" for i in range(210))
    texts = [(1, "s", words), (2, "s", words), (2, "t", words), (None, "t", words), (3, None, None), (4, "s", ""), (5, "s", "same " * 300), (6, "t", "LOUD $ " * 150), (7, "s", "é𝔘 " * 200), (8, "t", words + " \x0b#")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (6, None, 1), (None, 1, 1), (99, 1, 1)]
    kinds = "doc_id long, source string, text string"
    got = audit.filter_audit(spark.createDataFrame([(*t, 1) for t in texts], kinds + ", flags int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(texts, columns=["doc_id", "source", "text"]).astype({"doc_id": "Int64", "source": "string", "text": "string"}))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    agree(got.drop("filter"), con, oracles.OP11)
    assert audit.filter_audit(spark.createDataFrame([], kinds), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_odd_conversations(spark):
    texts = [None, "", " ", "Fine.", "cut", "</s>[INST] ok [/INST]", "a\n<|im_end|>!", "x?\t"]
    roles = ["user", "assistant", "system", "user", "assistant", None]
    rows = [(c, t, roles[(c * 5 + t * t) % 6], texts[(c * 7 + t * 3) % 8]) for c in range(40) for t in range(c % 9)] + [(None, None, "user", "Hi."), (None, 2, "assistant", "Yo"), (41, 3, "user", "x."), (41, 3, "user", "x.")]
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64", "role": "string", "text": "string"}))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    agree(chat.chat_report(df), con, oracles.OP12)
    agree(repair.repair_report(df), con, oracles.OP13)

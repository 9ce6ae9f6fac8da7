"""The same operators through SQL: registered functions and lateral joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sql
from ..session import spread
from .corpus import _SPEC
from .identifiers import _LABEL, _ROLE, _phrase, citing_texts
from .processing import _ASKED, _DETAIL, _case
from .registry import oracle_sql_of, query
from .retrieval import _char_rows
from .tables import table


@query("segment_items_sql", oracle_sql_of("segment_spec"))
def segment_items_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    specs = table(spark, sf_dir, "part").select("p_partkey", F.expr(_SPEC).alias("spec"))
    return spark.sql("SELECT p.p_partkey, s.position, s.item AS segment FROM {specs} p, LATERAL segment_items(p.spec) s", specs=specs)


@query(
    "page_cells_sql",
    """SELECT p_partkey, 1 AS row_no, 1 AS cell_no, 'Committee:' AS cell FROM part UNION ALL SELECT p_partkey, 1, 2, p_brand FROM part UNION ALL
    SELECT p_partkey, 2, 1, 'Pages' FROM part UNION ALL SELECT p_partkey, 2, 2, p_size::VARCHAR FROM part""",
)
def page_cells_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    pages = spread(table(spark, sf_dir, "part")).select("p_partkey", F.expr(_DETAIL).alias("html"))
    return spark.sql("SELECT p.p_partkey, c.row_no, c.cell_no, c.cell FROM {pages} p, LATERAL page_cells(p.html) c", pages=pages)


@query(
    "page_links_sql",
    """WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"', 1) AS hrefs FROM pages)
    SELECT page_id, generate_subscripts(hrefs, 1)::INT AS position, unnest(hrefs) AS href FROM a""",
)
def page_links_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    return spark.sql("SELECT p.page_id, l.position, l.href FROM {pages} p, LATERAL page_links(p.html) l", pages=table(spark, sf_dir, "pages"))


@query("text_grams_sql", f"SELECT doc_id, count(DISTINCT term) AS terms, sum(c)::BIGINT AS grams FROM {_char_rows('documents', 'doc_id')} GROUP BY doc_id")
def text_grams_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    spread(table(spark, sf_dir, "documents").select("doc_id", "text")).createOrReplaceTempView("quillmark_documents")
    return spark.sql("SELECT doc_id, count(*) AS terms, sum(tf) AS grams FROM text_grams(TABLE(SELECT doc_id, text FROM quillmark_documents)) GROUP BY doc_id")


@query("roles_sql", f"SELECT p_partkey, {_ROLE} AS role, {_LABEL} AS label FROM part")
def roles_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_phrase(0)).alias("title"), F.expr(_phrase(1)).alias("context"))
    return spark.sql("SELECT p_partkey, reference_role(title, context) AS role, role_label(reference_role(title, context)) AS label FROM {rows}", rows=rows)


@query("languages_sql", f"SELECT doc_id, {_case('doc_id', [a[1] for a in _ASKED])} || CASE WHEN doc_id % 4 IN (0, 3) THEN '' ELSE ' IS 1' END AS normalized, {_case('doc_id', [a[2] for a in _ASKED])} AS language FROM documents")
def languages_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    asked = table(spark, sf_dir, "documents").select("doc_id", F.expr(f"{_case('doc_id', [a[0] for a in _ASKED])} || CASE WHEN doc_id % 4 IN (0, 3) THEN '' ELSE ' IS 1' END").alias("q"))
    return spark.sql("SELECT doc_id, normalize_query(q) AS normalized, query_language(q) AS language FROM {asked}", asked=asked)


@query("references_sql", oracle_sql_of("extract_references"))
def references_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    return spark.sql("SELECT l_orderkey, p.pos + 1 AS place, p.col AS key FROM (SELECT l_orderkey, extract_references(body) AS keys FROM {bodies}), LATERAL posexplode(keys) p", bodies=citing_texts(spark, sf_dir))

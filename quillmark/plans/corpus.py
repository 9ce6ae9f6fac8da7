"""Corpus analytics, extraction, sources, quality metrics and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import records, text
from ..operators import analytics as A
from ..operators import evaluate as E
from ..operators import retrieve as R
from ..operators.textindex import among, bm25_best
from ..session import scratch
from ..sources import corpus as C
from ..sources import html as H
from ..streaming import changes, delta, windows
from . import indexes, retrieval
from .graph import _STATUS
from .registry import query
from .tables import benchmark_queries, documents, table

AS_OF = "2026-09-27"


# --- analytics ---------------------------------------------------------------

_CORPUS = f"""SELECT p_partkey, 'IS ' || p_partkey AS is_number, p_name AS title, p_type AS division, {_STATUS} AS status, CASE WHEN p_partkey % 3 > 0 THEN 'Covers ' || p_brand END AS scope,
CASE WHEN p_partkey % 4 > 0 THEN 1900 + p_partkey % 125 END AS year, p_partkey % 5 AS n_refs, p_partkey % 6 = 0 AS mandatory, (p_partkey % 100) / 100.0D AS extraction_quality,
p_size AS last_seen, CASE p_partkey % 3 WHEN 0 THEN '2020-01-01' WHEN 1 THEN '2030-01-01' END AS valid_upto FROM {{part}}"""
_CORPUS_SQL = _CORPUS.format(part="part").replace("100.0D", "100.0::DOUBLE")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_CORPUS, part=table(spark, sf_dir, "part"))
    refs = F.slice(F.array(*(F.lit(f"IS {i}") for i in range(5))), 1, F.col("n_refs").cast("int"))
    return rows.withColumns({"normative_references": refs, "certification": F.when(F.col("mandatory"), F.struct(F.lit("ISI").alias("scheme")))})


@query(
    "coverage",
    f"""SELECT division, count(*) AS total, count(*) FILTER (status = 'current') AS current_count, count(scope) AS with_scope, count(*) FILTER (n_refs > 0) AS with_refs, count(*) FILTER (mandatory) AS with_certification,
    round(avg(extraction_quality), 3) AS avg_quality, max(last_seen) AS last_synced FROM ({_CORPUS_SQL}) GROUP BY division""",
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.coverage(_corpus(spark, sf_dir))


@query("kpis", f"SELECT count(*) AS total, count(DISTINCT division) AS divisions, count(*) FILTER (mandatory) AS mandatory, count(*) FILTER (status IN ('superseded', 'withdrawn')) AS gone FROM ({_CORPUS_SQL})")
def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.kpis(_corpus(spark, sf_dir))


@query("division_share", "SELECT source, count(*) AS n, CAST(round(count(*) * 100 / (SELECT count(*) FROM documents)) AS INT) AS percent FROM documents GROUP BY source")
def division_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.share(table(spark, sf_dir, "documents"), "source")


@query("null_census", f"WITH c AS (SELECT title, scope, year, valid_upto, division FROM ({_CORPUS_SQL})) " + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) - count({f}) AS nulls FROM c" for f in ("title", "scope", "year", "valid_upto", "division")))
def null_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.null_census(_corpus(spark, sf_dir).select("title", "scope", "year", "valid_upto", "division"))


@query("prefix_breakdown", "SELECT regexp_extract(p_name, '^[a-z]+') AS prefix, count(*) AS n, CAST(round(count(*) * 100 / (SELECT count(*) FROM part)) AS INT) AS percent FROM part GROUP BY 1")
def prefix_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.share(table(spark, sf_dir, "part").select(F.regexp_extract("p_name", "^[a-z]+", 0).alias("prefix")), "prefix")


@query("decade_histogram", f"SELECT CAST(floor(year / 10) * 10 AS INT) AS decade, count(*) AS n FROM ({_CORPUS_SQL}) GROUP BY 1")
def decade_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(_corpus(spark, sf_dir), A.decade(F.col("year")), "decade")


@query("validity_split", f"SELECT CASE WHEN valid_upto IS NULL THEN 'missing' WHEN valid_upto < '{AS_OF}' THEN 'lapsed' ELSE 'future' END AS validity, count(*) AS n FROM ({_CORPUS_SQL}) GROUP BY 1")
def validity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(_corpus(spark, sf_dir), A.validity(F.col("valid_upto"), F.lit(AS_OF)), "validity")


@query("aspect_distribution", "SELECT p_type AS aspect, count(*) AS n FROM part GROUP BY 1")
def aspect_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(table(spark, sf_dir, "part"), F.col("p_type"), "aspect")


@query("multi_version", "SELECT 'IS ' || (p_partkey % 700) AS base, count(*) AS versions FROM part GROUP BY 1 HAVING count(*) > 1")
def multi_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.ident import standard_family

    raw = table(spark, sf_dir, "part").select(F.expr("'IS ' || (p_partkey % 700) || '-' || (p_partkey % 3 + 1) || ':2001'").alias("raw"))
    return A.multi_version(raw, standard_family(F.col("raw")))


_ODD = "CASE p_partkey % 50 WHEN 0 THEN p_name || ' &amp; more' WHEN 1 THEN p_name || '    ' || p_brand ELSE p_name END"
_ODD_YEAR = "CASE WHEN p_partkey % 60 = 0 THEN 19850 ELSE 1985 END"


@query(
    "anomalies",
    """SELECT 'year_typo' AS anomaly, count(*) FILTER (p_partkey % 60 = 0) AS n FROM part UNION ALL SELECT 'html_entity', count(*) FILTER (p_partkey % 50 = 0) FROM part UNION ALL
    SELECT 'wide_spaces', count(*) FILTER (p_partkey % 50 = 1) FROM part UNION ALL SELECT 'withdrawn_future', count(*) FILTER (p_partkey % 7 = 0 AND p_partkey % 3 = 1) FROM part""",
)
def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    upto = F.expr("CASE p_partkey % 3 WHEN 0 THEN '2020-01-01' WHEN 1 THEN '2030-01-01' END")
    return A.anomalies(rows, A.catalogue_tests(F.expr(_ODD), F.expr(_ODD_YEAR), F.col("p_partkey") % 7 == 0, upto, F.lit(AS_OF)))


@query(
    "catalogue_filter",
    f"SELECT is_number, title, year, division, status, coalesce(scope, '') AS scope, mandatory AS mandatory_qco FROM ({_CORPUS_SQL}) WHERE division = 'ECONOMY' AND (contains(lower(is_number), 'red') OR contains(lower(title), 'red') OR contains(lower(coalesce(scope, '')), 'red'))",
)
def catalogue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.catalogue_view(A.filter_catalogue(_corpus(spark, sf_dir), "ECONOMY", "  RED "))


@query("run_health", "SELECT event_id, user_id % 3 > 0 AND value > 2 AND event_id % 4 <> 0 AS healthy FROM events")
def run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = F.when(F.col("event_id") % 4 == 0, F.array(F.lit("timeout"))).when(F.col("event_id") % 4 == 1, F.array().cast("array<string>"))
    return table(spark, sf_dir, "events").select("event_id", A.run_health(F.col("user_id") % 3, F.when(F.col("value") > 2, 1).otherwise(0), errors).alias("healthy"))


@query(
    "department_postfilter",
    f"WITH {retrieval._WORD_ARM}, t AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ws WHERE score > 0 QUALIFY rank <= 5) SELECT query_id, t.doc_id, rank FROM t JOIN documents d ON d.doc_id = t.doc_id WHERE lang = 'en'",
)
def department_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter comes after the top k, so a query may keep fewer rows."""
    top = retrieval.word_arm(spark, sf_dir, 5)
    return top.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").filter("lang = 'en'").select("query_id", "doc_id", "rank")


@query(
    "enrichment",
    "SELECT o_orderkey, coalesce(CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE c_name END, o_orderpriority) AS title, coalesce(nullif(c_mktsegment, 'BUILDING'), 'candidate') AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
)
def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store value, or the candidate's where the store has none or an empty one."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    store = c.select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("stored"), F.regexp_replace("c_mktsegment", "^BUILDING$", "").alias("segment"))
    return o.join(store, "o_custkey", "left").select("o_orderkey", A.first_non_empty(F.col("stored"), F.col("o_orderpriority")).alias("title"), A.first_non_empty(F.col("segment"), F.lit("candidate")).alias("segment"))


# --- quality -----------------------------------------------------------------

_EXPECTED = "SELECT item_id AS query_id, doc_id FROM benchmark, documents WHERE contains(documents.text, benchmark.text)"


def _cases(spark: SparkSession, sf_dir: str, where: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each benchmark item expects the documents that hold its text; found are the documents ``where`` alone."""
    docs, asked = documents(spark, sf_dir), benchmark_queries(spark, sf_dir)
    held = E.holders(docs, asked)
    index = indexes.bm25(spark, sf_dir)
    ranked = R.top_k(bm25_best(among(index, where) if where else index, asked, 5), 5)
    return E.case_metrics(ranked, held)


_CASES = f"""{retrieval._BM25}, x AS ({_EXPECTED}), t AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bs WHERE score > 0 QUALIFY rank <= 5),
m AS (SELECT query_id, max(coalesce(rank <= 1, false)::INT) AS hit_1, max(coalesce(rank <= 3, false)::INT) AS hit_3, max(coalesce(rank <= 5, false)::INT) AS hit_5,
  count(*) FILTER (rank <= 3) / count(*) AS recall_3, count(*) FILTER (rank <= 5) / count(*) AS recall_5, coalesce(1 / min(rank), 0) AS rr FROM x LEFT JOIN t USING (query_id, doc_id) GROUP BY query_id)"""


@query("eval_metrics", f"WITH {_CASES} SELECT count(*) AS cases, " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in ("hit_1", "hit_3", "hit_5", "recall_3", "recall_5")) + ", round(avg(rr), 4) AS mrr FROM m")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.macro_metrics(_cases(spark, sf_dir))


_ODD_CASES = _CASES.replace("FROM bs WHERE score > 0", "FROM bs WHERE score > 0 AND doc_id % 2 = 0")


@query("eval_failures", f"WITH {_ODD_CASES} SELECT query_id FROM m WHERE hit_3 = 0")
def eval_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only documents of even number are retrieved, so passages that stand in others alone fail."""
    return E.failures(_cases(spark, sf_dir, lambda doc: doc % 2 == 0))


# --- extraction ----------------------------------------------------------------

_SPEC = "'Tender' || chr(10) || '1. ' || p_name || ' rated ' || (p_size * 11) || ' kV with copper and PVC parts and ' || p_brand || ' marks throughout' || chr(10) || ' 2) short' || chr(10) || 'Item 3 STEEL  frame,  ' || p_size || 'kW and 2.5 MVA, ' || p_size || ' V each, made from steel and cement for ' || p_type"


@query(
    "segment_spec",
    """SELECT p_partkey, 1 AS position, p_name || ' rated ' || (p_size * 11) || ' kV with copper and PVC parts and ' || p_brand || ' marks throughout' AS segment FROM part UNION ALL
    SELECT p_partkey, 2, 'STEEL frame, ' || p_size || 'kW and 2.5 MVA, ' || p_size || ' V each, made from steel and cement for ' || p_type FROM part""",
)
def segment_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(text.segment_items(F.expr(_SPEC))).alias("p", "segment")).select("p_partkey", (F.col("p") + 1).alias("position"), "segment")


@query(
    "tech_params",
    "SELECT p_partkey, array_to_string(list_sort(list_distinct([(p_size * 11) || ' kV', p_size || ' V'])), ',') AS voltages, array_to_string(list_sort([p_size || 'kW', '2.5 MVA']), ',') AS capacities, 'cement,copper,pvc,steel' AS materials FROM part",
)
def tech_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", text.technical_parameters(F.expr(_SPEC)).alias("t"))
    return rows.select("p_partkey", *(F.array_join(f"t.{c}", ",").alias(n) for c, n in (("voltage_ratings", "voltages"), ("capacities", "capacities"), ("materials", "materials"))))


@query("whitespace", "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS folded FROM documents")
def whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(text.collapse(F.col("text"))).alias("folded"))


@query("printable_text", "SELECT conv_id, turn, md5(trim(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x)), chr(10)), chr(10) || ' ' || chr(9))) AS cleaned FROM conversations")
def printable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control and format characters are added and must go again."""
    noisy = F.concat(F.lit("​"), F.replace(F.col("text"), F.lit(" "), F.lit(" \u0007")), F.lit("\x00 \n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.printable(noisy)).alias("cleaned"))


@query("adjacent_dedup", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' | ' || p_brand || ' | ' || p_name ELSE p_name || ' | ' || p_type END AS cells FROM part")
def adjacent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.expr("CASE WHEN p_partkey % 2 = 0 THEN array(p_name, ' ' || p_name, '', p_brand, p_name) ELSE array(p_name, p_name, p_name, p_type || ' ', p_type) END")
    return table(spark, sf_dir, "part").select("p_partkey", text.merge_repeated_cells(cells).alias("cells"))


_PAGE = """'IS ' || p_partkey || ' : 1990' || chr(10) || 'Steel ' || p_name || ' for use' || chr(10) || chr(10) || '12' || chr(10) || '1 SCOPE' || chr(10) || 'This standard covers ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' in all its published forms, and the methods by which each of them has to be tested before use' ELSE '' END
|| chr(10) || '2 REFERENCES' || chr(10) || 'IS ' || (p_partkey + 1) || ', IS ' || p_partkey || ' and SP 7:1982' || chr(10) || '3 TERMINOLOGY' || chr(10) || 'superseding IS ' || (p_partkey + 2) || ':1970. Amendment No. 1 March 1995; Amendment No. 2; Amendment No. 1 2001'"""


@query(
    "document_extract",
    """SELECT p_partkey, 'IS ' || p_partkey AS key, 'Steel ' || p_name || ' for use' AS title,
    CASE WHEN length('This standard covers ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' in all its published forms, and the methods by which each of them has to be tested before use' ELSE '' END) > 30
      THEN 'This standard covers ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' in all its published forms, and the methods by which each of them has to be tested before use' ELSE '' END END AS scope,
    'IS ' || (p_partkey + 1) || ',SP 7' AS refs, 'IS ' || (p_partkey + 2) AS supersedes, '1:March 1995,2:' AS amendments,
    round(0.3 + 0.25 + 0.15 + CASE WHEN p_partkey % 2 = 0 THEN 0.3 WHEN length('This standard covers ' || p_name) > 30 THEN 0.15 ELSE 0 END, 3)::DOUBLE AS quality FROM part""",
)
def document_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.ident import canonical_key

    page = text.clean_pages(F.expr(_PAGE))
    rows = table(spark, sf_dir, "part").select("p_partkey", page.alias("page")).withColumns({"key": canonical_key(F.col("page")), "title": text.header_title(F.col("page")), "scope": text.section_scope(F.col("page"))})
    rows = rows.withColumn("refs", text.section_references(F.col("page"), F.col("key")))
    marked = F.array_join(F.transform(text.amendments(F.col("page")), lambda a: F.concat(a["number"], F.lit(":"), F.coalesce(a["date"], F.lit("")))), ",")
    return rows.select("p_partkey", "key", "title", "scope", F.array_join("refs", ",").alias("refs"), text.superseded_key(F.col("page")).alias("supersedes"), marked.alias("amendments"), text.extraction_quality(F.col("key"), F.col("title"), F.col("scope"), F.col("refs")).alias("quality"))


_INDIC = ("केबल 3 core", "কেবল", "கேபிள்", "కేబుల్ IS 694", "ಕೇಬಲ್", "കേബിൾ", "કેબલ", "ਕੇਬਲ", "କେବୁଲ", "साठी केबल")
_SCRIPT = ("hi", "bn", "ta", "te", "kn", "ml", "gu", "pa", "or", "hi")
_QUERY_LANG = ("hi-IN", "en-IN", "ta-IN", "te-IN", "en-IN", "en-IN", "en-IN", "en-IN", "en-IN", "mr-IN")


def _pick(values: tuple[str, ...], other: str) -> str:
    return "CASE " + " ".join(f"WHEN doc_id % 20 = {i} THEN '{v}'" for i, v in enumerate(values)) + f" ELSE {other} END"


@query("script_detect", f"SELECT doc_id, {_pick(_SCRIPT, chr(39) + 'en' + chr(39))} AS script, {_pick(_QUERY_LANG, chr(39) + 'en-IN' + chr(39))} AS language FROM documents")
def script_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents get a phrase in an Indic script at their end."""
    phrase = F.expr(_pick(_INDIC, "''"))
    body = F.concat_ws(" ", "text", phrase)
    return documents(spark, sf_dir).select("doc_id", text.detect_script(body).alias("script"), text.detect_query_language(body).alias("language"))


# --- sources ------------------------------------------------------------------


@query(
    "html_listing",
    """SELECT 'IS ' || p_partkey AS is_number, p_name AS title, CAST(1950 + p_partkey % 70 AS INT) AS year, CASE WHEN p_partkey % 3 = 0 THEN 'withdrawn' ELSE 'current' END AS status, p_brand AS division,
    'http://portal.example/list/s/' || p_partkey AS source_url FROM part WHERE p_partkey % 10 <> 9""",
)
def html_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing page per brand; every tenth row has no designator and is left out."""
    row = """'<tr><td><a href="s/' || p_partkey || '">' || CASE WHEN p_partkey % 10 = 9 THEN 'draft' WHEN p_partkey % 2 = 0 THEN 'IS ' || p_partkey || ' : ' || (1950 + p_partkey % 70) ELSE 'IS ' || p_partkey END
      || '</a></td><td> ' || p_name || ' </td><td>year ' || (1950 + p_partkey % 70) || '</td><td>' || CASE WHEN p_partkey % 3 = 0 THEN 'Withdrawn' ELSE 'Active' END || '</td></tr>'"""
    pages = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("division")).agg(F.concat_ws("", F.collect_list(F.expr(row))).alias("rows"))
    pages = pages.select(F.lit("http://portal.example/list/").alias("url"), F.concat(F.lit("<table class='views-table'><tbody>"), "rows", F.lit("</tbody></table><br>")).alias("html"), "division")
    return H.listing_rows(pages).select("is_number", "title", "year", "status", "division", "source_url")


@query(
    "link_discovery",
    """WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>')) AS a, generate_subscripts(regexp_extract_all(html, '(?is)<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>'), 1) AS n FROM pages),
    l AS (SELECT page_id, n, regexp_extract(a, '(?is)href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_replace(a, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS label FROM a)
    SELECT page_id, href, label FROM l WHERE regexp_matches(href, '(?i)^/t') AND (contains(lower(label), 'the') OR contains(lower(href), 'the') OR contains(lower(label), 'ing') OR contains(lower(href), 'ing'))
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n) = 1""",
)
def link_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.discover_links(table(spark, sf_dir, "pages"), "page_id", "^/t", ("the", "ing"))


@query(
    "selector_probe",
    """WITH f AS (SELECT regexp_extract(url, 'https?://([^/]+)', 1) AS source, len(regexp_extract_all(html, '<h1[ >]')) AS h1, len(regexp_extract_all(html, '<title[ >]')) AS title, len(regexp_extract_all(html, '<main[ >]')) AS main, len(regexp_extract_all(html, '<p[ >]')) AS p FROM pages),
    r AS (SELECT source, 'title' AS field, CASE WHEN h1 > 0 THEN 'h1' WHEN title > 0 THEN 'title' END AS selector, CASE WHEN h1 > 0 THEN h1 ELSE title END AS n FROM f UNION ALL
      SELECT source, 'body', CASE WHEN main > 0 THEN 'main' WHEN p > 0 THEN 'p' END, CASE WHEN main > 0 THEN main ELSE p END FROM f)
    SELECT source, field, selector, count(*) AS pages, sum(n)::BIGINT AS nodes, bool_and(bool_and(selector IS NOT NULL)) OVER (PARTITION BY source, field) AS passed FROM r GROUP BY source, field, selector""",
)
def selector_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which selector wins on each source's pages, with its node count."""
    found = H.probe(table(spark, sf_dir, "pages"), {"title": ("h1", "title"), "body": ("main", "p")})
    return H.probe_report(found, F.regexp_extract("url", "https?://([^/]+)", 1))


@query(
    "selector_report",
    """WITH f AS (SELECT regexp_extract(url, 'https?://([^/]+)', 1) AS source, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<main>([^<]*)</main>', 1) AS main FROM pages)
    SELECT source, 'title' AS field, count(*) FILTER (h1 = '' AND title = '') AS misses, count(*) FILTER (h1 = '' AND title = '') = 0 AS resolved FROM f GROUP BY source UNION ALL
    SELECT source, 'main', count(*) FILTER (main = ''), count(*) FILTER (main = '') = 0 FROM f GROUP BY source""",
)
def selector_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("source", F.regexp_extract("url", "https?://([^/]+)", 1))
    pick = lambda tag: F.regexp_extract("html", f"<{tag}>([^<]*)</{tag}>", 1)
    return A.selector_misses(pages, {"title": A.first_non_empty(pick("h1"), pick("title")), "main": A.first_non_empty(pick("main"))})


@query(
    "compulsory_list",
    "WITH r AS (SELECT 'IS ' || (p_partkey % 300) AS is_number, p_partkey AS seq, p_name AS product FROM part UNION ALL SELECT 'SP ' || (p_partkey % 50), p_partkey, p_name FROM part) SELECT is_number, arg_max(product, seq) AS product FROM r GROUP BY is_number",
)
def compulsory_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("Product Category"), F.expr("'IS ' || (p_partkey % 300) || ':2010 and SP ' || (p_partkey % 50)").alias("Indian Standard"))
    return C.compulsory_list(rows)


@query(
    "notification_parse",
    """SELECT o_orderkey, 'IS ' || (o_orderkey % 500) AS refs, strftime(o_orderdate, '%d %B %Y') AS effective_date, CASE WHEN o_orderkey % 2 = 0 THEN 'CRS' ELSE 'BIS Product Certification (ISI)' END AS scheme
    FROM orders WHERE o_orderkey % 3 = 0""",
)
def notification_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'Quality Control Order' ELSE 'Notice' END").alias("title"), F.lit("u").alias("url"), "o_orderdate")
    body = F.concat(
        F.lit("Goods under IS "), (F.col("o_orderkey") % 500).cast("string"), F.lit(" shall come into force on the "), F.date_format("o_orderdate", "dd MMMM yyyy"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN ' by Compulsory Registration.' ELSE '.' END")
    )
    parsed = C.notifications(rows, ("quality control",)).select("o_orderkey", C.parse_notification(body).alias("n"))
    return parsed.select("o_orderkey", F.array_join("n.is_references", ",").alias("refs"), "n.effective_date", "n.scheme")


@query(
    "tender_fetch",
    """WITH t AS (SELECT 'GEM-' || s_suppkey || '-A' AS tender_id, s_name AS title FROM supplier), r AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'GEM-' || (c_custkey % 100) || '-A' WHEN 1 THEN 'gem-' || (c_custkey % 100) || '-' WHEN 2 THEN 'none ' || c_custkey ELSE 'x GEM-' || (c_custkey % 100) || '-A y' END AS request FROM customer),
    j AS (SELECT request, tender_id, title, CASE WHEN request = tender_id THEN 0 ELSE 1 END AS w FROM r LEFT JOIN t ON request = tender_id OR contains(lower(tender_id), lower(request)) OR contains(lower(request), lower(tender_id)) QUALIFY row_number() OVER (PARTITION BY request ORDER BY w, tender_id) = 1)
    SELECT request, coalesce(tender_id, request) AS tender_id, coalesce(title, 'Tender ' || request) AS title, CASE WHEN tender_id IS NULL THEN 'made' WHEN request = tender_id THEN 'equal' ELSE 'similar' END AS found FROM j""",
)
def tender_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenders = table(spark, sf_dir, "supplier").select(F.expr("'GEM-' || s_suppkey || '-A'").alias("tender_id"), F.col("s_name").alias("title"), F.col("s_name").alias("raw_specification"))
    asked = "CASE c_custkey % 4 WHEN 0 THEN 'GEM-' || (c_custkey % 100) || '-A' WHEN 1 THEN 'gem-' || (c_custkey % 100) || '-' WHEN 2 THEN 'none ' || c_custkey ELSE 'x GEM-' || (c_custkey % 100) || '-A y' END"
    return C.fetch_tenders(table(spark, sf_dir, "customer").select(F.expr(asked).alias("request")).distinct(), tenders).drop("raw_specification")


@query(
    "tender_normalize",
    "SELECT p_partkey, p_brand || ' supply of PVC, 11 kV as per IS ' || p_partkey || ' and ' || p_name AS normalized_query, 'IS ' || p_partkey AS cited, '11 kV' AS voltages, 'pvc' AS materials FROM part",
)
def tender_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    specification = F.expr("' supply  of PVC, 11 kV as per IS ' || p_partkey || chr(10) || ' and'")
    rows = table(spark, sf_dir, "part").select("p_partkey", C.normalize_tender(F.col("p_brand"), specification, F.array("p_name", F.lit(""))).alias("n"))
    return rows.select("p_partkey", "n.normalized_query", F.array_join("n.cited_standards", ",").alias("cited"), F.array_join("n.technical_parameters.voltage_ratings", ",").alias("voltages"), F.array_join("n.technical_parameters.materials", ",").alias("materials"))


@query("versioned_table", "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS before, c_name AS now FROM customer")
def versioned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions are written; readers see the second, and the first when they ask for it."""
    base = scratch(spark, "versions")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    C.write_versioned(rows.filter("c_custkey % 3 > 0"), base)
    C.write_versioned(rows, base)
    before, now = C.read_versioned(spark, base, back=1), C.read_versioned(spark, base)
    return now.withColumnRenamed("c_name", "now").join(before.withColumnRenamed("c_name", "before"), "c_custkey", "left").select("c_custkey", "before", "now")


@query("dataset_counters", "SELECT 0 AS back, count(*) AS total_count, count(*) FILTER (c_acctbal < 0) AS in_debt FROM customer UNION ALL SELECT 1, count(*), count(*) FILTER (c_acctbal < 0) FROM customer WHERE c_custkey % 3 > 0")
def dataset_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters that were written with two versions of a table."""
    base = scratch(spark, "versions")
    rows = table(spark, sf_dir, "customer")
    for part in (rows.filter("c_custkey % 3 > 0"), rows):
        C.write_versioned(part, base, {"in_debt": F.count_if(F.col("c_acctbal") < 0)})
    found = [C.read_counters(spark, base, back) for back in (0, 1)]
    return spark.createDataFrame([(back, c["total_count"], c["in_debt"]) for back, c in enumerate(found)], "back int, total_count long, in_debt long")


# --- streams --------------------------------------------------------------------


@query(
    "stream_delta_cdc",
    """WITH f AS (SELECT o_custkey AS is_number, o_orderkey // ((SELECT max(o_orderkey) FROM orders) // 3 + 1) AS file, arg_max(trim(o_orderpriority), o_orderkey) AS title FROM orders GROUP BY ALL),
    l AS (SELECT *, lag(title) OVER (PARTITION BY is_number ORDER BY file) AS earlier FROM f)
    SELECT is_number, arg_max(title, file) AS title, count(*) FILTER (earlier IS NULL) AS times_new, count(*) FILTER (earlier <> title) AS times_changed FROM l GROUP BY is_number""",
)
def stream_delta_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders land in three parts; each customer's newest priority is its title."""
    store, log = scratch(spark, "store"), scratch(spark, "log")
    write, checkpoint = delta.delta_writer(store, log, seq="seq"), scratch(spark, "checkpoint")
    rows = _landed_orders(spark, sf_dir, lambda landing, schema: delta.run_delta(spark, landing, schema, write, checkpoint, files_per_batch=None))
    ended = delta.current(spark, store, rows.drop("seq").withColumns({"content_hash": F.lit(""), "scope_hash": F.lit("")}).schema)
    logged = delta.logged(spark, log).groupBy("is_number").agg(F.count_if(F.col("change_type") == "new").alias("times_new"), F.count_if(F.col("change_type") != "new").alias("times_changed"))
    return ended.join(logged, "is_number", "left").select("is_number", "title", "times_new", "times_changed")


def _landed_orders(spark: SparkSession, sf_dir: str, ingest: Callable[[str, StructType], object]) -> DataFrame:
    """The orders, landed in three parts; ``ingest`` takes the folder and its schema after each, as one batch of as many files as it has."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey AS is_number", "trim(o_orderpriority) AS title", "o_orderkey AS seq")
    none = "array<string>"
    shape = {"year": F.lit(2000), "status": F.lit("current"), "division": F.lit("D"), "amendments": F.array().cast(none), "normative_references": F.array().cast(none), "certification": F.lit(None).cast("string"), "supersedes": F.lit(None).cast("string"), "scope": F.lit("s")}
    landing = scratch(spark, "landing")
    rows = rows.withColumns(shape)
    cut = rows.agg(F.max("seq")).first()[0] // 3 + 1
    for n in range(3):
        rows.filter(F.floor(F.col("seq") / cut) == n).write.mode("append").parquet(landing)
        ingest(landing, rows.schema)
    return rows


@query(
    "stream_state_cdc",
    """WITH f AS (SELECT o_custkey AS is_number, o_orderkey // ((SELECT max(o_orderkey) FROM orders) // 3 + 1) AS file, arg_max(trim(o_orderpriority), o_orderkey) AS title FROM orders GROUP BY ALL),
    l AS (SELECT *, lag(title) OVER (PARTITION BY is_number ORDER BY file) AS earlier FROM f)
    SELECT is_number, count(*) FILTER (earlier IS NULL) AS times_new, count(*) FILTER (earlier <> title) AS times_changed, count(*) FILTER (earlier = title) AS times_unchanged FROM l GROUP BY is_number""",
)
def stream_state_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same orders against the stream's own state: no stored table is read."""
    path, checkpoint, found = scratch(spark, "changes"), scratch(spark, "checkpoint"), []

    def ingest(landing: str, schema: StructType) -> None:
        found[:] = [changes.changes(spark.readStream.schema(schema).parquet(landing))]
        changes.run_changes(spark, found[0], checkpoint, path)

    _landed_orders(spark, sf_dir, ingest)
    kinds = {"times_new": F.col("change_type") == "new", "times_changed": ~F.col("change_type").isin("new", "unchanged"), "times_unchanged": F.col("change_type") == "unchanged"}
    return spark.read.schema(found[0].schema).parquet(path).groupBy("is_number").agg(*(F.count_if(c).alias(n) for n, c in kinds.items()))


@query("stream_distinct_events", "SELECT event_id, ts, event_type FROM events")
def stream_distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events land twice, in files that are read one by one; the repeats are known by the state."""
    landing = scratch(spark, "landing")
    for _ in range(2):
        windows.land_events(spark, f"{sf_dir}/events.parquet", landing, files=2)
    schema = spark.read.parquet(landing).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing).withColumn("ts", F.col("ts").cast("timestamp"))
    path, found = scratch(spark, "events"), changes.distinct_records(stream, "event_id", "ts", "3650 days")
    changes.run_changes(spark, found, scratch(spark, "checkpoint"), path)
    return spark.read.schema(found.schema).parquet(path).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type")


@query(
    "stream_replayed_batch",
    """WITH f AS (SELECT o_custkey AS is_number, o_orderkey // ((SELECT max(o_orderkey) FROM orders) // 3 + 1) AS file, arg_max(trim(o_orderpriority), o_orderkey) AS title FROM orders GROUP BY ALL),
    l AS (SELECT *, lag(title) OVER (PARTITION BY is_number ORDER BY file) AS earlier FROM f)
    SELECT is_number, arg_max(title, file) AS title, count(*) FILTER (earlier IS NULL OR earlier <> title) AS times_logged FROM l GROUP BY is_number""",
)
def stream_replayed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each landing is handled twice, as after a worker was lost between the write and its receipt: the table and the log are those of one run."""
    store, log = scratch(spark, "store"), scratch(spark, "log")
    write, checkpoint = delta.delta_writer(store, log, seq="seq"), scratch(spark, "checkpoint")

    def twice(batch: DataFrame, number: int) -> None:
        for _ in range(2):
            write(batch, number)

    rows = _landed_orders(spark, sf_dir, lambda landing, schema: delta.run_delta(spark, landing, schema, twice, checkpoint, files_per_batch=None))
    ended = delta.current(spark, store, rows.drop("seq").withColumns({"content_hash": F.lit(""), "scope_hash": F.lit("")}).schema)
    logged = delta.logged(spark, log).groupBy("is_number").agg(F.count("*").alias("times_logged"))
    return ended.join(logged, "is_number", "left").select("is_number", "title", "times_logged")


@query("stream_rate_limited", "SELECT 3 AS batches, 2 AS files_at_most, count(*) AS events FROM events")
def stream_rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five landed files, two of them a batch at most."""
    landing = windows.land_events(spark, f"{sf_dir}/events.parquet", scratch(spark, "landing"), files=5)
    path = scratch(spark, "seen")

    def note(batch: DataFrame, number: int) -> None:
        batch.select(F.input_file_name().alias("file")).groupBy("file").agg(F.count("*").alias("n")).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    delta.run_delta(spark, landing, spark.read.parquet(landing).schema, note, scratch(spark, "checkpoint"), files_per_batch=2)
    per_batch = spark.read.parquet(path).groupBy("batch").agg(F.count("*").alias("files"), F.sum("n").alias("n"))
    return per_batch.agg(F.count("*").cast("int").alias("batches"), F.max("files").cast("int").alias("files_at_most"), F.sum("n").alias("events"))


_WATERMARK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query(
    "stream_event_windows",
    f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= {_WATERMARK}",
)
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = windows.tumbling(windows.read_events(spark, windows.land_events(spark, f"{sf_dir}/events.parquet", scratch(spark, "landing"))))
    out = windows.collect_stream(stream, scratch(spark, "checkpoint"), scratch(spark, "windows"), spark)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_sessions",
    f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= {_WATERMARK}""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = windows.sessions(windows.read_events(spark, windows.land_events(spark, f"{sf_dir}/events.parquet", scratch(spark, "landing"))))
    out = windows.collect_stream(stream, scratch(spark, "checkpoint"), scratch(spark, "sessions"), spark)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})

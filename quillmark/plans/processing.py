"""Sources as landed files, the processing chain, recommendations and their texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.multilingual import normalize_query as normalized
from ..operators import cdc, render
from ..operators import graph as G
from ..operators import process as P
from ..operators import recommend as Rec
from ..session import scratch, spread
from ..sources import corpus as C
from ..sources import documents as D
from ..sources import html as H
from ..sources import service as S
from ..sources import sheets as Sh
from .corpus import _PAGE
from .graph import _BFS, _NODES, edges, roots
from .registry import query
from .tables import table

# --- queries in other languages -------------------------------------------------

#: Text, normalised text and language of one query in four.
_ASKED = (("  Steel rods ", "Steel rods", "en-IN"), ("भूमिगत केबल 1.1 kV", "underground cable 1.1 kV", "hi-IN"), ("साठी केबल 3 core XLPE", "cable 3 core XLPE", "mr-IN"), ("கேபிள்", "கேபிள்", "ta-IN"))


def _case(column: str, values) -> str:
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query("normalize_query", f"SELECT doc_id, {_case('doc_id', [a[1] for a in _ASKED])} AS normalized, {_case('doc_id', [a[2] for a in _ASKED])} AS language FROM documents")
def normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select("doc_id", normalized(F.expr(_case("doc_id", [a[0] for a in _ASKED]))).alias("q"))
    return asked.select("doc_id", "q.normalized", "q.language")


# --- landed sources -------------------------------------------------------------


@query("corpus_scan", "SELECT n_nationkey AS number, n_name AS title FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An enveloped object, a plain array and a file that is missing, each with its records."""
    schema = "number int, title string"
    parts = []
    for name, key, title, envelope in (("nation", "n_nationkey", "n_name", "standards"), ("region", "r_regionkey", "r_name", None)):
        rows = table(spark, sf_dir, name).agg(F.collect_list(F.struct(F.col(key).cast("int").alias("number"), F.col(title).alias("title"))).alias("standards"))
        path = scratch(spark, f"json-{name}")
        rows.select(F.to_json(F.struct("standards") if envelope else F.col("standards"))).write.text(path)
        parts.append(C.read_records(spark, path, spark.createDataFrame([], schema).schema, envelope))
    parts.append(C.read_records(spark, scratch(spark, "missing"), parts[0].schema, "standards"))
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


_DETAIL = """'<html><h1>IS ' || p_partkey || ' ' || p_name || '</h1><table class="standard-meta"><tr><td>Committee:</td><td> ' || p_brand || '<tr><td>Pages</td><td>' || p_size || '</table>
<div id="normative-references">IS ' || (p_partkey + 1) || ' and IS ' || (p_partkey + 2) || '</div><h2>1 Scope</h2><p>This covers   ' || p_type || '</p><h2>2 Terms</h2></html>'"""


@query(
    "detail_pages",
    "SELECT p_partkey, 'IS ' || p_partkey || ' ' || p_name AS title, p_brand AS committee, p_size::VARCHAR AS pages, 'IS ' || (p_partkey + 1) || ',IS ' || (p_partkey + 2) AS refs, 'This covers ' || p_type AS scope FROM part",
)
def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detail page for each part, with cells whose end tags are left out."""
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("url"), F.expr(_DETAIL).alias("html"))
    return H.detail_rows(pages).select(F.col("url").cast("long").alias("p_partkey"), "title", F.col("meta.meta_committee").alias("committee"), F.col("meta.meta_pages").alias("pages"), F.array_join("normative_references", ",").alias("refs"), "scope")


_BODY = """CASE WHEN p_partkey % 9 = 4 THEN 'not json' WHEN p_partkey % 9 = 5 THEN '{"status": "FAILED", "data": []}' ELSE
'{"status": "SUCCESS", "totalRecord": ' || (p_partkey % 4 * 10) || ', "data": [{"standardNumber": "IS ' || p_partkey || '", "standardId": ' || p_partkey || '}, {"standardNumber": "IS ' || (p_partkey + 1) || '"}]}' END"""


@query(
    "landed_pages",
    """SELECT p_brand AS department, 'IS ' || p_partkey AS number, p_partkey::VARCHAR AS id FROM part WHERE p_partkey % 9 NOT IN (4, 5) UNION ALL
    SELECT p_brand, 'IS ' || (p_partkey + 1), NULL FROM part WHERE p_partkey % 9 NOT IN (4, 5)""",
)
def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the responses that succeeded; failed and damaged ones have none."""
    responses = table(spark, sf_dir, "part").select(F.col("p_brand").alias("department"), F.expr(_BODY).alias("body"))
    return C.service_rows(responses, ("standardNumber", "standardId")).select("department", F.col("standardNumber").alias("number"), F.col("standardId").alias("id"))


@query(
    "pages_left",
    """SELECT p_partkey AS department, o AS "offset" FROM part, (VALUES (0), (10), (20)) AS v(o) WHERE p_partkey % 9 NOT IN (4, 5) AND o < p_partkey % 4 * 10 AND o > 0""",
)
def pages_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each department has landed."""
    responses = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("department"), F.lit(0).cast("long").alias("offset"), F.expr(_BODY).alias("body"))
    return C.pages_left(responses, 10)


@query(
    "failed_departments",
    "SELECT p_partkey AS department, CASE WHEN p_partkey % 9 = 4 THEN 'unreadable' ELSE 'FAILED' END AS reason FROM part WHERE p_partkey % 9 IN (4, 5)",
)
def failed_departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side output of a paged scan: what failed, with the reason."""
    responses = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("department"), F.lit(0).cast("long").alias("offset"), F.expr(_BODY).alias("body"))
    return C.failed_pages(responses).select("department", "reason")


#: Records of one page of the service; page 4 of 9 can't be read, page 5 failed.
_PAGE_SIZE = 10
_NUMBERED = f"""n AS (SELECT regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS department, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place FROM part),
g AS (SELECT department, place // {_PAGE_SIZE} * {_PAGE_SIZE} AS "offset", place // {_PAGE_SIZE} % 9 AS kind, (place % {_PAGE_SIZE})::INT AS position, 'IS ' || p_partkey AS number FROM n)"""


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(department, offset, body): the parts of each brand in pages of ``_PAGE_SIZE``."""
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    rows = table(spark, sf_dir, "part").select(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_").alias("department"), F.struct(place.alias("place"), F.concat(F.lit("IS "), "p_partkey").alias("number")).alias("r"))
    paged = rows.groupBy("department", (F.floor(F.col("r.place") / _PAGE_SIZE) * _PAGE_SIZE).alias("offset")).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    data = F.transform("rs", lambda r: F.struct(r["number"].alias("standardNumber")))
    kind = F.col("offset") / _PAGE_SIZE % 9
    body = F.when(kind == 4, "not json").when(kind == 5, '{"status": "FAILED", "data": []}').otherwise(F.to_json(F.struct(F.lit("SUCCESS").alias("status"), data.alias("data"))))
    return paged.select("department", F.col("offset").cast("long").alias("offset"), body.alias("body"))


@query(
    "service_scan",
    f"""WITH {_NUMBERED} SELECT department, "offset", position, number, NULL::VARCHAR AS error FROM g WHERE kind NOT IN (4, 5)
    UNION ALL SELECT DISTINCT department, "offset", NULL::INT, NULL, CASE WHEN kind = 4 THEN 'unreadable' ELSE 'FAILED' END FROM g WHERE kind IN (4, 5)""",
)
def service_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed pages of all departments, read by the data source."""
    folder = scratch(spark, "pages")
    S.land_pages(_responses(spark, sf_dir), folder)
    spark.dataSource.register(S.LandedPages)
    pages = spark.read.format("landed_pages").load(folder)
    return pages.select("department", "offset", "position", F.try_element_at("record", F.lit("standardNumber")).alias("number"), "error")


@query("service_stream", f"""WITH {_NUMBERED} SELECT department, "offset", position, number FROM g WHERE kind NOT IN (4, 5)""")
def service_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over a folder in which every second page lands after the first run; the second reads those alone."""
    folder, store, checkpoint = scratch(spark, "pages"), scratch(spark, "service"), scratch(spark, "service-checkpoint")
    responses = _responses(spark, sf_dir)
    for half in (0, 1):
        S.land_pages(responses.filter(F.col("offset") / _PAGE_SIZE % 2 == half), folder)
        S.ingest(spark, folder, store, checkpoint, ("standardNumber",))
    return spark.read.parquet(f"{store}/records/batch=*").select("department", "offset", "position", F.col("standardNumber").alias("number"))


_SCOPE_TEXT = "'This standard covers ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' in all its published forms, and the methods by which each of them has to be tested before use' ELSE '' END"


@query(
    "document_records",
    f"""WITH d AS (SELECT *, p_partkey % 5 AS kind, {_SCOPE_TEXT} AS covers FROM part)
    SELECT p_partkey, CASE kind WHEN 3 THEN 'Corrupted or invalid DOCX file' WHEN 4 THEN 'The uploaded file is empty' END AS error, CASE WHEN kind < 3 THEN 'IS ' || p_partkey END AS is_number, CASE WHEN kind < 3 THEN 'Steel ' || p_name || ' for use' END AS title,
    CASE WHEN kind < 3 AND length(covers) > 30 THEN covers END AS scope, CASE WHEN kind < 3 THEN 'IS ' || (p_partkey + 1) || ',SP 7' END AS refs, CASE WHEN kind < 3 THEN 'IS ' || (p_partkey + 2) END AS supersedes,
    CASE WHEN kind < 3 THEN round(0.3 + 0.25 + 0.15 + CASE WHEN p_partkey % 2 = 0 THEN 0.3 WHEN length(covers) > 30 THEN 0.15 ELSE 0 END, 3)::DOUBLE END AS quality FROM d""",
)
def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for every part: UTF-8, UTF-16 and DOCX texts, a damaged DOCX file and an empty one; scanned to records."""

    def written(batches):
        for batch in batches:
            rows = []
            for key, page in zip(batch.column("p_partkey").to_pylist(), batch.column("page").to_pylist(), strict=True):
                whole = D.write_docx(page.split("\n")) if key % 5 in (2, 3) else b""
                ending, content = (("txt", page.encode()), ("txt", page.encode("utf-16")), ("docx", whole), ("docx", whole[:-40]), ("txt", b""))[key % 5]
                rows.append((f"{key % 7}/{key}.{ending}", content))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["name", "content"])

    pages = spread(table(spark, sf_dir, "part")).select("p_partkey", F.expr(_PAGE).alias("page"))
    folder = scratch(spark, "files")
    D.land_files(pages.mapInArrow(written, "name string, content binary"), folder)
    found = D.scan_records(spark, folder)
    return found.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("p_partkey"), "error", "is_number", "title", "scope", F.array_join("normative_references", ",").alias("refs"), "supersedes", F.col("extraction_quality").alias("quality"))


# --- the processing chain -------------------------------------------------------

_CERTIFICATION = "struct<scheme:string,mandatory:boolean,gazette_url:string,gazette_title:string,effective_date:string>"
_RECORD = """'IS ' || p_partkey AS is_number, {title} AS title, CASE WHEN p_partkey % 5 > 0 THEN 1900 + p_partkey % 100 END AS year, 'current' AS status, p_brand AS division, {scope} AS scope,
array(struct('1' AS number, CAST(NULL AS STRING) AS date)) AS amendments, array('IS ' || (p_partkey + 1), 'IS ' || p_partkey, 'is  ' || (p_partkey + 1)) AS normative_references, {certification} AS certification, CAST(NULL AS STRING) AS supersedes, array('portal') AS sources"""


def _records(spark: SparkSession, sf_dir: str, where: str, title: str = "p_name", scope: str = "p_type", certification: str = "NULL") -> DataFrame:
    chosen = _RECORD.format(title=title, scope=scope, certification=f"CAST({certification} AS {_CERTIFICATION})")
    return spark.sql(f"SELECT {chosen} FROM {{part}} WHERE {where}", part=table(spark, sf_dir, "part"))


_NOTICE = "struct('CRS' AS scheme, true AS mandatory, 'http://g/' || p_partkey AS gazette_url, 'Order ' || p_partkey AS gazette_title, CAST(NULL AS STRING) AS effective_date)"


@query(
    "certification_patch",
    """SELECT 'IS ' || p_partkey AS is_number, CASE WHEN p_partkey % 10 = 0 THEN 'certification' ELSE 'new' END AS change_type, 'CRS' AS scheme, 'Order ' || p_partkey AS notice,
    CASE WHEN p_partkey % 10 = 0 THEN 'portal,gazette' ELSE 'gazette' END AS sources, CASE WHEN p_partkey % 10 = 0 THEN p_name END AS title FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 30 <> 0""",
)
def certification_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices name every fifth part; every tenth is stored, and every thirtieth has that certification already."""
    certification = f"CASE WHEN p_partkey % 30 = 0 THEN {_NOTICE} END"
    stored = cdc.with_hashes(_records(spark, sf_dir, "p_partkey % 10 = 0", certification=certification))
    notices = table(spark, sf_dir, "part").filter("p_partkey % 5 = 0").selectExpr("'http://g/' || p_partkey AS url", "'Order ' || p_partkey AS title", "'Compulsory Registration of goods under IS ' || p_partkey || ' only' AS body", "p_partkey AS seq")
    patched, changes = P.patch_certifications(stored, P.notice_certifications(notices), "gazette")
    return patched.join(changes, "is_number").select("is_number", "change_type", "certification.scheme", F.col("certification.gazette_title").alias("notice"), F.array_join("sources", ",").alias("sources"), "title")


@query(
    "process_chain",
    """SELECT 'IS ' || p_partkey AS is_number, CASE WHEN p_partkey % 4 = 1 THEN 'Revised ' || p_name ELSE p_name END AS title, CASE p_partkey % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'scope' WHEN 2 THEN 'unchanged' END AS change_type,
    CASE p_partkey % 4 WHEN 0 THEN 'passage: ' || p_name || '. ' || p_type WHEN 1 THEN 'passage: Revised ' || p_name || '. ' || p_type END AS vector_text,
    CASE WHEN p_partkey % 4 <= 1 THEN 'IS ' || (p_partkey + 1) END AS cites FROM part""",
)
def process_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four parts one is new, one has a new title, one comes unchanged and one doesn't come."""
    from ..functions.records import clean_and_validate

    stored = cdc.with_hashes(clean_and_validate(_records(spark, sf_dir, "p_partkey % 4 <> 0")))
    fresh = _records(spark, sf_dir, "p_partkey % 4 <> 3", title="CASE WHEN p_partkey % 4 = 1 THEN 'Revised ' || p_name ELSE p_name END")
    done = P.process_records(fresh, stored)
    out = done.stored.select("is_number", "title").join(done.changes.select("is_number", "change_type"), "is_number", "left")
    out = out.join(done.vectors.select("is_number", F.col("text").alias("vector_text")), "is_number", "left")
    cited = done.edges.groupBy(F.col("src").alias("is_number")).agg(F.array_join(F.sort_array(F.collect_list("dst")), ",").alias("cites"))
    return out.join(cited, "is_number", "left").select("is_number", "title", "change_type", "vector_text", "cites")


@query(
    "vector_upsert",
    """SELECT 'IS ' || p_partkey AS is_number, CASE WHEN p_partkey % 3 = 0 THEN 'passage: ' || p_name || '.' ELSE 'passage: ' || p_name || '. old' END AS text,
    CASE WHEN p_partkey % 5 > 0 THEN CAST(1900 + p_partkey % 100 AS INT) ELSE 0 END AS year, p_brand AS division, 'none' AS certification_scheme, round((embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))))::DOUBLE, 5) AS first
    FROM part LEFT JOIN embeddings ON vec_id = (p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 7 ELSE 0 END) % (SELECT count(*) FROM embeddings) WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0""",
)
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors of every second part; every third comes again without a scope.  The whole store is then scanned."""
    path = scratch(spark, "vectors")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("at"), "embedding")
    n = F.broadcast(vectors.agg(F.count("*").alias("n")))

    def embedded(records: DataFrame, shift: int) -> DataFrame:
        """Part k has the vector of number k, or k + 7 when it comes again."""
        at = (F.substring("is_number", 4, 20).cast("long") + shift) % F.col("n")
        return P.vector_rows(records.crossJoin(n).withColumn("at", at).join(vectors, "at", "left"), "embedding")

    stored = embedded(_records(spark, sf_dir, "p_partkey % 2 = 0", scope="'old'"), 0)
    fresh = embedded(_records(spark, sf_dir, "p_partkey % 3 = 0", scope="CAST(NULL AS STRING)"), 7)
    P.upsert_by_key(stored, fresh).write.parquet(path)
    return spark.read.parquet(path).select("is_number", "text", "metadata.year", "metadata.division", "metadata.certification_scheme", F.round(F.get("vector", F.lit(0)).cast("double"), 5).alias("first"))


@query(
    "sync_runs",
    """SELECT event_id, 'delta' AS mode, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE 'portal' END AS source, user_id AS pages_fetched, CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id END AS records_found, 0 AS records_changed,
    CASE WHEN event_id % 3 = 0 THEN '{}' ELSE '{"title":2}' END AS selector_misses, event_id % 4 = 1 AS healthy FROM events""",
)
def sync_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of each run, from counters that may be missing."""
    stats = table(spark, sf_dir, "events").selectExpr(
        "CASE WHEN event_id % 3 > 0 THEN 'portal' END AS source", "user_id AS pages_fetched", "CASE WHEN event_id % 2 > 0 THEN event_id END AS records_found", "CAST(NULL AS LONG) AS records_changed",
        "CASE WHEN event_id % 3 > 0 THEN map('title', 2) END AS selector_misses", "CASE WHEN event_id % 4 < 2 THEN event_id % 4 = 1 END AS healthy", "event_id",
    )
    return P.run_record(stats, "delta", keep=("event_id",)).drop("finished_at")


# --- evaluation, texts and recommendations --------------------------------------


@query(
    "allied_recall",
    f"""WITH {_BFS}, x AS (SELECT p_partkey AS root, (7 * p_partkey + 1) % (SELECT n FROM n) AS node FROM part UNION SELECT p_partkey, (p_partkey + 2) % (SELECT n FROM n) FROM part),
    r AS (SELECT x.root, count(c.node) / count(*) AS recall FROM x LEFT JOIN c ON c.root = x.root AND c.node = x.node GROUP BY x.root) SELECT count(*) AS cases, round(avg(recall), 4) AS allied_recall FROM r""",
)
def allied_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part expects its first citation and another part among its closure."""
    parts = table(spark, sf_dir, "part")
    n = F.broadcast(parts.agg(F.count("*").alias("n")))
    expected = parts.crossJoin(n).select(F.col("p_partkey").alias("query_id"), F.explode(F.array((F.col("p_partkey") * 7 + 1) % F.col("n"), (F.col("p_partkey") + 2) % F.col("n"))).alias("is_number"))
    surfaced = G.bfs_closure(edges(spark, sf_dir), roots(spark, sf_dir)).select(F.col("root").alias("query_id"), F.col("node").alias("is_number"))
    return P.allied_recall(surfaced, expected)


@query("neighbourhood_shown", f"WITH {_NODES} SELECT DISTINCT root, src, dst FROM (SELECT * FROM n0 UNION ALL SELECT * FROM n1) JOIN e ON src = node QUALIFY row_number() OVER (PARTITION BY root ORDER BY src, dst) <= 5")
def neighbourhood_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five edges of each neighbourhood are shown."""
    own = G.neighbourhood(edges(spark, sf_dir), roots(spark, sf_dir))[1].select("root", "src", "dst")
    return P.shown_edges(own, limit=5).distinct()


@query("json_export", """SELECT p_partkey, '{"is_number":"IS ' || p_partkey || '","title":"' || p_name || '","size":' || p_size || '}' AS record FROM part""")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("IS "), "p_partkey").alias("is_number"), F.col("p_name").alias("title"), F.col("p_size").alias("size"))
    return rows.select("p_partkey", render.json_record(rows, ("is_number", "title", "size")).alias("record"))


@query(
    "reasoning_context",
    """SELECT p_size AS query_id, string_agg('[IS ' || p_partkey || '] ' || p_name || chr(10) || 'Status: current | Year: ' || CASE WHEN p_partkey % 5 > 0 THEN (1900 + p_partkey % 100)::VARCHAR ELSE 'unknown' END || chr(10) || 'Scope: ' || substring(repeat(p_type || ' ', 90), 1, 1200), chr(10) || chr(10) ORDER BY p_partkey) AS context
    FROM part GROUP BY p_size""",
)
def reasoning_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_size AS query_id", "p_partkey AS position", "'IS ' || p_partkey AS is_number", "p_name AS title", "CAST(NULL AS STRING) AS status", "CASE WHEN p_partkey % 5 > 0 THEN 1900 + p_partkey % 100 END AS year", "repeat(p_type || ' ', 90) AS scope")
    return P.context(rows)


@query(
    "justified_answers",
    """SELECT p_size AS query_id, 'IS ' || p_partkey AS is_number, CASE WHEN p_size % 2 = 0 THEN 'because ' || p_partkey ELSE 'matched ' || p_name END AS justification FROM part WHERE p_size % 2 = 1 OR p_partkey % 3 = 0
    OR NOT EXISTS (SELECT 1 FROM part o WHERE o.p_size = part.p_size AND o.p_partkey % 3 = 0)""".replace("CASE WHEN p_size % 2 = 0 THEN", "CASE WHEN p_size % 2 = 0 AND p_partkey % 3 = 0 THEN"),
)
def justified_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of even number are answered for every third part; claims about other queries' parts are dropped, and what has no answer gets the template."""
    rows = table(spark, sf_dir, "part").selectExpr("p_size AS query_id", "'IS ' || p_partkey AS is_number", "p_name", "p_partkey")
    raw = rows.filter("query_id % 2 = 0 AND p_partkey % 3 = 0").groupBy("query_id").agg(F.collect_list(F.expr("""'{"is_number": "' || is_number || '", "justification": "because ' || p_partkey || '"}'""")).alias("items"))
    answer = F.concat(F.lit('```json\n{"justifications": [{"is_number": "IS 0000", "justification": "made up"}, '), F.array_join("items", ", "), F.lit("]}\n```"))
    claims = raw.select("query_id", F.inline(render.parse_answer(answer)))
    return P.justified(rows, render.grounded(claims, rows), F.concat(F.lit("matched "), "p_name")).select("query_id", "is_number", "justification")


_GRAMS = """(SELECT {key}, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS g FROM part {where})"""


@query(
    "fuzzy_titles",
    f"""WITH q AS {_GRAMS.format(key="p_partkey AS query_id", where="WHERE p_partkey % 50 = 0")}, t AS {_GRAMS.format(key="p_partkey AS is_number", where="")},
    s AS (SELECT query_id, is_number, round(len(list_intersect(q.g, t.g)) / (len(q.g) + len(t.g) - len(list_intersect(q.g, t.g))), 6) AS similarity FROM q, t) SELECT * FROM s WHERE similarity >= 0.3""",
)
def fuzzy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return P.fuzzy_titles(parts.filter("p_partkey % 50 = 0").selectExpr("p_partkey AS query_id", "p_name AS text"), parts.selectExpr("p_partkey AS is_number", "p_name AS title"))


@query(
    "recommend",
    """SELECT p_partkey AS query_id, CASE WHEN p_partkey % 6 = 5 THEN 'no_results' ELSE 'ok' END AS state, CASE WHEN p_partkey % 6 < 5 THEN 'IS ' || p_partkey END AS is_number, CASE WHEN p_partkey % 6 < 5 THEN p_name END AS title,
    CASE WHEN p_partkey % 6 < 5 THEN 'IS ' || p_partkey || CASE WHEN p_partkey % 5 > 0 THEN ':' || (1900 + p_partkey % 100) ELSE '' END || ' (Amendment 2)' END AS latest_version,
    CASE WHEN p_partkey % 6 < 5 AND p_partkey % 2 = 0 THEN true END AS mandatory, CASE WHEN p_partkey % 6 < 5 THEN substring(repeat(p_type || ' ', 40), 1, 400) END AS scope_excerpt,
    CASE WHEN p_partkey % 6 < 5 AND p_partkey + 1 <= (SELECT max(p_partkey) FROM part) THEN 'IS ' || (p_partkey + 1) END AS allied FROM part""",
)
def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assembly of what is shown for ranked rows: one result for each part, none for every sixth."""
    parts = table(spark, sf_dir, "part")
    shown = "p_partkey % 6 < 5"
    queries = parts.selectExpr("p_partkey AS query_id", "p_name AS text")
    gated = parts.selectExpr("p_partkey AS query_id", f"CASE WHEN {shown} THEN 'ok' ELSE 'no_results' END AS state", f"CASE WHEN {shown} THEN 'IS ' || p_partkey END AS doc_id", f"CASE WHEN {shown} THEN 1 END AS position", "0.5D AS confidence", "'Medium' AS band")
    last = parts.agg(F.max("p_partkey").alias("last"))
    kind = "struct<scheme:string,scheme_label:string,mandatory:boolean,product:string>"
    standards = parts.crossJoin(F.broadcast(last)).selectExpr(
        "'IS ' || p_partkey AS is_number", "p_name AS title", "CASE WHEN p_partkey % 5 > 0 THEN 1900 + p_partkey % 100 END AS year", "'current' AS status", "repeat(p_type || ' ', 40) AS scope",
        "array(struct('1' AS number, 'May 2001' AS date), struct('2' AS number, CAST(NULL AS STRING) AS date)) AS amendments",
        f"CASE WHEN p_partkey % 2 = 0 THEN CAST(struct('ISI' AS scheme, CAST(NULL AS STRING) AS scheme_label, CAST(NULL AS BOOLEAN) AS mandatory, CAST(NULL AS STRING) AS product) AS {kind}) END AS certification",
        "CASE WHEN p_partkey < last THEN array('IS ' || (p_partkey + 1)) ELSE array() END AS normative_references",
    )
    rows = Rec.recommend(gated, queries, standards, G.build_edges(standards), depth=1)
    return rows.select("query_id", "state", "is_number", "title", "latest_version", "certification.mandatory", "scope_excerpt", F.array_join(F.flatten(F.map_values("allied")), ",").alias("allied"))

"""Validation of citations, and the texts rendered from records.

One document per order cites the keys of its lines; one standard per part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import render, validate
from ..session import kept
from .graph import _EDGES, _STATUS, edges
from .identifiers import _LINE, _LINE_KEY
from .registry import query
from .tables import table

AS_OF = "2026-09-27"
_NUMBER = "CASE WHEN p_partkey % 2 = 0 THEN 'IS ' ELSE 'SP ' END || p_partkey"
_STANDARDS = f"""SELECT {_NUMBER} AS is_number, {_STATUS} AS status, CASE WHEN p_partkey % 14 = 0 THEN 'IS ' || (p_partkey + 1) ELSE '' END AS superseded_by,
CASE WHEN p_partkey % 3 = 0 THEN '2024-05-01' WHEN p_partkey % 3 = 1 THEN '2030-05-01' END AS valid_upto, p_partkey % 5 = 0 AS mandatory, CASE WHEN p_partkey % 5 = 0 THEN 'ISI' END AS scheme,
CASE WHEN p_partkey % 10 = 0 THEN 'ISI mark' END AS scheme_label FROM part"""
_CITED = f"""k AS (SELECT l_orderkey AS doc_id, {_LINE_KEY} AS is_number, min(struct_pack(a := l_linenumber, b := l_partkey)) AS pos FROM lineitem GROUP BY ALL),
c AS (SELECT doc_id, is_number, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS place FROM k), s AS ({_STANDARDS}), r AS (SELECT c.*, s.* EXCLUDE (is_number), s.is_number IS NOT NULL AS found FROM c LEFT JOIN s USING (is_number))"""
_RULES = {
    "production": f"""SELECT doc_id, place, 0 AS rule, is_number, 3 AS w, 'info' AS severity, 'Not found in the current corpus' AS issue, 'Verify this designation on the BIS portal.' AS action FROM r WHERE NOT found UNION ALL
      SELECT doc_id, place, 1, is_number, 1, 'high', 'This standard is ' || status, CASE WHEN superseded_by <> '' THEN 'Replace with ' || superseded_by ELSE 'Check the BIS portal for the current successor.' END FROM r WHERE status IN ('withdrawn', 'superseded') UNION ALL
      SELECT doc_id, place, 2, is_number, 2, 'medium', 'This standard is under revision', 'Confirm the applicable edition before publishing the tender.' FROM r WHERE status = 'under_revision' UNION ALL
      SELECT doc_id, place, 3, is_number, 2, 'medium', scheme || ' certification is mandatory', 'State the certification requirement explicitly in the tender.' FROM r WHERE mandatory""",
    "hybrid": f"""SELECT doc_id, place, 0 AS rule, is_number, 4 AS w, 'info' AS severity, 'Not found in unified corpus' AS issue, 'Verify on the BIS portal.' AS action FROM r WHERE NOT found UNION ALL
      SELECT doc_id, place, 1, is_number, 1, 'high', 'Standard is ' || status || ' in official BIS catalogue', CASE WHEN superseded_by <> '' THEN 'Replace with ' || superseded_by ELSE 'Consult latest BIS catalogue for active successor.' END FROM r WHERE status IN ('withdrawn', 'superseded') UNION ALL
      SELECT doc_id, place, 2, is_number, 3, 'low', 'Standard review window lapsed on ' || valid_upto, 'Confirm whether BIS has issued reaffirmation or revision.' FROM r WHERE valid_upto < '{AS_OF}' UNION ALL
      SELECT doc_id, place, 3, is_number, 2, 'medium', scheme || ' certification is mandatory under applicable QCO', 'Require BIS ' || coalesce(scheme_label, 'certification') || ' in tender submission criteria.' FROM r WHERE mandatory""",
}


def _issues_sql(profile: str) -> str:
    return f"WITH {_CITED}, i AS ({_RULES[profile]}) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY w, place, rule) AS position, is_number, severity, issue, action FROM i"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.expr(_LINE).alias("t")))).alias("lines"))
    return lines.select(F.col("l_orderkey").alias("doc_id"), F.array_join(F.transform("lines", lambda x: x["t"]), "; ").alias("text"))


def _standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_STANDARDS.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citations of all documents, extracted once for all that reads them."""
    return kept(validate.citations(_documents(spark, sf_dir)), "citations")


def _issues(spark: SparkSession, sf_dir: str, profile: str, cited: DataFrame | None = None) -> DataFrame:
    cited = validate.citations(_documents(spark, sf_dir)) if cited is None else cited
    return validate.issues(cited, _standards(spark, sf_dir), profile, F.lit(AS_OF))


@query("validate_issues_hybrid", _issues_sql("hybrid"))
def validate_issues_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir, "hybrid")


@query("validate_issues_production", _issues_sql("production"))
def validate_issues_production(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir, "production")


_SUGGESTED = f"""{_CITED}, {_EDGES},
g AS (SELECT CASE WHEN src % 2 = 0 THEN 'IS ' ELSE 'SP ' END || src AS src, pos, CASE WHEN dst % 2 = 0 THEN 'IS ' ELSE 'SP ' END || dst AS dst, role FROM e),
f AS (SELECT doc_id, place, pos, c.is_number AS referenced_by, dst AS is_number, role FROM c JOIN g ON g.src = c.is_number
  WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.doc_id = c.doc_id AND o.is_number = dst) QUALIFY row_number() OVER (PARTITION BY doc_id, dst ORDER BY place, pos) = 1),
u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place, pos) AS position, is_number, role, referenced_by FROM f QUALIFY position <= 10)"""
_ROLE_LABEL = "CASE role WHEN 'test_method' THEN 'Test method' WHEN 'related_product' THEN 'Related product' ELSE upper(role[1]) || role[2:] END"


def _suggested(spark: SparkSession, sf_dir: str, cited: DataFrame) -> DataFrame:
    def named(c: str) -> F.Column:
        return F.concat(F.when(F.col(c) % 2 == 0, "IS ").otherwise("SP "), F.col(c).cast("string")).alias(c)

    links = edges(spark, sf_dir).select(named("src"), "pos", named("dst"), "role")
    return validate.suggestions(cited, _standards(spark, sf_dir), links, validate.SUGGESTIONS["hybrid"])


@query("suggested_additions", f"WITH {_SUGGESTED} SELECT doc_id, position, is_number, {_ROLE_LABEL} AS role, referenced_by FROM u")
def suggested_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suggested(spark, sf_dir, _cited(spark, sf_dir))


@query(
    "validate_summary",
    f"""WITH {_SUGGESTED}, i AS ({_RULES["hybrid"]}), t AS (SELECT doc_id, count(*) AS total_cited FROM c GROUP BY ALL), h AS (SELECT doc_id, count(*) FILTER (w = 1) AS high, count(*) FILTER (w = 2) AS medium FROM i GROUP BY ALL),
    m AS (SELECT doc_id, count(*) AS suggestions FROM u GROUP BY ALL)
    SELECT doc_id, total_cited, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(suggestions, 0) AS suggestions FROM t LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)""",
)
def validate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = _cited(spark, sf_dir)
    return validate.summary(cited, _issues(spark, sf_dir, "hybrid", cited), _suggested(spark, sf_dir, cited))


@query("clean_standards", f"WITH {_CITED}, i AS ({_RULES['hybrid']}) SELECT doc_id, is_number FROM c WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.doc_id = c.doc_id AND i.is_number = c.is_number AND w <= 2)")
def clean_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = _cited(spark, sf_dir)
    return validate.clean_standards(cited, _issues(spark, sf_dir, "hybrid", cited))


@query(
    "pipeline_health",
    """WITH runs AS (SELECT event_id AS run_id, event_type AS mode, 'u' || user_id AS source, ts AS started_at, value >= 5 AS healthy, CASE WHEN event_id % 3 = 0 THEN 'columns,results_row' WHEN event_id % 3 = 1 THEN NULL ELSE 'title' END AS misses FROM events),
    r AS (SELECT * FROM runs ORDER BY started_at DESC, run_id LIMIT 10)
    SELECT 'stale' AS kind, NULL AS source, CAST(CAST(round(epoch(max(ts) + INTERVAL 40 HOUR - max(ts)) / 3600) AS BIGINT) AS VARCHAR) AS detail FROM events UNION ALL
    SELECT 'unhealthy', source, mode FROM r WHERE NOT healthy UNION ALL SELECT 'misses', source, misses FROM r WHERE misses IS NOT NULL""",
)
def pipeline_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    missed = "CASE WHEN event_id % 3 = 0 THEN map('results_row', 1, 'columns', 2) WHEN event_id % 3 = 2 THEN map('title', 1) END"
    runs = events.select(F.col("event_id").alias("run_id"), F.col("event_type").alias("mode"), F.expr("'u' || user_id").alias("source"), F.col("ts").alias("started_at"), F.expr("value >= 5").alias("healthy"), F.expr(missed).alias("selector_misses"))
    newest = events.select(F.col("ts").alias("last_seen"))
    now = newest.agg(F.max("last_seen")).scalar()
    return validate.pipeline_health(runs, newest, now + F.expr("INTERVAL 40 HOURS"))


# --- rendering ------------------------------------------------------------

_AMENDED = "CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' ({w} 2, March 2001)' ELSE ' ({w} 1{x})' END"


def _amendments() -> F.Column:
    pair = lambda n, d: F.struct(F.lit(n).alias("number"), (F.lit(d) if d else F.lit(None).cast("string")).alias("date"))
    empty = F.array().cast("array<struct<number:string,date:string>>")
    return F.when(F.col("p_partkey") % 3 == 0, empty).when(F.col("p_partkey") % 3 == 1, F.array(pair("1", None), pair("2", "March 2001"))).otherwise(F.array(pair("1", None)))


_YEAR = "CASE WHEN p_partkey % 4 <> 0 THEN 1950 + p_partkey % 70 END"
_VERSION = f"('IS ' || p_partkey || coalesce(':' || ({_YEAR}), '') || {_AMENDED.format(w='Amendment', x='')})"


@query(
    "version_string",
    f"""SELECT p_partkey, {_VERSION} AS production, 'IS ' || p_partkey || coalesce(':' || ({_YEAR}), '') || {_AMENDED.format(w="Amdt", x="")} AS hybrid,
    'IS ' || p_partkey || ':' || coalesce(CAST({_YEAR} AS VARCHAR), '') || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' (Amdt 2)' ELSE ' (Amdt 1)' END AS offline FROM part""",
)
def version_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.expr("'IS ' || p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", *(render.version_string(key, F.expr(_YEAR), _amendments(), s).alias(s) for s in ("production", "hybrid", "offline")))


_SHARED = "list_filter(list_sort(list_distinct(regexp_extract_all(lower(p_name || ' for ' || p_type || ' use'), '[a-z]{4,}'))), lambda t: contains(lower(p_name || ' Covers ' || p_brand), t))[1:4]"


@query(
    "justify",
    f"""SELECT p_partkey, array_to_string({_SHARED}, ',') AS terms,
    CASE WHEN len({_SHARED}) > 0 THEN 'The scope of this standard covers ' || array_to_string({_SHARED}, ', ') || ' as described in the specification.' ELSE '{render.NO_OVERLAP["production"]}' END AS production,
    CASE WHEN p_partkey % 3 = 0 THEN 'National catalogue match from BIS ' || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'BIS' END || ' (' || p_type || '). Verified active standard in published Indian Standards catalogue.'
      WHEN len({_SHARED}) > 0 THEN 'Scope covers ' || array_to_string({_SHARED}, ', ') || ' as described in the specification.' ELSE '{render.NO_OVERLAP["hybrid"]}' END AS hybrid FROM part""",
)
def justify(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, scope = F.expr("p_name || ' for ' || p_type || ' use'"), F.expr("'Covers ' || p_brand")
    tier = F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'catalogue' ELSE 'enriched' END")
    department = F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.array_join(render.shared_terms(asked, F.col("p_name"), scope), ",").alias("terms"),
        render.justify(asked, F.col("p_name"), scope).alias("production"),
        render.justify(asked, F.col("p_name"), scope, tier, department, F.col("p_type")).alias("hybrid"),
    )


def _quoted(text: str, **values: str) -> str:
    out = "'" + text.replace("'", "''") + "'"
    for k, v in values.items():
        out = out.replace("{" + k + "}", f"' || {v} || '")
    return f"({out})"


def _members(n: int) -> str:
    return f"array_to_string(list_transform(range(0, least(p_partkey % 6, {n})), lambda i: 'IS ' || (p_partkey + i)), ', ')"


def _clause_sql() -> str:
    scheme = f"""CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN {_quoted(render.SCHEMES["CRS"], product="p_name", number="'IS ' || p_partkey")}
      WHEN 2 THEN {_quoted(render.SCHEMES["HALLMARKING"], product="'this item'")} WHEN 3 THEN {_quoted(render.SCHEMES["ISI"], label="'ISI mark'")} ELSE {_quoted(render.SCHEMES["ISI"], label="'" + render.DEFAULT_LABEL + "'")} END"""
    parts = [_quoted(render.CONFORMITY, latest=_VERSION, title="p_name"), scheme]
    for i, (_, most, template) in enumerate(render.ROLE_CLAUSES):
        parts.append(f"CASE WHEN p_partkey % 6 > 0 AND p_partkey % {i + 2} = 0 THEN {_quoted(template, list=_members(most))} END")
    listed = f"list_filter([{', '.join(parts)}], lambda c: c IS NOT NULL)"
    return f"SELECT p_partkey, array_to_string(list_transform({listed}, lambda c, i: i || '. ' || c), chr(10) || chr(10)) AS clause FROM part"


def _clause_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    certification = """CASE p_partkey % 5 WHEN 1 THEN named_struct('scheme', 'crs', 'scheme_label', '', 'mandatory', false, 'product', p_name)
      WHEN 2 THEN named_struct('scheme', 'Hallmarking', 'scheme_label', '', 'mandatory', true, 'product', '')
      WHEN 3 THEN named_struct('scheme', 'ISI', 'scheme_label', 'ISI mark', 'mandatory', true, 'product', p_name)
      WHEN 4 THEN named_struct('scheme', '', 'scheme_label', '', 'mandatory', true, 'product', p_name) END"""
    members = "CASE WHEN p_partkey % 6 > 0 THEN transform(sequence(0, CAST(p_partkey % 6 AS INT) - 1), i -> 'IS ' || (p_partkey + i)) ELSE CAST(array() AS array<string>) END"
    listed = ", ".join(f"'{role}', CASE WHEN p_partkey % {i + 2} = 0 THEN {members} ELSE CAST(array() AS array<string>) END" for i, (role, _, _) in enumerate(render.ROLE_CLAUSES))
    latest = render.version_string(F.expr("'IS ' || p_partkey"), F.expr(_YEAR), _amendments())
    return table(spark, sf_dir, "part"), {"number": F.expr("'IS ' || p_partkey"), "latest": latest, "title": F.col("p_name"), "certification": F.expr(certification), "allied": F.expr(f"map({listed})")}


@query("tender_clause", _clause_sql())
def tender_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, inputs = _clause_inputs(spark, sf_dir)
    return rows.select("p_partkey", render.tender_clause(**inputs).alias("clause"))


@query(
    "short_clause",
    f"""SELECT p_partkey, concat_ws(chr(10) || chr(10), '1. ' || {_quoted(render.CONFORMITY, latest=_VERSION, title="p_name")},
    CASE WHEN p_partkey % 5 > 0 THEN '2. Mandatory Certification: The product must bear the valid ' || CASE p_partkey % 5 WHEN 1 THEN 'crs' WHEN 2 THEN 'Hallmarking' WHEN 3 THEN 'ISI mark' ELSE 'ISI' END
      || ' mark as mandated by the appropriate Quality Control Order (QCO) published in the Gazette of India. Uncertified bids shall be summarily rejected.' END,
    CASE WHEN p_partkey % 6 > 0 AND p_partkey % 2 = 0 THEN '3. Acceptance & Routine Tests: Acceptance testing at vendor works shall strictly follow testing procedures prescribed in ' || {_members(4)} || '.' END,
    CASE WHEN p_partkey % 6 > 0 AND p_partkey % 5 = 0 THEN '4. Normative Raw Materials: Raw materials and components shall satisfy ' || {_members(3)} || '.' END) AS clause FROM part""",
)
def short_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, inputs = _clause_inputs(spark, sf_dir)
    return rows.select("p_partkey", render.short_clause(**inputs).alias("clause"))


@query(
    "grounding_filter",
    """SELECT o_custkey AS query_id, 'IS ' || (o_orderkey % 40) AS is_number, 'text ' || o_orderkey AS justification FROM orders
    WHERE EXISTS (SELECT 1 FROM lineitem JOIN orders p ON p.o_orderkey = l_orderkey WHERE p.o_custkey = orders.o_custkey AND l_partkey % 40 = orders.o_orderkey % 40)""",
)
def grounding_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model as fenced JSON; claims about what the query, a customer, has not retrieved (the parts bought) are dropped."""
    raw = F.expr("""'```json\n{"justifications": [{"is_number": "IS ' || (o_orderkey % 40) || '", "justification": "text ' || o_orderkey || '"}]}\n```'""")
    claims = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.inline(render.parse_answer(raw)))
    bought = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    retrieved = bought.select(F.col("o_custkey").alias("query_id"), F.expr("'IS ' || (l_partkey % 40)").alias("is_number"))
    return render.grounded(claims, retrieved)


@query(
    "markdown_report",
    """WITH p AS (SELECT p_type AS query_id, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS position, 'IS ' || p_partkey AS is_number, p_name AS title, (p_size % 8) / 8.0 AS confidence, p_brand AS justification FROM part)
    SELECT query_id, string_agg('## ' || position || '. ' || is_number || chr(10) || chr(10) || '**' || title || '** (confidence ' || printf('%.3f', confidence) || ')' || chr(10) || chr(10) || justification || chr(10), chr(10) ORDER BY position) AS report FROM p GROUP BY query_id""",
)
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.analytics import rank_within

    ranked = rank_within(table(spark, sf_dir, "part"), "p_type", F.desc("p_retailprice"), F.col("p_partkey"))
    rows = ranked.select(F.col("p_type").alias("query_id"), F.col("rank").alias("position"), F.expr("'IS ' || p_partkey").alias("is_number"), F.col("p_name").alias("title"), F.expr("(p_size % 8) / 8.0D").alias("confidence"), F.col("p_brand").alias("justification"))
    return render.markdown_report(rows)

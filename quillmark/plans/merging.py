"""Merging, upserts and change detection over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ident import canonical_key
from ..operators import cdc, merge, observed, store
from ..session import scratch
from ..streaming import windows
from .identifiers import FAMILY, KEY, RAW, printed
from .registry import oracle_sql_of, query
from .tables import table

_SEQ = "(l_orderkey * 10 + l_linenumber)"
_ARRIVAL = f"""SELECT l_partkey AS key, {_SEQ} AS seq, 'T' || (l_suppkey % 50) AS title, CASE WHEN l_linenumber % 3 <> 0 THEN 'A' || (l_suppkey % 7) END AS aspect,
CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS committee_id, CASE WHEN l_linenumber % 4 = 1 THEN 'V' || l_returnflag END AS valid_upto, l_returnflag AS q FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1"""
_UNION = "(SELECT key, string_agg(q, ',' ORDER BY s) AS queries FROM (SELECT key, q, min(seq) AS s FROM a GROUP BY ALL) GROUP BY key)"


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    one = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(one)).filter("n = 1")
    return rows.select(
        F.col("l_partkey").alias("key"),
        F.expr(_SEQ).alias("seq"),
        F.expr("'T' || (l_suppkey % 50)").alias("title"),
        F.expr("CASE WHEN l_linenumber % 3 <> 0 THEN 'A' || (l_suppkey % 7) END").alias("aspect"),
        F.expr("CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END").alias("committee_id"),
        F.expr("CASE WHEN l_linenumber % 4 = 1 THEN 'V' || l_returnflag END").alias("valid_upto"),
        F.array("l_returnflag").alias("matched_queries"),
    )


def _merged(rows: DataFrame, last: tuple[str, ...]) -> DataFrame:
    out = merge.merge_arrivals(rows, "key", "seq", ["title", "aspect", "committee_id", "valid_upto"], last)
    return out.select("key", "title", "aspect", "committee_id", "valid_upto", F.array_join("matched_queries", ",").alias("queries"), "arrivals")


def _merge_sql(last: str) -> str:
    return f"""WITH a AS ({_ARRIVAL}), u AS {_UNION},
    m AS (SELECT key, arg_min(title, seq) AS title, {last}(aspect, seq) FILTER (aspect IS NOT NULL) AS aspect, arg_min(committee_id, seq) FILTER (committee_id IS NOT NULL) AS committee_id,
      {last}(valid_upto, seq) FILTER (valid_upto IS NOT NULL) AS valid_upto, count(*) AS arrivals FROM a GROUP BY key)
    SELECT key, title, aspect, committee_id, valid_upto, queries, arrivals FROM m JOIN u USING (key)"""


@query("dedup_merge_dept", _merge_sql("arg_max"))
def dedup_merge_dept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(_arrivals(spark, sf_dir), merge.LAST_WINS)


@query("dedup_merge_keyword", _merge_sql("arg_min"))
def dedup_merge_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(_arrivals(spark, sf_dir), ())


@query(
    "merge_counters",
    """SELECT (SELECT count(*) FROM lineitem) AS raw, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey % 3 <> 0) AS new,
    (SELECT count(*) FROM lineitem) - (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey % 3 <> 0) AS merged,
    (SELECT count(*) FROM (SELECT l_partkey FROM lineitem UNION SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)) AS total""",
)
def merge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"))
    stored = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("key"))
    return merge.merge_counters(rows, stored, "key")


@query("observed_merge", oracle_sql_of("merge_counters"))
def observed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counters, observed while the merged corpus is written."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.monotonically_increasing_id().alias("seq"), F.col("l_returnflag").alias("title"))
    stored = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title"))
    return observed.merge_and_count(stored, rows, "key", "seq", ["title"], scratch(spark, "merged"))


@query("stream_observed_run", "SELECT 'delta' AS mode, 'events' AS source, count(*) AS records_found, count(*) FILTER (event_id % 3 = 0) AS records_changed, 2 AS batches, true AS healthy FROM events")
def stream_observed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two landed files; a listener writes what each batch has observed to the table of runs."""
    landing, runs = windows.land_events(spark, f"{sf_dir}/events.parquet", scratch(spark, "landing"), files=2), scratch(spark, "runs")
    stream = spark.readStream.schema(spark.read.parquet(landing).schema).option("maxFilesPerTrigger", 1).parquet(landing)
    observed.run_and_record(stream, F.col("event_id") % 3 == 0, scratch(spark, "out"), scratch(spark, "checkpoint"), runs, source="events")
    own = spark.read.parquet(runs).groupBy("mode", "source").agg(F.sum("records_found").alias("records_found"), F.sum("records_changed").alias("records_changed"), F.count("*").cast("int").alias("batches"), F.bool_and("healthy").alias("healthy"))
    return own


# Tier 1: every even part under its own key; tier 2: the printed form of every part, twice.
_TIER1 = "SELECT 'IS ' || p_partkey AS is_number, 'IS ' || p_partkey AS canonical_key, p_name AS title, '' AS status, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS department_name FROM part WHERE p_partkey % 2 = 0"
_TIER2 = f"""SELECT p_partkey * 2 + k AS seq, CASE WHEN k = 0 THEN {RAW} ELSE ({RAW}) || ' reaffirmed' END AS is_number, coalesce({KEY}, 'none') AS canonical_key, p_name AS title,
(p_partkey + k) % 3 = 0 AS withdrawn, CASE WHEN k = 1 THEN 'P' || p_size END AS published_on, CASE WHEN k = 0 THEN '2030-01-01' ELSE '' END AS valid_upto, p_brand AS department_name, p_type AS aspect FROM part, (SELECT unnest([0, 1]) AS k)"""
_TIER2_SPARK = _TIER2.replace("FROM part, (SELECT unnest([0, 1]) AS k)", "FROM part LATERAL VIEW explode(array(0, 1)) t AS k")


def _tiers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    first = spark.sql(_TIER1.replace("FROM part", "FROM {part}"), part=part)
    second = spark.sql(_TIER2_SPARK.replace("FROM part", "FROM {part}"), part=part)
    return first, second


_ABSORBED = f"""t1 AS ({_TIER1}), t2 AS ({_TIER2}), h AS (SELECT t2.* FROM t2 SEMI JOIN t1 USING (canonical_key)),
b AS (SELECT canonical_key, arg_min(published_on, seq) FILTER (coalesce(published_on, '') <> '') AS published_on, arg_min(valid_upto, seq) FILTER (coalesce(valid_upto, '') <> '') AS valid_upto,
  arg_min(department_name, seq) FILTER (coalesce(department_name, '') <> '') AS department_name, arg_min(aspect, seq) FILTER (coalesce(aspect, '') <> '') AS aspect,
  string_agg(is_number, '|' ORDER BY seq) AS alternates FROM h GROUP BY ALL)"""


@query(
    "two_tier_merge",
    f"""WITH {_ABSORBED} SELECT is_number, t1.canonical_key, title, 'enriched' AS tier, 'current' AS status, b.published_on, b.valid_upto, coalesce(t1.department_name, b.department_name) AS department_name, b.aspect, coalesce(alternates, '') AS alternates
    FROM t1 LEFT JOIN b ON b.canonical_key = t1.canonical_key UNION ALL
    SELECT is_number, canonical_key, title, 'catalogue', CASE WHEN withdrawn THEN 'withdrawn' ELSE 'current' END, published_on, valid_upto, department_name, aspect, '' FROM t2 ANTI JOIN t1 USING (canonical_key)""",
)
def two_tier_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge.merge_tiers(*_tiers(spark, sf_dir))
    return merged.select("is_number", "canonical_key", "title", "tier", "status", "published_on", "valid_upto", "department_name", "aspect", F.array_join("alternate_designations", "|").alias("alternates"))


@query(
    "tier_overlap",
    f"WITH {_ABSORBED} SELECT (SELECT count(*) FROM h) AS catalogue_rows, (SELECT count(DISTINCT canonical_key) FROM h) AS shared_keys, (SELECT count(*) FROM t2 SEMI JOIN t1 USING (is_number)) AS exact_rows",
)
def tier_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.tier_overlap(*_tiers(spark, sf_dir))


@query(
    "preferred_version",
    f"""WITH t2 AS ({_TIER2}) SELECT canonical_key, is_number, CASE WHEN withdrawn THEN 'withdrawn' ELSE 'current' END AS status FROM t2
    QUALIFY row_number() OVER (PARTITION BY canonical_key ORDER BY withdrawn, seq) = 1""",
)
def preferred_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tiers(spark, sf_dir)[1].withColumn("status", F.when(F.col("withdrawn"), "withdrawn").otherwise("current"))
    return merge.preferred_version(rows).select("canonical_key", "is_number", "status")


@query(
    "detail_lookup",
    f"""WITH t1 AS ({_TIER1}), t2 AS ({_TIER2}), r AS (SELECT {RAW} AS request, {KEY} AS k FROM part),
    c AS (SELECT request, 0 AS step, false AS old, 0 AS seq, is_number, 'enriched' AS tier FROM r JOIN t1 ON t1.is_number = request UNION ALL
      SELECT request, 1, false, 0, is_number, 'enriched' FROM r JOIN t1 ON t1.canonical_key = k UNION ALL
      SELECT request, 2, withdrawn, seq, is_number, 'catalogue' FROM r JOIN t2 ON t2.is_number = request UNION ALL
      SELECT request, 3, withdrawn, seq, is_number, 'catalogue' FROM r JOIN t2 ON t2.canonical_key = k),
    b AS (SELECT request, min(struct_pack(step, old, seq, is_number, tier)) AS b FROM c GROUP BY request)
    SELECT request, b.is_number, b.tier, b.step FROM (SELECT DISTINCT request FROM r) LEFT JOIN b USING (request)""",
)
def detail_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _tiers(spark, sf_dir)
    corpus = first.select("is_number", "canonical_key", F.lit("enriched").alias("tier"), F.lit("current").alias("status"), F.lit(0).cast("long").alias("seq")).unionByName(
        second.select("is_number", "canonical_key", F.lit("catalogue").alias("tier"), F.when(F.col("withdrawn"), "withdrawn").otherwise("current").alias("status"), "seq")
    )
    return merge.lookup(printed(spark, sf_dir).select(F.col("raw").alias("request")).distinct(), corpus)


# Stored standards: one per order.  The fresh table changes each by its number modulo 10.
_OLD = """SELECT o_orderkey AS is_number, trim(o_orderpriority) AS title, CAST(year(o_orderdate) AS INT) AS year, CASE o_orderstatus WHEN 'O' THEN 'current' WHEN 'F' THEN 'current' ELSE 'withdrawn' END AS status,
'D' || (o_custkey % 5) AS division, 'Covers ' || o_orderpriority AS scope, array('IS ' || (o_custkey % 100), 'IS 7') AS normative_references,
CASE WHEN o_orderkey % 3 = 0 THEN 'ISI' END AS scheme, o_orderkey % 2 = 0 AS mandatory, o_orderkey % 4 AS n_amendments, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS extraction_quality FROM {orders}"""
_NEW = """SELECT is_number, CASE WHEN k = 1 THEN title || ' rev' WHEN k = 2 THEN '  ' || title WHEN k = 7 THEN NULL ELSE title END AS title, CASE WHEN k = 3 THEN year + 1 ELSE year END AS year,
CASE WHEN k IN (4, 5) THEN 'withdrawn' WHEN k = 7 THEN NULL ELSE status END AS status, division, CASE WHEN k IN (5, 6) THEN scope || ' and more' ELSE scope END AS scope,
CASE WHEN k = 8 THEN array('IS 7', normative_references[0]) WHEN k = 9 THEN array('IS 8') ELSE normative_references END AS normative_references,
CASE WHEN k = 0 THEN 'CRS' ELSE scheme END AS scheme, mandatory, CASE WHEN k = 3 THEN n_amendments + 1 ELSE n_amendments END AS n_amendments, extraction_quality / 2 + 0.25 AS extraction_quality
FROM (SELECT *, is_number % 10 AS k FROM {old}) WHERE is_number % 17 <> 0
UNION ALL SELECT is_number + 100000000, title, year, status, division, scope, normative_references, scheme, mandatory, n_amendments, extraction_quality FROM {old} WHERE is_number % 17 = 0"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = spark.sql(_OLD, orders=table(spark, sf_dir, "orders"))
    new = spark.sql(_NEW, old=old)
    shape = {
        "certification": F.when(F.col("scheme").isNotNull(), F.struct("scheme", "mandatory")),
        "amendments": F.transform(F.slice(F.array(*map(F.lit, range(1, 6))), 1, F.col("n_amendments").cast("int")), lambda i: F.struct(i.cast("string").alias("number"), F.lit(None).cast("string").alias("date"))),
        "supersedes": F.lit(None).cast("string"),
        "sources": F.array(F.lit("portal")),
        "last_seen": F.lit("2024-01-01"),
    }
    drop = ("scheme", "mandatory", "n_amendments")
    return cdc.with_hashes(old.withColumns(shape).drop(*drop)), cdc.with_hashes(new.withColumns(shape).withColumn("sources", F.array(F.lit("gazette"))).drop(*drop))


_BOTH = f"""o AS ({_OLD.format(orders="orders").replace("array(", "list_value(")}), n AS ({_NEW.format(old="o").replace("array(", "list_value(").replace("normative_references[0]", "normative_references[1]")}),
j AS (SELECT n.*, o.is_number IS NULL AS isnew, o.title AS ot, o.year AS oy, o.status AS os, o.scope AS oc, o.scheme AS osch, o.normative_references AS orf, o.n_amendments AS oa, o.extraction_quality AS oq, o.division AS od,
  trim(coalesce(n.title, '')) <> trim(coalesce(o.title, '')) AS d_st, n.scope <> o.scope AS d_sc,
  trim(n.title) IS DISTINCT FROM trim(o.title) AS d_t, n.year IS DISTINCT FROM o.year AS d_y, n.status IS DISTINCT FROM o.status AS d_s, n.n_amendments <> o.n_amendments AS d_a,
  list_sort(n.normative_references) <> list_sort(o.normative_references) AS d_r, n.scheme IS DISTINCT FROM o.scheme AS d_c, n.normative_references <> o.normative_references AS d_rraw,
  coalesce(n.status IN ('withdrawn', 'superseded'), false) AND NOT coalesce(o.status IN ('withdrawn', 'superseded'), false) AS gone FROM n LEFT JOIN o USING (is_number))"""
_CHANGED = "concat_ws(',', CASE WHEN d_t THEN 'title' END, CASE WHEN d_y THEN 'year' END, CASE WHEN d_s THEN 'status' END, CASE WHEN d_a THEN 'amendments' END, CASE WHEN d_r THEN 'normative_references' END, CASE WHEN d_c THEN 'certification' END, CASE WHEN d_st OR d_sc THEN 'scope' END)"
_KIND = "CASE WHEN isnew THEN 'new' WHEN ch = '' THEN 'unchanged' WHEN gone THEN 'withdrawn' WHEN d_st OR d_sc THEN 'scope' WHEN d_r THEN 'references' WHEN d_c THEN 'certification' ELSE 'metadata' END"
_DETECTED = f"{_BOTH}, k AS (SELECT *, CASE WHEN isnew THEN '*' ELSE {_CHANGED} END AS ch FROM j), x AS (SELECT *, {_KIND} AS kind FROM k)"


@query(
    "change_detect",
    f"WITH {_DETECTED} SELECT is_number, kind AS change_type, ch AS changed_fields, isnew OR coalesce(d_st OR d_sc, false) AS reembed, isnew OR coalesce(d_r, false) OR kind = 'withdrawn' AS update_graph FROM x",
)
def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return cdc.detect_changes(new, old).withColumn("changed_fields", F.array_join("changed_fields", ","))


@query("change_gates_legacy", f"WITH {_DETECTED} SELECT is_number, kind AS change_type, kind IN ('new', 'scope') AS reembed, kind IN ('new', 'references', 'withdrawn') AS update_graph FROM x")
def change_gates_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return cdc.detect_changes(new, old, legacy_gates=True).drop("changed_fields")


@query(
    "upsert_coalesce",
    f"""WITH {_BOTH} SELECT coalesce(n.is_number, o.is_number) AS is_number, coalesce(n.title, o.title) AS title, coalesce(n.year, o.year) AS year, coalesce(n.status, o.status) AS status,
    coalesce(n.scope, o.scope) AS scope, array_to_string(coalesce(n.normative_references, o.normative_references), ',') AS refs, round(greatest(n.extraction_quality, o.extraction_quality), 6) AS quality,
    CASE WHEN n.is_number IS NULL THEN 'portal' WHEN o.is_number IS NULL THEN 'gazette' ELSE 'portal,gazette' END AS sources, CASE WHEN n.is_number IS NULL THEN '2024-01-01' ELSE '2024-02-02' END AS last_seen
    FROM o FULL JOIN n ON n.is_number = o.is_number""",
)
def upsert_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return _shown(cdc.upsert(old, new, now=F.lit("2024-02-02")))


@query("upsert_stored", oracle_sql_of("upsert_coalesce"))
def upsert_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same upsert into a store in buckets, whose side is joined where it lies."""
    base = scratch(spark, "store")
    for rows in _versions(spark, sf_dir):
        out = store.upsert_store(spark, base, rows, merge=lambda stored, fresh, key: cdc.upsert(stored, fresh, key, now=F.lit("2024-02-02") if store.versions(spark, base) else F.lit("2024-01-01")))
    return _shown(out)


def _shown(out: DataFrame) -> DataFrame:
    return out.select("is_number", "title", "year", "status", "scope", F.array_join("normative_references", ",").alias("refs"), F.round("extraction_quality", 6).alias("quality"), F.array_join("sources", ",").alias("sources"), "last_seen")


_AUDIT_KIND = "CASE WHEN gone THEN 'withdrawn' WHEN d_c THEN 'certification' WHEN d_st OR d_sc THEN 'scope' WHEN d_rraw THEN 'references' WHEN n_amendments > oa THEN 'amendment' ELSE 'metadata' END"
_AUDIT = f"""{_DETECTED}, au AS (SELECT is_number, {_AUDIT_KIND} AS change_type, ot AS old_title, title AS new_title, os AS old_status, status AS new_status FROM x WHERE NOT isnew AND ch <> '')"""


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return cdc.audit(old, new)


@query("audit_log", f"WITH {_AUDIT} SELECT * FROM au")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = [F.get_json_object(f"{side}_values", f"$.{c}").alias(f"{side}_{c}") for c in ("title", "status") for side in ("old", "new")]
    return _audit(spark, sf_dir).select("is_number", "change_type", *image)


@query(
    "recent_changes",
    f"""WITH {_AUDIT}, t AS (SELECT is_number, change_type, date '2024-01-01' - CAST(is_number % 30 AS INT) AS changed_at FROM au)
    SELECT t.is_number, strftime(changed_at, '%Y-%m-%d') AS changed_at, change_type, n.title FROM t LEFT JOIN n USING (is_number) WHERE changed_at >= date '2023-12-25' ORDER BY t.changed_at DESC, t.is_number LIMIT 500""",
)
def recent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _audit(spark, sf_dir).withColumn("changed_at", F.expr("date_sub(date'2024-01-01', CAST(is_number % 30 AS INT))"))
    out = cdc.recent_changes(log, _versions(spark, sf_dir)[1], F.lit("2023-12-25").cast("date"))
    return out.select("is_number", F.date_format("changed_at", "yyyy-MM-dd").alias("changed_at"), "change_type", "title")

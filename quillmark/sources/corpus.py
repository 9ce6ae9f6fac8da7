"""Corpus files, compulsory lists, notifications, tenders and versioned tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classify, ident, text
from ..operators.contain import containing

_S, _I, _L, _B, _D = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CERTIFICATION = _struct(scheme=_S, scheme_label=_S, mandatory=_B, product=_S, effective_date=_S, gazette_url=_S)
ENRICHED = _struct(
    is_number=_S, title=_S, year=_I, status=_S, division=_S, scope=_S, normative_references=T.ArrayType(_S), certification=CERTIFICATION,
    amendments=T.ArrayType(_struct(number=_S, date=_S)), superseded_by=_S, supersedes=_S, extraction_quality=_D,
)
CATALOGUE = _struct(
    is_number=_S, title=_S, title_hindi=_S, standard_id=_L, department_id=_I, department_alias=_S, department_name=_S, committee_id=_I, published_on=_S, valid_upto=_S, revision_count=_I,
    aspect=_S, degree_of_equivalence=_S, withdraw_status=_I, withdrawn=_B, is_status=_I, matched_standard=_S, matched_queries=T.ArrayType(_S), source=_S, source_url=_S,
)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_records(spark: SparkSession, path: str, schema: T.StructType, envelope: str | None = None) -> DataFrame:
    """Records of a JSON array, or of the array ``envelope`` within an object; a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.option("multiLine", True)
    if envelope is None:
        return reader.schema(schema).json(path)
    return reader.schema(_struct(**{envelope: T.ArrayType(schema)})).json(path).select(F.inline(envelope))


def _pointers(spark: SparkSession, base: str) -> list[tuple[int, str]]:
    """(number, version) of the complete pointers under ``base``, oldest first."""
    if not exists(spark, base):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    names = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    parts = [n.split("-") for n in names if n.startswith("current-")]
    return sorted((int(number), version) for _, number, version in parts)


def write_versioned(df: DataFrame, base: str, counters: dict[str, Column] | None = None) -> str:
    """Write a new version and then a pointer file that names it; earlier versions and pointers stay.

    The pointer holds the version's ``counters``, aggregates that are observed
    while it is written, besides ``total_count``.

    Pointers have rising numbers and are never replaced, and one is made only
    after its data is complete: a reader sees the old version or the new one,
    whatever is interrupted.  Of two writers at once the later name wins.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    seen = Observation(version)
    df.observe(seen, F.count(F.lit(1)).alias("total_count"), *(c.alias(n) for n, c in (counters or {}).items())).write.parquet(f"{base}/v-{version}")
    number = max((n for n, _ in _pointers(spark, base)), default=0) + 1
    names = [spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{prefix}-{number:012}-{version}") for prefix in ("_writing", "current")]
    files = names[0].getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(names[0], False)
    out.write(bytearray(json.dumps(seen.get).encode()))
    out.close()
    files.rename(*names)
    return version


def read_counters(spark: SparkSession, base: str, back: int = 0) -> dict[str, int]:
    """The counters of the newest version, or of the one ``back`` versions before it."""
    found = _pointers(spark, base)
    if len(found) <= back:
        raise FileNotFoundError(f"{base} has {len(found)} versions")
    number, version = found[-1 - back]
    return json.loads(spark.read.text(f"{base}/current-{number:012}-{version}").first()[0])


def read_versioned(spark: SparkSession, base: str, back: int = 0) -> DataFrame:
    """The newest version, or the one ``back`` versions before it."""
    found = _pointers(spark, base)
    if len(found) <= back:
        raise FileNotFoundError(f"{base} has {len(found)} versions")
    return spark.read.parquet(f"{base}/v-{found[-1 - back][1]}")


def compulsory_list(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """(is_number, product): every reference of each list row, the last row of a key wins.

    The columns are found by name: one that has 'product' and one that has
    'standard' or 'is no'; else the first and the last.
    """
    names = [c for c in rows.columns if c != seq]
    product = next((c for c in names if "product" in c.lower()), names[0])
    standard = next((c for c in names if "standard" in c.lower() or "is no" in c.lower()), names[-1])
    refs = rows.select(seq, F.col(product).alias("product"), F.explode(ident.extract_references(F.col(standard))).alias("is_number"))
    return refs.groupBy("is_number").agg(F.max_by("product", seq).alias("product"))


def notifications(listing: DataFrame, keywords: tuple[str, ...] = ("quality control", "compulsory", "standard")) -> DataFrame:
    """Listing rows (title, url) whose title has one of the keywords."""
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains(F.lower("title"), F.lit(k))
    return listing.filter(hit)


def parse_notification(body: Column) -> Column:
    """struct of references, effective_date and scheme of a notification's text."""
    return F.struct(
        ident.extract_references(body).alias("is_references"),
        F.nullif(F.trim(F.regexp_extract(body, text.IN_FORCE, 1)), F.lit("")).alias("effective_date"),
        classify.scheme_of_notification(body).alias("scheme"),
    )


def fetch_tenders(requests: DataFrame, tenders: DataFrame) -> DataFrame:
    """A tender per request: equal id, else the first whose id contains it (either way, any case), else one made of the request.

    Equal ids are joined first; of requests without one and the ids, pairs come
    from the grams that they share.
    """
    equal = requests.alias("r").join(tenders.alias("t"), F.col("r.request") == F.col("t.tender_id"))
    rest = requests.join(tenders.select(F.col("tender_id").alias("request")), "request", "left_anti")
    asked, known = rest.select("request", F.lower("request").alias("text")).distinct(), tenders.select("tender_id", F.lower("tender_id").alias("text")).distinct()
    held = containing(known, asked.withColumnRenamed("text", "pattern"), "tender_id", "request")
    holds = containing(asked, known.withColumnRenamed("text", "pattern"), "request", "tender_id")
    pairs = held.select("request", "tender_id").union(holds.select("request", "tender_id")).distinct().select(F.col("request").alias("asked"), F.col("tender_id").alias("known"))
    matched = rest.alias("r").join(pairs, F.col("r.request") == F.col("asked"), "left")
    similar = matched.join(tenders.alias("t"), F.col("known") == F.col("t.tender_id"), "left")
    joined = equal.select("r.*", "t.*").unionByName(similar.select("r.*", "t.*"))
    r, t = requests.columns, tenders.columns
    joined = joined.select(F.struct(*r).alias("r"), F.struct(*t).alias("t"))
    rank = Window.partitionBy("r.request").orderBy(F.when(F.col("r.request") == F.col("t.tender_id"), 0).otherwise(1), "t.tender_id")
    best = joined.withColumn("n", F.row_number().over(rank)).filter("n = 1")
    return best.select(
        "r.request",
        F.coalesce("t.tender_id", "r.request").alias("tender_id"),
        F.coalesce("t.title", F.concat(F.lit("Tender "), F.col("r.request"))).alias("title"),
        F.coalesce("t.raw_specification", "r.request").alias("raw_specification"),
        F.when(F.col("t.tender_id").isNull(), "made").when(F.col("r.request") == F.col("t.tender_id"), "equal").otherwise("similar").alias("found"),
    )


def normalize_tender(title: Column, specification: Column, items: Column, most: int = 4000) -> Column:
    """struct of normalized_query, technical_parameters and cited_standards; by rule a query has ``most`` characters at most, the others read all."""
    parts = F.filter(F.concat(F.array(title, specification), items), lambda p: F.coalesce(p, F.lit("")) != "")
    combined = F.array_join(parts, " ")
    return F.struct(
        F.substring(text.collapse(combined), 1, most).alias("normalized_query"),
        text.technical_parameters(combined).alias("technical_parameters"),
        ident.extract_references(combined).alias("cited_standards"),
    )


def service_rows(responses: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Rows of landed service responses: JSON ``body`` with status and data.

    Responses whose status is not SUCCESS, or that can't be read, have no rows;
    absent fields are null.  Other columns are carried along.
    """
    envelope = F.from_json("body", "struct<status:string,data:array<map<string,string>>>").alias("__e")
    rest = [c for c in responses.columns if c != "body"]
    rows = responses.select(*rest, envelope).filter(F.col("__e.status") == "SUCCESS").select(*rest, F.explode("__e.data").alias("__r"))
    return rows.select(*rest, *(F.try_element_at("__r", F.lit(f)).alias(f) for f in fields))


def failed_pages(responses: DataFrame) -> DataFrame:
    """(department, offset, reason) of landed responses that have no rows: the stated status, or ``unreadable``.

    A scan records them here and goes on with the other departments.
    """
    status = F.from_json("body", "struct<status:string>")["status"]
    return responses.withColumn("reason", F.coalesce(status, F.lit("unreadable"))).filter("reason <> 'SUCCESS'").select("department", "offset", "reason")


def pages_left(responses: DataFrame, limit: int) -> DataFrame:
    """(department, offset) still to be fetched, from the total that the landed responses name.

    ``responses``: department, offset and body; the resume point of a paged scan.
    """
    total = F.coalesce(F.get_json_object("body", "$.totalRecords"), F.get_json_object("body", "$.totalRecord")).try_cast("long")
    seen = responses.groupBy("department").agg(F.max(total).alias("total"), F.collect_set("offset").alias("done")).filter("total > 0")
    every = seen.select("department", "done", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(limit).cast("long"))).alias("offset"))
    return every.filter(~F.array_contains("done", F.col("offset"))).select("department", "offset")

"""Validation of the standards that documents cite: all rules in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ident import extract_references
from ..functions.classify import role_label

# Severities in order, and limits on suggestions.
SEVERITIES = {"production": ("high", "medium", "info"), "hybrid": ("high", "medium", "low", "info")}
SUGGESTIONS = {"production": 15, "hybrid": 10}
# Keys of the hallmarking scheme.
HALLMARKING_KEYS = ("IS 1417", "IS 1418", "IS 2112", "IS 15766")
GONE = ("withdrawn", "superseded")


def citations(documents: DataFrame) -> DataFrame:
    """(doc_id, place, is_number): distinct references of each text in order of mention."""
    return documents.select("doc_id", F.posexplode(extract_references(F.col("text"))).alias("place", "is_number"))


def _rule(test: Column, n: int, severity: str, issue: Column, action: Column) -> Column:
    """What a rule says of a citation, null where its test isn't met."""
    return F.when(test, F.struct(F.lit(n).alias("rule"), F.lit(severity).alias("severity"), issue.alias("issue"), action.alias("action")))


def issues(cited: DataFrame, standards: DataFrame, profile: str = "hybrid", as_of: Column | None = None) -> DataFrame:
    """(doc_id, position, is_number, severity, issue, action), gravest first, then in order of mention.

    ``standards``: is_number, status, superseded_by, valid_upto, mandatory,
    scheme, scheme_label.  ``as_of`` is today's date as ISO text.
    """
    production = profile == "production"
    as_of = F.date_format(F.current_date(), "yyyy-MM-dd") if as_of is None else as_of
    rows = cited.join(standards.withColumn("__found", F.lit(True)), "is_number", "left")
    found, number = F.col("__found").isNotNull(), F.col("status")
    successor = F.nullif(F.col("superseded_by"), F.lit(""))
    unknown = ("Not found in the current corpus", "Verify this designation on the BIS portal.") if production else ("Not found in unified corpus", "Verify on the BIS portal.")
    gone_issue = F.concat(F.lit("This standard is "), number) if production else F.concat(F.lit("Standard is "), number, F.lit(" in official BIS catalogue"))
    no_successor = "Check the BIS portal for the current successor." if production else "Consult latest BIS catalogue for active successor."
    scheme = F.col("scheme")
    rules = [
        _rule(~found, 0, "info", F.lit(unknown[0]), F.lit(unknown[1])),
        _rule(found & F.col("status").isin(*GONE), 1, "high", gone_issue, F.coalesce(F.concat(F.lit("Replace with "), successor), F.lit(no_successor))),
    ]
    if production:
        rules.append(_rule(found & (F.col("status") == "under_revision"), 2, "medium", F.lit("This standard is under revision"), F.lit("Confirm the applicable edition before publishing the tender.")))
        label = (F.concat(F.coalesce(scheme, F.lit("None")), F.lit(" certification is mandatory")), F.lit("State the certification requirement explicitly in the tender."))
    else:
        lapsed = (F.nullif(F.col("valid_upto"), F.lit("")).isNotNull()) & (F.col("valid_upto") < as_of)
        rules.append(_rule(found & lapsed, 2, "low", F.concat(F.lit("Standard review window lapsed on "), F.col("valid_upto")), F.lit("Confirm whether BIS has issued reaffirmation or revision.")))
        label = (
            F.concat(scheme, F.lit(" certification is mandatory under applicable QCO")),
            F.concat(F.lit("Require BIS "), F.coalesce("scheme_label", F.lit("certification")), F.lit(" in tender submission criteria.")),
        )
    rules.append(_rule(found & F.col("mandatory"), 3, "medium", *label))
    out = rows.select("doc_id", "place", "is_number", F.inline(F.array_compact(F.array(*rules))))
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES[profile])), F.col("severity"))
    order = Window.partitionBy("doc_id").orderBy(rank, "place", "rule")
    return out.withColumn("position", F.row_number().over(order)).select("doc_id", "position", "is_number", "severity", "issue", "action")


def suggestions(cited: DataFrame, standards: DataFrame, edges: DataFrame, limit: int = 10, per_citation: int | None = None) -> DataFrame:
    """(doc_id, position, is_number, role, referenced_by): cited standards' references that the text lacks.

    The first citing standard wins; ``per_citation`` looks at so many of its references only.
    """
    known = cited.join(standards.select("is_number"), "is_number", "left_semi")
    links = edges if per_citation is None else edges.filter(F.col("pos") < per_citation)
    found = known.withColumnRenamed("is_number", "src").join(links, "src").select("doc_id", "place", "pos", "src", F.col("dst").alias("is_number"), "role")
    missing = found.join(cited.select("doc_id", "is_number"), ["doc_id", "is_number"], "left_anti")
    first = missing.groupBy("doc_id", "is_number").agg(F.min(F.struct("place", "pos", "src", "role")).alias("f"))
    order = Window.partitionBy("doc_id").orderBy("f.place", "f.pos")
    out = first.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
    return out.select("doc_id", "position", "is_number", role_label(F.col("f.role")).alias("role"), F.col("f.src").alias("referenced_by"))


def summary(cited: DataFrame, found_issues: DataFrame, suggested: DataFrame) -> DataFrame:
    """Counters per document: total_cited, high, medium, suggestions."""
    total = cited.groupBy("doc_id").agg(F.count("*").alias("total_cited"))
    grave = found_issues.groupBy("doc_id").agg(F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"))
    extra = suggested.groupBy("doc_id").agg(F.count("*").alias("suggestions"))
    return total.join(grave, "doc_id", "left").join(extra, "doc_id", "left").na.fill(0, ["high", "medium", "suggestions"])


def clean_standards(cited: DataFrame, found_issues: DataFrame) -> DataFrame:
    """Citations without an issue of high or medium severity."""
    return cited.join(found_issues.filter(F.col("severity").isin("high", "medium")), ["doc_id", "is_number"], "left_anti").select("doc_id", "is_number")


def pipeline_health(runs: DataFrame, newest: DataFrame, now: Column, stale_hours: int = 36, last: int = 10) -> DataFrame:
    """Issues (kind, source, detail) of the ``last`` runs and of the corpus's age.

    ``runs``: run_id, mode, source, started_at, healthy, selector_misses (map);
    ``newest``: last_seen of the corpus.
    """
    recent = runs.orderBy(F.desc("started_at"), "run_id").limit(last)
    age = newest.agg(F.max("last_seen").alias("t")).select(F.lit("stale").alias("kind"), F.lit(None).cast("string").alias("source"), F.round((F.unix_timestamp(now) - F.unix_timestamp("t")) / 3600, 0).cast("long").cast("string").alias("detail"), ((F.unix_timestamp(now) - F.unix_timestamp("t")) > stale_hours * 3600).alias("bad"))
    unhealthy = recent.filter(~F.col("healthy")).select(F.lit("unhealthy").alias("kind"), "source", F.col("mode").alias("detail"))
    missed = recent.filter(F.size("selector_misses") > 0).select(F.lit("misses").alias("kind"), "source", F.array_join(F.array_sort(F.map_keys("selector_misses")), ",").alias("detail"))
    return age.filter("bad").drop("bad").unionAll(unhealthy).unionAll(missed)

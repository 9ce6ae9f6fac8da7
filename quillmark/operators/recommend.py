"""Recommendations assembled from ranked rows, records and the citation graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, render
from .textindex import TfidfIndex

MESSAGES = {"no_results": "No standards in the current corpus matched this specification.", "low_confidence": "No confident match. Add technical detail such as material, rating, dimensions or use."}


def allied_map(edges: DataFrame, roots: DataFrame, index: TfidfIndex | None = None, depth: int = 2) -> DataFrame:
    """(root, allied): map from role label to the numbers within ``depth`` citations, most relevant first."""
    closure = graph.bfs_closure(edges, roots.select("root").distinct(), depth)
    if index is None:
        closure = closure.withColumn("similarity", F.lit(0.0))
    else:
        closure = graph.pair_similarity(closure, index.rows, "root", "node")
    roles = graph.group_by_role(closure.withColumn("relevance", graph.relevance(F.col("hop"), F.round("similarity", 6))))
    return roles.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("role_label", F.transform("members", lambda m: m.cast("string"))))).alias("allied"))


#: By rule an excerpt of a scope has so many characters.
EXCERPT = 400


def recommend(gated: DataFrame, queries: DataFrame, standards: DataFrame, edges: DataFrame, style: str = "production", index: TfidfIndex | None = None, depth: int = 2, excerpt: int = EXCERPT) -> DataFrame:
    """One row per query and position of ``gated`` (see ``retrieve.gate``), with everything shown for it.

    ``standards``: is_number, title, year, status, scope, amendments and
    certification.  Queries without a result keep one row with their state.
    """
    records = standards.select("is_number", "title", "year", "status", "scope", "amendments", "certification")
    rows = gated.withColumnRenamed("doc_id", "is_number").join(records, "is_number", "left").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    allied = allied_map(edges, gated.filter("doc_id is not null").select(F.col("doc_id").alias("root")), index, depth)
    rows = rows.join(allied.withColumnRenamed("root", "is_number"), "is_number", "left")
    number = F.col("is_number").cast("string")
    latest = render.version_string(number, F.col("year"), F.col("amendments"), style)
    found = F.col("is_number").isNotNull()
    terms = render.shared_terms(F.col("query"), F.col("title"), F.col("scope"))
    return rows.select(
        "query_id",
        "state",
        "position",
        "is_number",
        "title",
        "status",
        "confidence",
        "band",
        F.when(found, latest).alias("latest_version"),
        F.when(found, render.justify(F.col("query"), F.col("title"), F.col("scope"))).alias("justification"),
        F.when(found, terms).alias("key_attributes"),
        render.certification_view(F.col("certification")).alias("certification"),
        "allied",
        F.when(found, render.tender_clause(number, latest, F.col("title"), F.col("certification"), F.col("allied"))).alias("clause"),
        F.substring("scope", 1, excerpt).alias("scope_excerpt"),
    )

"""The engine's operations on one corpus, each for a batch of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.multilingual import normalize_query
from .functions.text import segment_items
from .operators import analytics, cdc, graph, merge, recommend, retrieve, validate
from .session import scratch
from .sources import corpus

#: Segments of one document that get recommendations, and how many each.
SEGMENTS, PER_SEGMENT = 10, 3


class Service:
    """``standards``: is_number, canonical_key, title, year, status, division, scope,
    normative_references, amendments, certification, superseded_by, valid_upto, tier and seq."""

    def __init__(self, standards: DataFrame, profile: str = "hybrid"):
        self.standards, self.profile, self._indexes = standards, profile, None
        self.edges = graph.build_edges(standards)
        self.documents = standards.select(F.col("is_number").alias("doc_id"), F.concat_ws(". ", F.coalesce("title", F.lit("")), F.coalesce("scope", F.lit(""))).alias("text"))

    @property
    def indexes(self) -> retrieve.Indexes:
        """Built with the first request and kept for the later ones."""
        if self._indexes is None:
            self._indexes = retrieve.build_indexes(self.documents, scratch(self.standards.sparkSession, "service"), self.profile)
        return self._indexes

    def health(self) -> DataFrame:
        return self.standards.agg(F.count("*").alias("records"), F.count_if(F.col("tier") == "enriched").alias("enriched"))

    def list(self, division: str | None = None, search: str | None = None) -> DataFrame:
        rows = self.standards.withColumn("mandatory", F.col("certification.mandatory"))
        return analytics.catalogue_view(analytics.filter_catalogue(rows, division, search))

    def detail(self, requests: DataFrame) -> DataFrame:
        found = merge.lookup(requests, self.standards.select("is_number", "canonical_key", "tier", "status", "seq"))
        return found.join(self.standards.drop("tier"), "is_number", "left")

    def graph(self, roots: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        return graph.neighbourhood(self.edges, roots, depth)

    def recommend(self, queries: DataFrame) -> DataFrame:
        """``queries``: query_id, text in any of the supported languages."""
        asked = queries.select("query_id", normalize_query(F.col("text"))["normalized"].alias("text"))
        profile = retrieve.PROFILES[self.profile]
        gated = retrieve.gate(asked, retrieve.retrieve(self.indexes, asked, self.profile), profile)
        return recommend.recommend(gated, asked, self.standards, self.edges, "production" if self.profile == "production" else "hybrid")

    def recommend_documents(self, documents: DataFrame) -> DataFrame:
        """The best rows for each of a document's first numbered items; query_id is doc_id#segment."""
        items = documents.select("doc_id", F.posexplode(segment_items(F.col("text"))).alias("segment", "text")).filter(F.col("segment") < SEGMENTS)
        found = self.recommend(items.select(F.concat_ws("#", "doc_id", "segment").alias("query_id"), "text"))
        return found.filter(F.coalesce(F.col("position") <= PER_SEGMENT, F.lit(True)))

    def validate(self, documents: DataFrame, as_of: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Issues, suggestions and counters of ``documents`` (doc_id, text)."""
        cited = validate.citations(documents)
        known = self.standards.select(
            F.col("canonical_key").alias("is_number"), "status", "superseded_by", "valid_upto", F.coalesce("certification.mandatory", F.lit(False)).alias("mandatory"), F.col("certification.scheme").alias("scheme"), F.col("certification.scheme_label").alias("scheme_label")
        )
        issues = validate.issues(cited, known, "production" if self.profile == "production" else "hybrid", as_of)
        suggested = validate.suggestions(cited, known, self.edges, validate.SUGGESTIONS["production" if self.profile == "production" else "hybrid"])
        return issues, suggested, validate.summary(cited, issues, suggested)

    def ingest_tenders(self, requests: DataFrame, tenders: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Recommendations per tender, and issues of those that cite standards."""
        fetched = corpus.fetch_tenders(requests, tenders).withColumn("n", corpus.normalize_tender(F.col("title"), F.col("raw_specification"), F.array().cast("array<string>")))
        found = self.recommend(fetched.select(F.col("request").alias("query_id"), F.col("n.normalized_query").alias("text")))
        citing = fetched.filter(F.size("n.cited_standards") > 0).select(F.col("request").alias("doc_id"), F.col("n.normalized_query").alias("text"))
        return found, self.validate(citing)[0]

    def feedback(self, rows: DataFrame, path: str) -> None:
        """Append feedback (recommendation_id, is_number, verdict, comment); unknown verdicts are refused."""
        bad = rows.filter(~F.col("verdict").isin("accept", "reject") | F.col("verdict").isNull())
        if not bad.isEmpty():
            raise ValueError("verdict must be accept or reject")
        rows.withColumns({"id": F.expr("uuid()"), "created_at": F.current_timestamp()}).write.mode("append").parquet(path)

    def coverage(self) -> DataFrame:
        return analytics.coverage(self.standards.withColumns({"extraction_quality": F.lit(None).cast("double"), "last_seen": F.lit(None).cast("timestamp")}))

    def changes(self, log: DataFrame, since: Column) -> DataFrame:
        return cdc.recent_changes(log, self.standards, since)

"""Hybrid ranked retrieval: arms, fusion, reranking, confidence, gate."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .reranker import with_texts
from .textindex import Bm25Index, TfidfIndex, bm25_best, build_bm25, build_tfidf, char_grams, tfidf_best, word_grams


@dataclass(frozen=True)
class Profile:
    """Constants of one retrieval configuration."""

    arm_k: int
    top_k: int
    quality_at: float | None
    clip: bool
    digits: int
    gate: float
    rerank_k: int | None = None
    rrf_k: int = 60
    low_confidence_rows: int = 0


# The three configurations.
PROFILES = {
    "production": Profile(arm_k=50, top_k=5, quality_at=None, clip=False, digits=4, gate=0.35, rerank_k=10, low_confidence_rows=3),
    "hybrid": Profile(arm_k=35, top_k=5, quality_at=0.40, clip=True, digits=3, gate=0.25),
    "offline": Profile(arm_k=25, top_k=3, quality_at=0.45, clip=True, digits=3, gate=0.35),
}
QUALITY_WEIGHT, AGREEMENT_WEIGHT, MARGIN_WEIGHT = 0.65, 0.15, 0.20
#: Documents handed to the reranker.
RERANK_INPUT = 50


def top_k(scores: DataFrame, k: int, positive: bool = True, digits: int = 6) -> DataFrame:
    """The ``k`` best rows per query with their rank; scores are rounded first and ties go to the smaller id."""
    scores = scores.withColumn("score", F.round("score", digits))
    if positive:
        scores = scores.filter("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of equal length; null for a zero vector."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


#: Bytes of one block of query vectors.
QUERY_BYTES = 128 << 20
#: Scores that one task holds at a time.
_SCORES = 4_000_000


def _unit_rows(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows) of the vectors that have a direction, scaled to length one; nulls and zero vectors have none."""
    places = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    if not len(places):
        return places, np.zeros((0, 0))
    kept = vectors.take(pa.array(places))
    rows = kept.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(places), -1)
    length = np.sqrt((rows * rows).sum(axis=1))
    real = length > 0
    return places[real], rows[real] / length[real, None]


def _nearest(shared, k: int):
    """(query_id, doc_id, score): of each slice of documents the rows that can be among the ``k`` best of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = shared.value
        step = max(1, _SCORES // max(len(ids), 1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                places, rows = _unit_rows(part.column("vector"))
                if not len(places) or not len(ids):
                    continue
                score = np.round(rows @ asked.T, 6)
                least = np.partition(score, len(places) - k, axis=0)[len(places) - k] if len(places) > k else np.full(len(ids), -np.inf)
                doc, query = np.nonzero(score >= least)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), part.column("doc_id").take(pa.array(places[doc])), pa.array(score[doc, query])], ["query_id", "doc_id", "score"])

    return run


def knn(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None, max_queries: int = 100_000) -> DataFrame:
    """(query_id, doc_id, score, rank): exact cosine neighbours; ``where`` filters before ranking.

    ``queries`` (query_id, query_vector) is a stated set: blocks of at most
    ``max_queries`` rows and ``QUERY_BYTES`` are broadcast and multiplied with
    the vectors where they lie; only what can be among a query's best leaves a task.
    """
    pool = (vectors if where is None else vectors.filter(where)).select("doc_id", "vector")
    n, numbers = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("query_vector").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-n // max_queries), -(-8 * numbers // QUERY_BYTES))
    kinds = T.StructType([queries.schema["query_id"], vectors.schema["doc_id"], T.StructField("score", T.DoubleType())])
    out = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        held = part.select("query_id", "query_vector").toArrow().combine_chunks()
        places, rows = _unit_rows(held["query_vector"].combine_chunks())
        shared = vectors.sparkSession.sparkContext.broadcast((held["query_id"].combine_chunks().take(pa.array(places, pa.int64())), rows))
        ranked = top_k(pool.mapInArrow(_nearest(shared, k), kinds), k, positive=False)
        out = ranked if out is None else out.unionAll(ranked)
    return out


def fuse(dense: DataFrame, sparse: DataFrame, rrf_k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked arms, full outer by query and document."""
    a = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    b = sparse.select("query_id", "doc_id", F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score"))
    parts = [F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0)) for c in ("dense_rank", "sparse_rank")]
    return a.join(b, ["query_id", "doc_id"], "full").withColumns({"dense_score": F.coalesce("dense_score", F.lit(0.0)), "sparse_score": F.coalesce("sparse_score", F.lit(0.0)), "fused": F.round(parts[0] + parts[1], 9)})


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.75, "High").when(confidence >= 0.50, "Medium").otherwise("Low")


def rerank(fused: DataFrame, scorer: Callable[[DataFrame], Column] | None, keep: int, inputs: int = RERANK_INPUT, texts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Re-score the best ``inputs`` rows per query and keep ``keep``.

    ``scorer`` gives the score column of a frame to which ``texts`` has joined
    query and document text; without one the order of the fused score stays and
    it is the score.  The rank filter comes before both, so an expensive model
    sees few rows.
    """
    by_fused = Window.partitionBy("query_id").orderBy(F.desc("fused"), "doc_id")
    best = fused.withColumn("position", F.row_number().over(by_fused)).filter(F.col("position") <= inputs)
    told = texts(best) if texts and scorer else best
    scored = told.withColumn("rerank_score", F.col("fused") if scorer is None else scorer(told)).select(*best.columns, "rerank_score")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "doc_id")
    return scored.withColumn("position", F.row_number().over(by_score)).filter(F.col("position") <= keep)


def with_confidence(ranked: DataFrame, profile: Profile) -> DataFrame:
    """Confidence of the final rows (query_id, position, dense_score, ranks).

    Blends quality, agreement of the arms and, for the leader alone, the margin
    over position 2.  The best dense score is that of the final rows.
    """
    own = Window.partitionBy("query_id")
    if profile.quality_at is None:
        quality = sigmoid(F.col("rerank_score"))
        best, second = F.max(F.when(F.col("position") == 1, quality)).over(own), F.max(F.when(F.col("position") == 2, quality)).over(own)
        margin = F.greatest(F.lit(0.0), best - F.coalesce(second, F.lit(0.0)))
    else:
        quality = F.least(F.lit(1.0), F.col("dense_score") / profile.quality_at)
        best = F.max("dense_score").over(own)
        best = F.when(best == 0, 1e-9).otherwise(best)
        second = F.coalesce(F.max(F.when(F.col("position") == 2, F.col("dense_score"))).over(own), F.lit(0.0))
        margin = F.greatest(F.lit(0.0), (best - second) / best)
    agreement = F.when(F.col("dense_rank").isNotNull() & F.col("sparse_rank").isNotNull(), 1.0).otherwise(0.0)
    value = QUALITY_WEIGHT * quality + AGREEMENT_WEIGHT * agreement + MARGIN_WEIGHT * F.when(F.col("position") == 1, margin).otherwise(0.0)
    if profile.clip:
        value = F.least(F.lit(1.0), value)
    return ranked.withColumn("confidence", F.round(value, profile.digits)).withColumn("band", band(F.col("confidence")))


def gate(queries: DataFrame, ranked: DataFrame, profile: Profile) -> DataFrame:
    """One or more rows per query with its state: ok, low_confidence or no_results.

    Under the gate a query keeps its first ``low_confidence_rows`` rows, or one
    row without a document where the profile keeps none.
    """
    leader = F.max(F.when(F.col("position") == 1, F.col("confidence"))).over(Window.partitionBy("query_id"))
    state = F.when(F.col("doc_id").isNull(), "no_results").when(F.col("leader") < profile.gate, "low_confidence").otherwise("ok")
    all_rows = queries.select("query_id").join(ranked, "query_id", "left").withColumn("leader", leader).withColumn("state", state)
    kept = F.col("position") <= F.when(F.col("state") == "ok", F.lit(profile.top_k)).otherwise(F.lit(max(profile.low_confidence_rows, 1)))
    shown = all_rows.filter(kept | F.col("doc_id").isNull())
    if profile.low_confidence_rows:
        return shown.drop("leader")
    blank = {c: F.when(F.col("state") == "ok", F.col(c)) for c in ranked.columns if c != "query_id"}
    return shown.withColumns(blank).drop("leader")


@dataclass(frozen=True)
class Indexes:
    """The indexes of a corpus that the arms of a profile read."""

    word: TfidfIndex | None = None
    char: TfidfIndex | None = None
    bm25: Bm25Index | None = None


def build_indexes(docs: DataFrame, path: str, profile: str = "hybrid", dense: bool = False) -> Indexes:
    """Write the indexes of ``docs`` (doc_id, text) that ``profile`` needs under ``path``; ``dense``: a vector search is the dense arm."""
    char = None if dense else build_tfidf(docs, f"{path}/char", char_grams)
    if profile == "production":
        return Indexes(char=char, bm25=build_bm25(docs, f"{path}/bm25"))
    return Indexes(word=build_tfidf(docs, f"{path}/word", word_grams), char=char)


def retrieve(indexes: Indexes, queries: DataFrame, profile: str = "hybrid", dense: DataFrame | None = None, scorer: Callable[[DataFrame], Column] | None = None, docs: DataFrame | None = None) -> DataFrame:
    """End to end for a batch of ``queries`` (query_id, text) over an indexed corpus.

    The production configuration takes ``dense`` (query_id, doc_id, score, rank)
    from a vector search and BM25 as its sparse arm; the others use character
    and word TF-IDF.  ``scorer`` sees the texts of ``docs`` (doc_id, text).
    """
    p = PROFILES[profile]
    sparse = top_k(bm25_best(indexes.bm25, queries, p.arm_k) if profile == "production" else tfidf_best(indexes.word, queries, p.arm_k), p.arm_k)
    if dense is None:
        dense = top_k(tfidf_best(indexes.char, queries, p.arm_k), p.arm_k)
    fused = fuse(dense, sparse, p.rrf_k)
    ranked = rerank(fused, scorer, p.rerank_k or p.top_k, texts=None if docs is None else lambda rows: with_texts(rows, queries, docs))
    return with_confidence(ranked.filter(F.col("position") <= p.top_k), p)

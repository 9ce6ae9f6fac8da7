"""Retrieval queries: every benchmark item against all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import reranker
from ..operators import retrieve as R
from ..operators.textindex import STOP_WORDS, bm25_best, tfidf_best
from ..operators.vectorindex import search
from ..service import Service
from ..session import kept as written
from . import indexes
from .registry import query
from .tables import benchmark_queries, documents, table

HYBRID = R.PROFILES["hybrid"]
KNN_QUERIES_EVERY = 50

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOKENS = (
    "list_concat(list_transform(regexp_extract_all(lower(text), 'is\\s*\\d+(?:-\\d+)?'), lambda d: regexp_replace(d, '\\s+', '', 'g')),"
    " regexp_extract_all(regexp_replace(lower(text), 'is\\s*\\d+(?:-\\d+)?', ' ', 'g'), '[a-z]+|\\d+(?:\\.\\d+)?'))"
)
_BM25 = f"""
dt AS (SELECT doc_id, {_TOKENS} AS toks FROM documents),
dl AS (SELECT doc_id, len(toks) AS dl FROM dt),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM dt) GROUP BY ALL),
raw AS (SELECT term, ln((SELECT n FROM st) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf GROUP BY term),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
bs AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM tf JOIN qt USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL)"""
_WORDS = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]{{2,}}'), lambda w: w NOT IN ({_STOPS}))"


def _word_rows(source: str, key: str) -> str:
    return f"""(SELECT {key}, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term
      FROM (SELECT {key}, {_WORDS} AS ws FROM {source}))"""


def _char_rows(source: str, key: str) -> str:
    return f"""(SELECT {key}, substring(w, i, n) AS term, c FROM
      (SELECT {key}, ' ' || w || ' ' AS w, count(*) AS c FROM (SELECT {key}, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM {source}) WHERE w <> '' GROUP BY ALL),
      (SELECT unnest([3, 4, 5]) AS n), LATERAL (SELECT unnest(range(1, length(w) - n + 2)) AS i))"""


def _tfidf(p: str, docs: str, asked: str, tf: str) -> str:
    """CTEs of one TF-IDF arm with prefix ``p``, ending in {p}s (query_id, doc_id, score)."""
    return f"""
{p}d AS (SELECT doc_id, term, {tf} AS tf FROM {docs} GROUP BY doc_id, term),
{p}i AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM {p}d GROUP BY term),
{p}r AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS r FROM {p}d JOIN {p}i USING (term)),
{p}n AS (SELECT doc_id, sqrt(sum(r * r)) AS norm FROM {p}r GROUP BY doc_id),
{p}q AS (SELECT query_id, term, {tf} AS tf FROM {asked} GROUP BY query_id, term),
{p}v AS (SELECT query_id, term, (1 + ln(tf)) * idf AS r FROM {p}q JOIN {p}i USING (term)),
{p}m AS (SELECT query_id, sqrt(sum(r * r)) AS norm FROM {p}v GROUP BY query_id),
{p}s AS (SELECT query_id, doc_id, round(sum({p}r.r / {p}n.norm * ({p}v.r / {p}m.norm)), 6) AS score
  FROM {p}r JOIN {p}v USING (term) JOIN {p}n USING (doc_id) JOIN {p}m USING (query_id) GROUP BY query_id, doc_id)"""


_ITEMS = "(SELECT item_id AS query_id, text FROM benchmark)"
_WORD_ARM = _tfidf("w", _word_rows("documents", "doc_id"), _word_rows(_ITEMS, "query_id"), "count(*)")
_CHAR_ARM = _tfidf("c", _char_rows("documents", "doc_id"), _char_rows(_ITEMS, "query_id"), "sum(c)")


def _ranked(source: str, k: int) -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {source} WHERE score > 0
      QUALIFY rank <= {k})"""


def _fused(profile: R.Profile, dense: str = "cs", sparse: str = "ws") -> str:
    return f"""
d AS {_ranked(dense, profile.arm_k)}, s AS {_ranked(sparse, profile.arm_k)},
f AS (SELECT query_id, doc_id, d.rank AS dense_rank, s.rank AS sparse_rank, coalesce(d.score, 0) AS dense_score, coalesce(s.score, 0) AS sparse_score,
  round(coalesce(1.0 / (60 + d.rank), 0::DOUBLE) + coalesce(1.0 / (60 + s.rank), 0::DOUBLE), 9) AS fused FROM d FULL JOIN s USING (query_id, doc_id))"""


def _confident(profile: R.Profile) -> str:
    """CTEs from the fused rows ``f`` to ``e`` with confidence and band."""
    top = f"t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) AS position FROM f QUALIFY position <= {profile.top_k})"
    agree = "0.15::DOUBLE * (dense_rank IS NOT NULL AND sparse_rank IS NOT NULL)::INT"
    if profile.quality_at is None:
        b = "b AS (SELECT *, 1 / (1 + exp(-fused)) AS q, max(1 / (1 + exp(-fused))) FILTER (position = 1) OVER w AS best, coalesce(max(1 / (1 + exp(-fused))) FILTER (position = 2) OVER w, 0) AS second FROM t WINDOW w AS (PARTITION BY query_id))"
        value = f"0.65::DOUBLE * q + {agree} + 0.20::DOUBLE * CASE WHEN position = 1 THEN greatest(0::DOUBLE, best - second) ELSE 0 END"
    else:
        b = "b AS (SELECT *, greatest(max(dense_score) OVER w, 0::DOUBLE) AS best, coalesce(max(dense_score) FILTER (position = 2) OVER w, 0) AS second FROM t WINDOW w AS (PARTITION BY query_id))"
        best = "(CASE WHEN best = 0 THEN 1e-9::DOUBLE ELSE best END)"
        value = f"0.65::DOUBLE * least(1.0::DOUBLE, dense_score / {profile.quality_at}::DOUBLE) + {agree} + 0.20::DOUBLE * CASE WHEN position = 1 THEN greatest(0::DOUBLE, ({best} - second) / {best}) ELSE 0 END"
    if profile.clip:
        value = f"least(1.0::DOUBLE, {value})"
    k = f"k AS (SELECT *, round({value}, {profile.digits}) AS confidence FROM b)"
    return f"{top},\n{b},\n{k},\ne AS (SELECT *, CASE WHEN confidence >= 0.75 THEN 'High' WHEN confidence >= 0.50 THEN 'Medium' ELSE 'Low' END AS band FROM k)"


_FUSED, _CONFIDENT = _fused(HYBRID), _confident(HYBRID)


def word_arm(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return R.top_k(tfidf_best(indexes.words(spark, sf_dir), benchmark_queries(spark, sf_dir), k), k)


def char_arm(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return R.top_k(tfidf_best(indexes.characters(spark, sf_dir), benchmark_queries(spark, sf_dir), k), k)


@query("bm25_topk", f"WITH {_BM25} SELECT query_id, doc_id, rank, score FROM {_ranked('bs', 50)}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = R.PROFILES["production"].arm_k
    scores = bm25_best(indexes.bm25(spark, sf_dir), benchmark_queries(spark, sf_dir), k)
    return R.top_k(scores, k).select("query_id", "doc_id", "rank", "score")


@query("tfidf_word_topk", f"WITH {_WORD_ARM} SELECT query_id, doc_id, rank, score FROM {_ranked('ws', HYBRID.arm_k)}")
def tfidf_word_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_arm(spark, sf_dir, HYBRID.arm_k).select("query_id", "doc_id", "rank", "score")


@query("tfidf_char_topk", f"WITH {_CHAR_ARM} SELECT query_id, doc_id, rank, score FROM {_ranked('cs', HYBRID.arm_k)}")
def tfidf_char_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return char_arm(spark, sf_dir, HYBRID.arm_k).select("query_id", "doc_id", "rank", "score")


@query("rrf_fusion", f"WITH {_WORD_ARM}, {_CHAR_ARM}, {_FUSED} SELECT query_id, doc_id, dense_rank, sparse_rank, fused FROM f")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = R.fuse(char_arm(spark, sf_dir, HYBRID.arm_k), word_arm(spark, sf_dir, HYBRID.arm_k))
    return fused.select("query_id", "doc_id", "dense_rank", "sparse_rank", "fused")


@query("hybrid_retrieve", f"WITH {_WORD_ARM}, {_CHAR_ARM}, {_FUSED}, {_CONFIDENT} SELECT query_id, doc_id, position AS rank, fused, confidence, band FROM e")
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = R.retrieve(indexes.of_profile(spark, sf_dir, "hybrid"), benchmark_queries(spark, sf_dir), "hybrid")
    return ranked.select("query_id", "doc_id", F.col("position").alias("rank"), "fused", "confidence", "band")


@query(
    "hybrid_gate",
    f"""WITH {_WORD_ARM}, {_CHAR_ARM}, {_FUSED}, {_CONFIDENT},
g AS (SELECT item_id AS query_id, e.doc_id, e.position, e.confidence,
  CASE WHEN e.doc_id IS NULL THEN 'no_results' WHEN max(e.confidence) FILTER (e.position = 1) OVER (PARTITION BY item_id) < 0.25 THEN 'low_confidence' ELSE 'ok' END AS state
  FROM benchmark LEFT JOIN e ON e.query_id = item_id)
SELECT query_id, state, CASE WHEN state = 'ok' THEN doc_id END AS doc_id, CASE WHEN state = 'ok' THEN position END AS rank, CASE WHEN state = 'ok' THEN confidence END AS confidence
FROM g WHERE state <> 'low_confidence' OR position = 1""",
)
def hybrid_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = benchmark_queries(spark, sf_dir)
    gated = R.gate(asked, R.retrieve(indexes.of_profile(spark, sf_dir, "hybrid"), asked, "hybrid"), HYBRID)
    return gated.select("query_id", "state", "doc_id", F.col("position").alias("rank"), "confidence")


_RERANK = f"""p AS (SELECT query_id, doc_id, score AS x, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM {_ranked("bs", 50)} QUALIFY position <= 10)"""


@query(
    "rerank_sigmoid",
    f"WITH {_BM25}, {_RERANK} SELECT query_id, doc_id, position AS rank, round(1 / (1 + exp(-(x / 10))), 6) AS quality FROM p",
)
def rerank_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = R.top_k(bm25_best(indexes.bm25(spark, sf_dir), benchmark_queries(spark, sf_dir), 50), 50)
    kept = R.rerank(scores.withColumnRenamed("score", "fused"), None, 10)
    return kept.select("query_id", "doc_id", F.col("position").alias("rank"), F.round(R.sigmoid(F.col("rerank_score") / 10), 6).alias("quality"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.filter(F.col("vec_id") % KNN_QUERIES_EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label"), asked


def _knn_sql(where: str) -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % {KNN_QUERIES_EVERY} = 0),
s AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(qv::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, embeddings {where})
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score IS NOT NULL QUALIFY rank <= 50"""


@query("knn_cosine_topk", _knn_sql(""))
def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool, asked = _vectors(spark, sf_dir)
    return R.knn(pool, asked, 50).select("query_id", "doc_id", "score", "rank")


@query("knn_filtered", _knn_sql("WHERE label = 1"))
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool, asked = _vectors(spark, sf_dir)
    return R.knn(pool, asked, 50, where=F.col("label") == 1).select("query_id", "doc_id", "score", "rank")


@query("vector_index_topk")
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest by the approximate index; its recall against the exact search is tested."""
    pool, asked = _vectors(spark, sf_dir)
    return search(indexes.vectors(spark, sf_dir, pool), asked, 10)


@query(
    "vector_index_all_cells",
    f"""WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % {KNN_QUERIES_EVERY} = 0),
s AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(qv::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, embeddings WHERE label = 1)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score IS NOT NULL QUALIFY rank <= 5""",
)
def vector_index_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of one label; all cells are probed and the coded order is refined deeply, so the result is the exact one."""
    pool, asked = _vectors(spark, sf_dir)
    index = indexes.vectors(spark, sf_dir, pool)
    return search(index, asked, 5, probes=len(index.codec.centres), refine=40, where=F.col("label") == 1)


_VECTOR_ARM = """vs AS (SELECT item_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
  FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings e)"""


@query("retrieve_production", f"WITH {_BM25}, {_VECTOR_ARM}, {_fused(R.PROFILES['production'], 'vs', 'bs')}, {_confident(R.PROFILES['production'])} SELECT query_id, doc_id, position AS rank, fused, confidence, band FROM e")
def retrieve_production(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense arm searches the vectors; an item's own vector is that of equal number."""
    items, dense = _production(spark, sf_dir)
    ranked = R.retrieve(indexes.of_profile(spark, sf_dir, "production"), items, "production", dense=dense)
    return ranked.select("query_id", "doc_id", F.col("position").alias("rank"), "fused", "confidence", "band")


def _production(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The items and their dense arm."""
    items, vectors = benchmark_queries(spark, sf_dir), table(spark, sf_dir, "embeddings")
    asked = items.join(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id").select("query_id", "query_vector")
    found = R.knn(vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), asked, R.PROFILES["production"].arm_k)
    return items, found.filter("score > 0")


def fitted_scorer(spark: SparkSession, sf_dir: str):
    """A scorer fitted on every second item: what the production arms find, right where the document holds the item."""
    (items, dense), docs = _production(spark, sf_dir), documents(spark, sf_dir)
    k = R.PROFILES["production"].arm_k
    learnt = items.filter(F.crc32(F.col("query_id").cast("string").cast("binary")) % 2 == 0)
    # read twice: for the pairs to learn from, and with their texts
    fused = written(R.fuse(dense.join(learnt.select("query_id"), "query_id", "left_semi"), R.top_k(bm25_best(indexes.bm25(spark, sf_dir), learnt, k), k)))
    model = reranker.train(reranker.with_texts(fused, learnt, docs), E.holders(docs, learnt))
    return reranker.scorer(model) if model else None


def reranked(spark: SparkSession, sf_dir: str, scorer) -> DataFrame:
    (items, dense), docs = _production(spark, sf_dir), documents(spark, sf_dir)
    return R.retrieve(indexes.of_profile(spark, sf_dir, "production"), items, "production", dense=dense, scorer=scorer, docs=docs)


@query("rerank_fitted")
def rerank_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production profile with a fitted model; that more of them are right than by the fused score is tested on items that it hasn't seen."""
    ranked = reranked(spark, sf_dir, fitted_scorer(spark, sf_dir))
    return ranked.select("query_id", "doc_id", F.col("position").alias("rank"), F.round(R.sigmoid(F.col("rerank_score")), 6).alias("quality"), "confidence", "band")


@query("retrieve_offline", f"WITH {_WORD_ARM}, {_CHAR_ARM}, {_fused(R.PROFILES['offline'])}, {_confident(R.PROFILES['offline'])} SELECT query_id, doc_id, position AS rank, fused, confidence, band FROM e")
def retrieve_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = R.retrieve(indexes.of_profile(spark, sf_dir, "offline"), benchmark_queries(spark, sf_dir), "offline")
    return ranked.select("query_id", "doc_id", F.col("position").alias("rank"), "fused", "confidence", "band")


_PARTS_AS_CORPUS = """documents AS (SELECT 'IS ' || p_partkey AS doc_id, p_name || '. ' || p_type AS text FROM part),
benchmark AS (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 150 = 0 THEN 'qqq zzz' ELSE p_name END AS text FROM part WHERE p_partkey % 50 = 0)"""


@query(
    "recommend_end_to_end",
    f"""WITH {_PARTS_AS_CORPUS}, {_WORD_ARM}, {_CHAR_ARM}, {_FUSED}, {_CONFIDENT},
g AS (SELECT item_id AS query_id, e.doc_id, e.position, e.confidence, e.band,
  CASE WHEN e.doc_id IS NULL THEN 'no_results' WHEN max(e.confidence) FILTER (e.position = 1) OVER (PARTITION BY item_id) < 0.25 THEN 'low_confidence' ELSE 'ok' END AS state FROM benchmark LEFT JOIN e ON e.query_id = item_id),
kk AS (SELECT *, state = 'ok' AS shown, (SELECT max(p_partkey) FROM part) AS last, CASE WHEN state = 'ok' THEN substr(doc_id, 4)::BIGINT END AS n FROM g WHERE state <> 'low_confidence' OR position = 1)
SELECT query_id, state, CASE WHEN shown THEN position END AS position, CASE WHEN shown THEN doc_id END AS is_number, CASE WHEN shown THEN confidence END AS confidence, CASE WHEN shown THEN band END AS band,
  CASE WHEN shown THEN p_name END AS title, CASE WHEN shown THEN doc_id || CASE WHEN n % 5 > 0 THEN ':' || (1900 + n % 100) ELSE '' END || ' (Amdt 2)' END AS latest_version,
  CASE WHEN shown AND n % 2 = 0 THEN true END AS mandatory, nullif(concat_ws(',', CASE WHEN n < last THEN 'IS ' || (n + 1) END, CASE WHEN n + 1 < last THEN 'IS ' || (n + 2) END), '') AS allied, shown AS clause
FROM kk LEFT JOIN part ON p_partkey = n""",
)
def recommend_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From text to recommendation over one corpus, the parts: retrieve, gate, enrich, allied, clause, for the names of every fiftieth part."""
    parts = table(spark, sf_dir, "part")
    kind = "struct<scheme:string,scheme_label:string,mandatory:boolean,product:string>"
    standards = parts.crossJoin(F.broadcast(parts.agg(F.max("p_partkey").alias("last")))).selectExpr(
        "'IS ' || p_partkey AS is_number", "'IS ' || p_partkey AS canonical_key", "p_name AS title", "CASE WHEN p_partkey % 5 > 0 THEN 1900 + p_partkey % 100 END AS year", "'current' AS status", "p_brand AS division", "p_type AS scope",
        "CASE WHEN p_partkey < last THEN array('IS ' || (p_partkey + 1)) ELSE array() END AS normative_references", "array(struct('2' AS number, CAST(NULL AS STRING) AS date)) AS amendments",
        f"CASE WHEN p_partkey % 2 = 0 THEN CAST(struct('ISI' AS scheme, CAST(NULL AS STRING) AS scheme_label, CAST(NULL AS BOOLEAN) AS mandatory, CAST(NULL AS STRING) AS product) AS {kind}) END AS certification",
        "CAST(NULL AS STRING) AS superseded_by", "CAST(NULL AS STRING) AS valid_upto", "'enriched' AS tier", "p_partkey AS seq",
    )
    asked = parts.filter("p_partkey % 50 = 0").selectExpr("p_partkey AS query_id", "CASE WHEN p_partkey % 150 = 0 THEN 'qqq zzz' ELSE p_name END AS text")
    rows = Service(standards).recommend(asked)
    allied = F.nullif(F.array_join(F.flatten(F.map_values("allied")), ","), F.lit(""))
    return rows.select("query_id", "state", "position", "is_number", "confidence", "band", "title", "latest_version", "certification.mandatory", allied.alias("allied"), F.col("clause").isNotNull().alias("clause"))

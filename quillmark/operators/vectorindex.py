"""An approximate vector index: coarse cells as partitions, residuals in product codes.

Unit vectors are dealt to cells by their nearest centre; what is left of a vector
there is coded by the nearest word of a small book for each of its parts, a byte
each.  The index is a table partitioned by cell.  A search reads only the cells
nearest to its queries and only their codes, ranks by the coded vectors, and
re-scores the best by the vectors themselves.  Centres and books are learnt from
a bounded sample; all vectors are indexed.  How many cells a query probes is
measured on the sample, for the recall that is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .retrieve import _unit_rows, cosine, top_k

#: Documented bounds: bytes and rows of the sample, cells, bytes of one block of queries.
SAMPLE_BYTES, SAMPLE_ROWS, CELLS, QUERY_BYTES = 64 << 20, 65_536, 4_096, 64 << 20
#: Rows that a cell has on average, in small tables.
CELL_ROWS = 128
WORDS = 256
#: Parts of a cell, so that a cell with a third of all vectors is written by several tasks.
SPLITS = 8


def _means(rows: np.ndarray, k: int, rounds: int = 12, unit: bool = False) -> np.ndarray:
    """``k`` centres of the rows; a centre without rows moves to the row that lies farthest."""
    seeds = np.random.default_rng(17).permutation(len(rows))[:k]
    centres = rows[seeds].copy()
    for _ in range(rounds):
        own, away = _assigned(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        count = np.bincount(own, minlength=len(centres))
        empty = np.flatnonzero(count == 0)
        sums[empty], count[empty] = rows[np.argsort(-away, kind="stable")[: len(empty)]], 1
        centres = sums / count[:, None]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _assigned(rows: np.ndarray, centres: np.ndarray, step: int = 8_192) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, squared distance to it) of each row."""
    own, away = np.empty(len(rows), np.int64), np.empty(len(rows))
    half = (centres * centres).sum(axis=1) / 2
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        near = part @ centres.T - half
        own[at : at + step] = near.argmax(axis=1)
        away[at : at + step] = (part * part).sum(axis=1) - 2 * near.max(axis=1)
    return own, away


@dataclass(frozen=True)
class Codec:
    """``centres``: a row per cell; ``books``: for each part of a residual its words; ``probes``: cells that a query reads."""

    centres: np.ndarray
    books: np.ndarray
    probes: int

    @classmethod
    def fit(cls, rows: np.ndarray, total: int, parts: int | None, recall: float, k: int) -> Codec:
        """From a sample of unit vectors of a table of ``total`` ones."""
        width = rows.shape[1]
        cells = max(1, min(CELLS, -(-total // CELL_ROWS), len(rows)))
        centres = _means(rows, cells, unit=True)
        own, _ = _assigned(rows, centres)
        parts = parts or next(p for p in range(max(1, width // 2), 0, -1) if width % p == 0)
        residual = (rows - centres[own]).reshape(len(rows), parts, -1)
        books = np.stack([_padded(_means(residual[:, p], min(WORDS, len(rows)))) for p in range(parts)])
        return cls(centres, books, cls._probes(rows, centres, own, recall, k))

    @staticmethod
    def _probes(rows: np.ndarray, centres: np.ndarray, own: np.ndarray, recall: float, k: int) -> int:
        """The fewest cells that hold the share ``recall`` of the true neighbours of sampled rows."""
        asked = np.random.default_rng(18).permutation(len(rows))[:256]
        score = rows[asked] @ rows.T
        score[np.arange(len(asked)), asked] = -2
        near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, max(1, len(rows) - 1))]
        place = np.argsort(np.argsort(-(rows[asked] @ centres.T), axis=1, kind="stable"), axis=1)
        found = np.bincount(np.take_along_axis(place, own[near], axis=1).ravel(), minlength=len(centres))
        return int(np.searchsorted(np.cumsum(found), recall * found.sum() - 1e-9)) + 1

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code) of unit vectors."""
        cell, _ = _assigned(rows, self.centres)
        parts = len(self.books)
        residual = (rows - self.centres[cell]).reshape(len(rows), parts, -1)
        return cell, np.stack([_assigned(residual[:, p], self.books[p])[0] for p in range(parts)], axis=1).astype(np.uint8)


def _padded(words: np.ndarray) -> np.ndarray:
    return np.concatenate([words, np.repeat(words[-1:], WORDS - len(words), axis=0)])


@dataclass(frozen=True)
class VectorIndex:
    """``rows``: doc_id, code, vector and kept columns, partitioned by cell."""

    rows: DataFrame
    codec: Codec


def _encoded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, rows = _unit_rows(batch.column("vector"))
            if len(places):
                cell, code = shared.value.encode(rows)
                kept = batch.take(pa.array(places))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], [*kept.schema.names, "cell", "code"])

    return run


def build_vector_index(vectors: DataFrame, path: str, keep: tuple[str, ...] = (), parts: int | None = None, recall: float = 0.95, k: int = 10) -> VectorIndex | None:
    """Index ``vectors`` (doc_id, vector and the columns ``keep``) under ``path``; nothing if none has a direction.

    The sample is made of the rows whose doc_id has the least hash.  Nulls and
    zero vectors are left out, as in the exact search.  ``recall`` of the ``k``
    nearest chooses the number of probes.
    """
    spark = vectors.sparkSession
    slim = vectors.select("doc_id", "vector", *keep)
    width = F.size("vector")
    total, longest = slim.filter(width > 0).agg(F.count("*"), F.max(width)).first()
    if not total:
        return None
    bound = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * longest)))
    sample = slim.filter(width > 0).orderBy(F.xxhash64("doc_id"), "doc_id").select("vector").limit(bound).toArrow()
    _, rows = _unit_rows(sample["vector"].combine_chunks())
    if not len(rows):
        return None
    codec = Codec.fit(rows, total, parts, recall, k)
    kinds = T.StructType([*slim.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType())])
    coded = slim.mapInArrow(_encoded(spark.sparkContext.broadcast(codec)), kinds)
    dealt = coded.repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(SPLITS)))
    dealt.write.mode("overwrite").partitionBy("cell").parquet(path)
    stored = T.StructType([f for f in kinds if f.name != "cell"] + [kinds["cell"]])
    return VectorIndex(spark.read.schema(stored).parquet(path), codec)


@dataclass(frozen=True)
class _Asked:
    """A block of queries: who probes each cell, the products with centres and words."""

    ids: pa.Array
    by_cell: dict[int, np.ndarray]
    centre: np.ndarray
    words: np.ndarray
    most: int

    @classmethod
    def of(cls, ids: pa.Array, rows: np.ndarray, codec: Codec, probes: int, most: int) -> _Asked:
        centre = rows @ codec.centres.T
        nearest = np.argsort(-centre, axis=1, kind="stable")[:, :probes]
        by_cell = {int(c): np.flatnonzero((nearest == c).any(axis=1)) for c in np.unique(nearest)}
        parts = rows.reshape(len(rows), len(codec.books), -1)
        words = np.einsum("qpd,pwd->qpw", parts, codec.books).astype(np.float32)
        return cls(ids, by_cell, centre.astype(np.float32), words, most)

    def best(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """(query_id, doc_id, cell, score) of the rows that can be among a query's ``most`` best."""
        cells = batch.column("cell").to_numpy()
        codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1).astype(np.int64)
        spread = np.arange(codes.shape[1])
        queries, places, scores = [], [], []
        for cell in np.unique(cells):
            at = np.flatnonzero(cells == cell)
            for q in self.by_cell.get(int(cell), ()):
                score = self.words[q][spread, codes[at]].sum(axis=1) + self.centre[q, cell]
                keep = np.flatnonzero(score >= np.partition(score, len(at) - self.most)[len(at) - self.most]) if len(at) > self.most else np.arange(len(at))
                queries.append(np.full(len(keep), q))
                places.append(at[keep])
                scores.append(score[keep])
        if queries:
            place = np.concatenate(places)
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(np.concatenate(queries))), batch.column("doc_id").take(pa.array(place)), pa.array(cells[place], pa.int32()), pa.array(np.concatenate(scores).astype(float))], ["query_id", "doc_id", "cell", "score"])


def _candidates(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from shared.value.best(batch)

    return run


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, refine: int = 16, where: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` nearest by the index, with exact scores.

    ``queries`` (query_id, query_vector) is a stated set, taken in blocks whose
    tables have ``QUERY_BYTES`` at most.  ``probes`` cells are read for each
    query (as measured if not given; all cells: no vector is left out before
    ranking), ``refine`` times ``k`` rows are scored exactly; ``where`` filters
    on kept columns before ranking.
    """
    spark, codec = index.rows.sparkSession, index.codec
    probes = min(len(codec.centres), probes or codec.probes)
    pool = index.rows if where is None else index.rows.filter(where)
    each = 4 * (codec.books.shape[0] * WORDS + len(codec.centres)) + 8 * codec.centres.shape[1]
    blocks = max(1, -(-queries.count() * each // QUERY_BYTES))
    kinds = T.StructType([queries.schema["query_id"], index.rows.schema["doc_id"], T.StructField("cell", T.IntegerType()), T.StructField("score", T.DoubleType())])
    found = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        held = part.select("query_id", "query_vector").toArrow().combine_chunks()
        places, rows = _unit_rows(held["query_vector"].combine_chunks())
        if not len(places):
            continue
        asked = _Asked.of(held["query_id"].combine_chunks().take(pa.array(places, pa.int64())), rows, codec, probes, refine * k)
        read = pool.filter(F.col("cell").isin(list(asked.by_cell))).select("doc_id", "cell", "code")
        near = top_k(read.mapInArrow(_candidates(spark.sparkContext.broadcast(asked)), kinds), refine * k, positive=False)
        near = near.select("query_id", "doc_id", "cell").distinct()
        full = pool.filter(F.col("cell").isin(list(asked.by_cell))).select("doc_id", "cell", "vector").join(near, ["cell", "doc_id"])
        scored = full.join(part.select("query_id", "query_vector"), "query_id").select("query_id", "doc_id", cosine(F.col("vector"), F.col("query_vector")).alias("score"))
        ranked = top_k(scored, k, positive=False)
        found = ranked if found is None else found.unionAll(ranked)
    if found is None:
        found = spark.createDataFrame([], T.StructType([kinds["query_id"], kinds["doc_id"], kinds["score"], T.StructField("rank", T.IntegerType())]))
    return found.select("query_id", "doc_id", "score", "rank")


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, wanted, found): how many of the exact neighbours each query has found."""
    hits = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id").withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return hits.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))

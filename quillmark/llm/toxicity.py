"""Toxicity by a character n-gram linear classifier on naive Bayes log-count ratios.

Features are the character n-grams (3 to 6 code points, blanks included) of the
lower-cased text with white space folded, hashed to ``2**BUCKET_BITS`` cells; a
feature counts once per text.  Each is scaled by its log-count ratio between
toxic and other training texts; a logistic regression is fitted on the scaled
features that tell the classes apart most surely.  Scoring is one pass over the
texts without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc_mod, materialize, pieces, small_batches

SIZES = (3, 4, 5, 6)
BUCKET_BITS = 20
#: Documented bound of the labelled sample the classifier is fitted on.
TRAINING_ROWS = 20_000
#: The sample is bounded, and so are its partitions.
SAMPLE_PARTITIONS = 12
FEATURES = 2_048
THRESHOLD = 0.7
HELD_OUT = (3, 1)

_STEP = np.random.default_rng(11).integers(0, 2**31, max(SIZES), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_CHUNK = 250_000


@dataclass(frozen=True)
class Model:
    """``slot``: cell to feature number or -1; ``weight``: per feature, ratio included."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float


def _fold(text: str | None) -> str:
    return " " + " ".join((text or "").lower().split()) + " " + "\0" * max(SIZES)


def _cells(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, cell of the n-gram at each position) for code points that end in zeros."""
    h = np.zeros(len(points), np.uint32)
    with np.errstate(over="ignore"):
        for j in range(max(SIZES)):
            h = h[: len(points) - j] + points[j:] * _STEP[j]
            if j + 1 in SIZES:
                g = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                yield j + 1, (g ^ (g >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BUCKET_BITS)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, count, code points, starts) of runs of texts, bounded unless one text is longer."""
    first, parts, size = 0, [], 0
    for i, text in enumerate(texts):
        parts.append(_fold(text))
        size += len(parts[-1])
        if size >= _CHUNK or i + 1 == len(texts):
            points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield first, len(parts), points, np.cumsum([0, *(len(p) for p in parts[:-1])])
            first, parts, size = i + 1, [], 0


def features(texts: list[str | None], slot: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, count, text numbers, features) with each feature once per text.

    ``slot`` maps cells to features; without it the cells are the features.
    """
    for first, count, points, starts in _chunks(texts):
        found = []
        ends = np.flatnonzero(points == 0)
        for n, cells in _cells(points):
            at = np.arange(len(cells)) if slot is None else np.flatnonzero(slot[cells] >= 0)
            nearest = ends[np.searchsorted(ends, at)]
            at = at[nearest >= at + n]
            of = np.searchsorted(starts, at, "right") - 1
            found.append(of.astype(np.int64) << 32 | (cells[at] if slot is None else slot[cells[at]]).astype(np.int64))
        pairs = np.unique(np.concatenate(found))
        yield first, count, pairs >> 32, pairs & 0xFFFFFFFF


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch in pieces(batches):
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(int)
        for first, _, of, cell in features(batch.column("text").to_pylist(), None):
            for label in (0, 1):
                seen[label] += np.bincount(cell[toxic[first + of] == label], minlength=seen.shape[1])
    cells = np.flatnonzero(seen.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(seen[0][cells]), pa.array(seen[1][cells])], ["cell", "clean", "toxic"])


def _extract(slot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            held = [[] for _ in range(batch.num_rows)]
            for first, count, of, feature in features(batch.column("text").to_pylist(), slot.value):
                for i, part in enumerate(np.split(feature, np.searchsorted(of, np.arange(1, count)))):
                    held[first + i] = part.astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(held, pa.list_(pa.int32()))], ["toxic", "features"])

    return run


def _fit(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, steps: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on ratio-scaled features by full-batch Adam."""
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.concatenate(rows) if len(of) else np.empty(0, np.int64)
    scale = ratio[at]
    w, m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for t in range(1, steps + 1):
        z = np.bincount(of, w[at] * scale, len(rows)) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        gradient = np.append(np.bincount(at, error[of] * scale, len(ratio)), error.sum()) / len(rows)
        gradient[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, n_features: int = FEATURES) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out fold, with ``n_features`` cells at most.

    A document labelled more than once counts as toxic if one label says so;
    of rows that share a doc_id the text with the least hash is learnt from, so
    that ``rows`` bounds what the fit holds whatever the ids.  Labels that are
    null or whose document is missing are left out.  Cells that tell the classes
    apart equally are taken by number.  Without labels the model is constant and
    scores 0.
    """
    spark = docs.sparkSession
    chosen = (
        labels.filter("doc_id is not null and toxic is not null")
        .filter(id_crc_mod(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1])
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # The ids are ``rows`` at most, so the broadcast is bounded.
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    found = found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")).select("toxic", "least.text")
    sample = materialize(found.repartition(SAMPLE_PARTITIONS), "labelled")
    counts = materialize(sample.transform(small_batches).mapInArrow(_count, "cell int, clean long, toxic long").groupBy("cell").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "counts")
    slot = np.full(1 << BUCKET_BITS, -1, np.int32)
    clean, toxic, cells = counts.agg(F.sum("clean"), F.sum("toxic"), F.count("*")).first()
    if not clean or not toxic:
        return Model(slot, np.zeros(0), -40.0)
    p, q = F.col("toxic") + 1.0, F.col("clean") + 1.0
    ratio = F.log(p / (toxic + cells)) - F.log(q / (clean + cells))
    sure = F.round(F.abs(ratio) / F.sqrt(1 / p + 1 / q), 9)
    best = counts.select("cell", ratio.alias("ratio"), sure.alias("sure")).orderBy(F.desc("sure"), "cell").limit(n_features).toArrow()
    slot[best["cell"].to_numpy()] = np.arange(len(best))
    ratios = best["ratio"].to_numpy()
    held = sample.transform(small_batches).mapInArrow(_extract(spark.sparkContext.broadcast(slot)), "toxic int, features array<int>").toArrow()
    lists = held["features"].combine_chunks()
    rows = np.split(lists.flatten().to_numpy().astype(np.int64), np.cumsum(pc.list_value_length(lists).to_numpy())[:-1])
    weight, bias = _fit(rows, held["toxic"].to_numpy().astype(float), ratios)
    return Model(slot, weight * ratios, bias)


def score_texts(texts: list[str | None], model: Model) -> np.ndarray:
    out = np.zeros(len(texts))
    for first, count, of, feature in features(texts, model.slot):
        out[first : first + count] = np.bincount(of, model.weight[feature], count)
    return 1 / (1 + np.exp(-np.clip(out + model.bias, -40, 40)))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts(batch.column("text").to_pylist(), model.value))], ["doc_id", "score"])

    return run


def _keep(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.filter(pa.array(score_texts(batch.column("text").to_pylist(), model.value) < threshold))

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Null and empty texts get the score of a text without features.  Rows
    without doc_id are scored too; repeated rows get equal scores; an empty
    table gives no rows.  Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(small_batches).mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", (id_crc_mod(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.transform(small_batches).mapInArrow(_keep(model, threshold), docs.schema)

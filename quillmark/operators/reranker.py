"""A learnt reranker: how well a text answers a query, from what the two share.

The model is a logistic regression on a few features of a pair, fitted in numpy
on a bounded sample of labelled pairs and held by each worker while it scores:
it is a scorer for ``retrieve.rerank``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documented bound of the pairs that the model is fitted on.
PAIRS = 20_000
FEATURES = ("words", "pairs", "runs", "whole", "length", "fused")
_WORD = re.compile(r"\w+")


def pair_features(query: str | None, text: str | None, fused: float) -> tuple[float, ...]:
    """``FEATURES``: shares of the query's words, word pairs and runs of five words that the text has, whether it has all of them in a row, its length, the fused score."""
    asked, words = _WORD.findall((query or "").lower()), _WORD.findall((text or "").lower())
    held = set(words)

    def share(n: int) -> float:
        own = {tuple(asked[i : i + n]) for i in range(len(asked) - n + 1)}
        if not own:
            return 0.0
        starts = {g[0] for g in own}
        return len(own & {tuple(words[i : i + n]) for i, w in enumerate(words) if w in starts}) / len(own)

    one = sum(w in held for w in set(asked)) / max(1, len(set(asked)))
    five = share(min(5, len(asked))) if asked else 0.0
    whole = float(bool(asked) and five == 1.0 and f" {' '.join(asked)} " in f" {' '.join(words)} ")
    return one, share(2), five, whole, float(np.log1p(len(words))), float(fused or 0.0)


@dataclass(frozen=True)
class Model:
    """Weights of the standardised features; the score is the log odds."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return np.round((features - self.mean) / self.scale @ self.weight + self.bias, 9)


def fit(features: np.ndarray, labels: np.ndarray, steps: int = 400, ridge: float = 1e-3) -> Model:
    """Logistic regression by full-batch Adam; both classes weigh the same."""
    mean, scale = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-9)
    x, y = (features - mean) / scale, labels.astype(float)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    weigh = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    w, m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        error = (1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -40, 40))) - y) * weigh
        gradient = np.append(x.T @ error, error.sum()) / len(y) + ridge * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]))


def with_texts(ranked: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``ranked`` with ``query`` and ``text`` of each pair; call it after the rank filter, texts are joined for these rows only."""
    asked = queries.select("query_id", F.col("text").alias("query"))
    return ranked.join(asked, "query_id").join(docs.select("doc_id", "text"), "doc_id")


def bounded(pairs: DataFrame, most: int) -> DataFrame:
    """``pairs`` of at most ``most`` ids (query_id, doc_id), those of least hash.

    They are chosen by their ids alone: pairs with their texts would gather in
    each task, and then in one.
    """
    taken = pairs.select("query_id", "doc_id").distinct().orderBy(F.xxhash64("query_id", "doc_id"), "query_id", "doc_id").limit(most)
    return pairs.join(F.broadcast(taken), ["query_id", "doc_id"], "left_semi")


def train(pairs: DataFrame, positives: DataFrame, most: int = PAIRS) -> Model | None:
    """Fit on ``pairs`` (query_id, doc_id, query, text, fused), those among ``positives`` (query_id, doc_id) being right.

    At most ``most`` pairs by the hash of their ids; nothing if all or none are right.
    """
    right = positives.select("query_id", "doc_id", F.lit(1).alias("right")).distinct()
    labelled = bounded(pairs, most).join(right, ["query_id", "doc_id"], "left").select("query", "text", "fused", F.coalesce("right", F.lit(0)).alias("label"))

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [pair_features(q, t, f) for q, t, f in zip(frame["query"], frame["text"], frame["fused"], strict=True)]
            yield pd.DataFrame(rows, columns=list(FEATURES)).assign(label=frame["label"].to_numpy())

    held = labelled.mapInPandas(told, ", ".join(f"{n} double" for n in FEATURES) + ", label int").toPandas()
    if held["label"].nunique() < 2:
        return None
    held = held.sort_values(list(held.columns), kind="stable")
    return fit(held[list(FEATURES)].to_numpy(), held["label"].to_numpy())


def scorer(model: Model) -> Callable[[DataFrame], Column]:
    """A scorer of rows with ``query``, ``text`` and ``fused``; a worker opens the model once for all its batches."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        opened = model
        for query, text, fused in batches:
            rows = np.array([pair_features(q, t, f) for q, t, f in zip(query, text, fused, strict=True)]).reshape(-1, len(FEATURES))
            yield pd.Series(opened.score(rows))

    return lambda rows: score(F.col("query"), F.col("text"), F.col("fused"))

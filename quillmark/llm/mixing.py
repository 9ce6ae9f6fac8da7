"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) are counted per cell of source, language and topic.  The cell
weights are raked in turn to the target marginals, ``SWEEPS`` times; a document's
keep probability is its cell's factor, scaled so that the largest factor among
the cells with tokens is 1.  Documents are then sampled by a uniform number derived from the
id, so a run can be repeated and each document is decided on its own.

Every category is raked by itself.  A table of at most ``MAX_CELLS`` cells is
raked on the driver; a larger one stays in Spark, where each step of a sweep is
a join and an aggregation.  Both take the same steps to the same factors.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

DIMENSIONS = ("source", "lang", "topic")
#: Cells that the driver holds at most; beyond them the raking runs in Spark.
MAX_CELLS = 200_000
SWEEPS = 40
#: Default targets flatten each marginal: share ** TEMPERATURE, normalised.
TEMPERATURE = 0.9
SEED = "mix-1"

_WEIGHTS = ", ".join(f"{d} string" for d in DIMENSIONS) + ", weight double"


def topic_of(text: Column) -> Column:
    """A text's register, from its surface: the topic where none is given.

    symbols (a twentieth of the characters are of #$%&*@|~^<>{}), figures
    (a hundredth are digits), note (under 400 characters), lines (a line
    break at least every 120 characters), prose (the rest).
    """
    n = F.greatest(F.length(text), F.lit(1))
    symbols = n - F.length(F.translate(text, "#$%&*@|~^<>{}", ""))
    digits = n - F.length(F.translate(text, "0123456789", ""))
    lines = n - F.length(F.translate(text, "\n", ""))
    return (
        F.when(F.length(text) == 0, "note")
        .when(symbols * 20 >= n, "symbols")
        .when(digits * 100 >= n, "figures")
        .when(n < 400, "note")
        .when(lines * 120 >= n, "lines")
        .otherwise("prose")
    )


def count_tokens(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _categories(docs: DataFrame) -> dict[str, Column]:
    """The columns that give a row's category; null counts as the empty category."""
    out = {d: F.coalesce(F.col(d).cast("string"), F.lit("")) for d in DIMENSIONS if d in docs.columns}
    return out if "topic" in out else out | {"topic": topic_of(F.coalesce(F.col("text").cast("string"), F.lit("")))}


def _shares(names: list[str], tokens: np.ndarray, target: dict[str, float]) -> np.ndarray:
    """The share of each category with tokens.

    What the target leaves of 1 goes to the categories that it doesn't name, by
    their tokens.  If it leaves nothing, these keep their own shares, with a
    warning, and the target divides the rest; only a stated 0 drops a category.
    A target for a category without tokens is spread over the others.
    """
    named = np.array([c in target for c in names], bool)
    share = np.array([target.get(c, 0.0) for c in names], float)
    own = tokens / tokens.sum()
    stated, free = share.sum(), own[~named].sum()
    if free > 0:
        left = 1 - stated
        if left <= 1e-9:
            left = free
            left_out = [c for c, x in zip(names, named, strict=True) if not x]
            warnings.warn(f"the target leaves no share for {len(left_out)} categories, which keep their own: {left_out[:5]}", stacklevel=2)
        if not stated:
            left = 1.0
        share = np.where(named, share * ((1 - left) / stated if stated else 0.0), own * (left / free))
    elif not stated:
        share = np.ones(len(names))
    return share / share.sum()


def _sweep(value: np.ndarray, codes: list[np.ndarray], shares: list[np.ndarray], sweeps: int) -> list[np.ndarray]:
    """Factors per category of each dimension; ``codes``: each cell's category as a number."""
    scale = [np.ones(len(s)) for s in shares]
    for _ in range(sweeps):
        for i in range(len(shares)):
            now = value.copy()
            for j in range(len(shares)):
                now = now * scale[j][codes[j]]
            sums = np.bincount(codes[i], now, len(shares[i]))
            total = now.sum()
            scale[i] = scale[i] * np.where(sums > 0, shares[i] * total / np.where(sums > 0, sums, 1), 1.0)
    return scale


def rake(cells: dict[tuple, float], targets: list[dict], sweeps: int = SWEEPS) -> list[dict]:
    """Factors per category of each dimension so that the weighted cells meet the target shares."""
    keys = sorted(cells)
    value = np.array([cells[k] for k in keys], float)
    codes, shares, names = [], [], []
    for i, target in enumerate(targets):
        order = sorted({k[i] for k in keys})
        place = {c: n for n, c in enumerate(order)}
        codes.append(np.array([place[k[i]] for k in keys]))
        shares.append(_shares(order, np.bincount(codes[i], value, len(order)), target))
        names.append(order)
    return [dict(zip(n, s.tolist(), strict=True)) for n, s in zip(names, _sweep(value, codes, shares, sweeps), strict=True)]


def _weights_on_driver(spark: SparkSession, cells: pa.Table, targets: dict[str, dict[str, float]]) -> DataFrame:
    """(source, lang, topic, weight) of a bounded table of cells (source, lang, topic, n)."""
    value = cells["n"].to_numpy().astype(float)
    full, weight = value > 0, np.ones(cells.num_rows)
    if full.any():
        codes, shares, places = [], [], []
        for d in DIMENSIONS:
            encoded = cells[d].combine_chunks().dictionary_encode()
            used, code = np.unique(encoded.indices.to_numpy()[full], return_inverse=True)
            names = encoded.dictionary.take(pa.array(used)).to_pylist()
            tokens = np.bincount(code, value[full], len(names))
            target = targets.get(d) or dict(zip(names, (tokens**TEMPERATURE).tolist(), strict=True))
            place = np.full(len(encoded.dictionary), len(names))
            place[used] = np.arange(len(names))
            places.append(place[encoded.indices.to_numpy()])
            codes.append(code)
            shares.append(_shares(names, tokens, target))
        factors = [np.append(f, 1.0) for f in _sweep(value[full], codes, shares, SWEEPS)]
        most = np.prod([f[p[full]] for f, p in zip(factors, places, strict=True)], axis=0).max()
        weight = np.full(cells.num_rows, 1 / most if most else 1.0)
        for f, p in zip(factors, places, strict=True):
            weight = weight * f[p]
    return spark.createDataFrame(cells.select(list(DIMENSIONS)).append_column("weight", pa.array(weight, pa.float64())), schema=_WEIGHTS)


def _shares_in_spark(cells: DataFrame, d: str, target: dict[str, float] | None) -> DataFrame:
    """(category, share) as ``_shares`` has it, and factor 1."""
    spark = cells.sparkSession
    tokens = materialize(cells.groupBy(d).agg(F.sum("n").alias("n")), "marginal")
    if not target:
        share = tokens.withColumn("share", F.pow("n", F.lit(TEMPERATURE)))
    else:
        stated = spark.createDataFrame([(c, float(x)) for c, x in target.items()], f"`{d}` string, stated double")
        tokens = tokens.join(stated, d, "left")
        found = tokens.agg(F.sum("n").alias("n"), F.sum("stated").alias("stated"), F.sum(F.when(F.col("stated").isNull(), F.col("n"))).alias("free")).first()
        sums, free = found["stated"] or 0.0, (found["free"] or 0.0) / found["n"]
        left = 1 - sums
        if free > 0 and left <= 1e-9:
            left = free
            warnings.warn(f"the target of {d} leaves no share for categories that it doesn't name; they keep their own", stacklevel=2)
        if not sums:
            left = 1.0
        own = F.col("n") / F.lit(found["n"])
        share = tokens.withColumn("share", F.coalesce(F.col("stated") * F.lit((1 - left) / sums if free > 0 and sums else 1.0), own * F.lit(left / free if free > 0 else 1.0)))
        if free == 0 and not sums:
            share = share.withColumn("share", F.lit(1.0))
    share = materialize(share.select(d, "share"), "shares")
    total = share.agg(F.sum("share")).first()[0]
    return share.select(d, (F.col("share") / F.lit(total)).alias("share"), F.lit(1.0).alias(f"f_{d}"))


def _weights_in_spark(cells: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    """(source, lang, topic, weight) of a table of cells of any size.

    The sum over all cells, by which ``_sweep`` multiplies, is left out: it is
    common to all factors of a dimension and the last scale takes it away.
    """
    full = cells.filter("n > 0").withColumn("n", F.col("n").cast("double"))
    whole = full.agg(F.sum("n")).first()[0]
    if whole is None:
        return cells.select(*DIMENSIONS, F.lit(1.0).alias("weight"))
    factors = {d: _shares_in_spark(full, d, targets.get(d)) for d in DIMENSIONS}

    def weighed(table: DataFrame, how: str = "inner") -> tuple[DataFrame, Column]:
        product = F.lit(1.0)
        for d in DIMENSIONS:
            table = table.join(factors[d].select(d, f"f_{d}"), d, how)
            product = product * F.coalesce(F.col(f"f_{d}"), F.lit(1.0))
        return table, product

    for _ in range(SWEEPS):
        for d in DIMENSIONS:
            table, product = weighed(full)
            sums = table.groupBy(d).agg(F.sum(F.col("n") * product).alias("sum"))
            scaled = F.when(F.col("sum") > 0, F.col("share") * F.lit(whole) / F.col("sum")).otherwise(1.0)
            factors[d] = materialize(factors[d].join(sums, d).select(d, "share", (F.col(f"f_{d}") * scaled).alias(f"f_{d}")), "factors")
    table, product = weighed(full)
    most = table.agg(F.max(product)).first()[0]
    table, product = weighed(cells, "left")
    return materialize(table.select(*DIMENSIONS, (F.lit(1 / most if most else 1.0) * product).alias("weight")), "weights")


def fit_mix(profile: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(source, lang, topic, weight) of all cells of ``profile``, raked to ``targets`` (dimension: category: share)."""
    cells = profile.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n"))
    held = cells.limit(MAX_CELLS + 1).toArrow()
    if held.num_rows <= MAX_CELLS:
        return F.broadcast(_weights_on_driver(profile.sparkSession, held, targets or {}))
    return _weights_in_spark(materialize(cells, "cells"), targets or {})


def _probability(weight: Column) -> Column:
    return F.round(F.least(weight, F.lit(1.0)), 9)


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id; the same in any run and engine with md5."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|" + seed))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _described(docs: DataFrame) -> dict[str, Column]:
    """What the mix needs of each row: its categories and its number of tokens."""
    return _categories(docs) | {"n_tokens": count_tokens(F.coalesce(F.col("text").cast("string"), F.lit("")))}


def _profile(docs: DataFrame) -> DataFrame:
    values = [v.alias(d) for d, v in _described(docs).items()]
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *values), "profile")


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, u, kept) per row of ``docs``.

    Null categories count as the empty category, null texts have no tokens;
    rows that repeat a doc_id are kept or left together if their categories
    agree.  Without tokens at all every probability is 1.  Categories that a
    target doesn't name share what it leaves of 1.  An empty table gives no rows.  A column named topic is used as the topic, others are ignored.
    """
    profile = _profile(docs)
    weights = fit_mix(profile, targets)
    out = profile.join(weights, list(DIMENSIONS)).select("doc_id", *DIMENSIONS, "n_tokens", _probability(F.col("weight")).alias("probability"), uniform(F.col("doc_id")).alias("u"))
    return out.withColumn("kept", F.col("u") < F.col("probability"))


def sample_mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that the mix keeps; see ``mixed``.

    Topics and tokens are worked out once and written beside the rows, so the
    texts aren't scanned again to pick the sample.
    """
    mix = "_mix"
    while mix in docs.columns:
        mix += "_"
    keyed = materialize(docs.select("*", F.struct(*(v.alias(d) for d, v in _described(docs).items())).alias(mix)), "described")
    weights = fit_mix(keyed.select(f"{mix}.*"), targets).select(F.struct(*DIMENSIONS).alias(f"{mix}_cell"), F.col("weight").alias(f"{mix}_weight"))
    cell = F.struct(*(F.col(f"{mix}.{d}").alias(d) for d in DIMENSIONS))
    placed = keyed.withColumn(f"{mix}_cell", cell).join(weights, f"{mix}_cell")
    chosen = uniform(F.col("doc_id")) < _probability(F.col(f"{mix}_weight"))
    return placed.filter(chosen).select(*docs.columns)

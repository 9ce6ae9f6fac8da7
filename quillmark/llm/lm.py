"""Log-bilinear language model, trained with noise-contrastive estimation in numpy.

The vocabulary is every word that occurs ``MIN_COUNT`` times in training, up to
``VOCABULARY`` words; rarer and unseen words are taken by their last letters,
``ENDINGS`` buckets.  Words are dealt to classes by what stands before them
(k-means on their neighbour counts), buckets of rare words likewise.  Two
log-bilinear models give the probability of the next word:

* the next class from the classes of the ``POSITIONS`` words before it, each
  position with its own combination matrix:
  score(c | h) = (R[h1] C1 + R[h2] C2) . Q[c] + b[c];
* the word within its class, every word with its own vector, from the class
  before it: score(w | c, h) = (R'[h1] C') . Q'[w] + b'[w].

N-grams of classes and pairs of class and word are counted over all training
texts; training maximises the noise-contrastive objective in expectation over
those counts and over the unigram noise, so every training token takes part and
a fit can be repeated.  Both are normalised exactly by batched matrix products
over all outcomes.  A rare word's share within its class is (c + 1) / (tokens +
words + 1) of that class, which leaves room for one unseen word, so the
probabilities of all next words add up to one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, id_crc_mod, materialize, pieces, small_batches, split_words

#: Words with vectors of their own; bounds what the driver and every task hold.
VOCABULARY = 32_768
MIN_COUNT = 10
ENDINGS = 1_024
POSITIONS = 2
#: Classes of vocabulary words, of endings, and that of the end of a text, 0.
WORD_CLASSES, TAIL_CLASSES = 96, 31
CLASSES = 1 + TAIL_CLASSES + WORD_CLASSES
#: Kinds of neighbours that words are dealt to classes by.
SEEDS = 128
#: Words whose counts every task holds; the counts of all others are joined.
HELD_WORDS = 200_000
DIMENSION, WORD_DIMENSION = 40, 16
NOISE_SAMPLES = 16
STEPS, WORD_STEPS = 160, 80
HELD_OUT = (7, 2)
#: The end token; white space can't be a word.
END = b"\n"
_FLUSH = 1_000_000


def ending(word: bytes) -> int:
    """The bucket of a rare word, by its last two bytes."""
    return zlib.crc32(word[-2:]) % ENDINGS


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        seen.clear()
        return out

    for batch in pieces(batches):
        for text in column_bytes(batch, "text"):
            seen.update(split_words(text))
            seen[END] += 1
            if len(seen) > _FLUSH:
                yield flush()
    yield flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): how often each token, the end included, occurs in ``docs``."""
    return docs.select(F.col("text").cast("string").alias("text")).transform(small_batches).mapInArrow(_tally, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass(frozen=True)
class Units:
    """Numbers of words: vocabulary words from 0, then the buckets of endings, then the end of a text."""

    index: dict[bytes, int]

    @property
    def end(self) -> int:
        return len(self.index) + ENDINGS

    def numbers(self, words: list[bytes]) -> list[int]:
        find, tail = self.index.get, len(self.index)
        return [tail + ending(w) if (k := find(w)) is None else k for w in words]


def _cells(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["cell", "n"])


def _runs(batches: Iterator[pa.RecordBatch], units: Units) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the tokens of many texts, ``POSITIONS`` ends before each text; and the places of the tokens."""
    part: list[int] = []
    starts: list[int] = []

    def take():
        place = np.ones(len(part), bool)
        for j in range(POSITIONS):
            place[np.array(starts, np.int64) + j] = False
        return np.array(part, np.int64), np.flatnonzero(place)

    for batch in pieces(batches):
        for text in column_bytes(batch, "text"):
            starts.append(len(part))
            part += [units.end] * POSITIONS
            part += units.numbers(split_words(text))
            part.append(units.end)
            if len(part) > 1_000_000:
                yield take()
                part, starts = [], []
    if part:
        yield take()


def _neighbours(shared):
    """Counts of (word, kind of the word before it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, seed_of = shared.value
        total = np.zeros((units.end + 1) * SEEDS, np.int64)
        for a, at in _runs(batches, units):
            np.add(total, np.bincount(a[at] * SEEDS + seed_of[a[at - 1]], minlength=len(total)), out=total)
        yield _cells(total)

    return run


def _ngrams(shared):
    """Counts of class n-grams, then of (class before, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, class_of = shared.value
        grams = np.zeros(CLASSES ** (POSITIONS + 1), np.int64)
        words = np.zeros(CLASSES * (units.end + 1), np.int64)
        for a, at in _runs(batches, units):
            key, c = np.zeros(len(at), np.int64), class_of[a]
            for j in range(POSITIONS, -1, -1):
                key = key * CLASSES + c[at - j]
            np.add(grams, np.bincount(key, minlength=len(grams)), out=grams)
            np.add(words, np.bincount(c[at - 1] * (units.end + 1) + a[at], minlength=len(words)), out=words)
        yield _cells(np.concatenate([grams, words]))

    return run


def _gathered(docs: DataFrame, function, size: int) -> np.ndarray:
    """The sums of all tasks' counts; ``size``, which bounds what reaches the driver, doesn't depend on the corpus."""
    found = docs.select("text").transform(small_batches).mapInArrow(function, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


def seeds(units: Units) -> np.ndarray:
    """The kind of each unit as a neighbour: the most frequent words by themselves, others by their ending, the end of a text."""
    kinds = SEEDS // 4
    own = SEEDS - kinds - 1
    of = np.empty(units.end + 1, np.int64)
    for word, k in units.index.items():
        of[k] = 1 + kinds + k if k < own else 1 + ending(word) % kinds
    of[len(units.index) : units.end] = 1 + np.arange(ENDINGS) % kinds
    of[units.end] = 0
    return of


def cluster(counts: np.ndarray, groups: int, rounds: int = 12) -> np.ndarray:
    """A group for each row of a count matrix: k-means on rows of log ratios to the columns' shares, weighted by the rows' sums.

    The first centres are rows spread evenly over the total count, so the
    result depends on the counts alone.
    """
    weight = counts.sum(axis=1).astype(np.float64)
    if not weight.any():
        return np.zeros(len(counts), np.int64)
    column = counts.sum(axis=0) / weight.sum()
    # a prior of a few counts by the columns' shares tames rare rows
    ratio = np.log((counts + 4 * column + 1e-9) / ((weight[:, None] + 4) * column + 1e-9)) * np.sqrt(column)
    order = np.argsort(-weight, kind="stable")
    ahead = np.cumsum(weight[order])
    picks = np.searchsorted(ahead, (np.arange(groups) + 0.5) * ahead[-1] / groups)
    picks = np.unique(np.concatenate([np.unique(picks), np.arange(min(groups, len(order)))]))[:groups] if len(np.unique(picks)) < groups else picks
    centre = ratio[order[picks]]
    for _ in range(rounds):
        group = (-2 * ratio @ centre.T + (centre**2).sum(axis=1)).argmin(axis=1)
        total = np.bincount(group, weight, len(centre))
        for c in np.flatnonzero(total > 0):
            mine = group == c
            centre[c] = weight[mine] @ ratio[mine] / total[c]
    return group


def classes(units: Units, neighbours: np.ndarray) -> np.ndarray:
    """The class of each unit: 0 the end, then those of endings, then those of words."""
    v = len(units.index)
    of = np.zeros(units.end + 1, np.int64)
    of[v : units.end] = 1 + cluster(neighbours[v : units.end], TAIL_CLASSES)
    if v:
        of[:v] = 1 + TAIL_CLASSES + cluster(neighbours[:v], WORD_CLASSES)
    return of


@dataclass(frozen=True)
class LogBilinear:
    """Vectors of contexts, a combination matrix per position, vectors and biases of outcomes."""

    context: np.ndarray
    combine: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    def scores(self, contexts: np.ndarray) -> np.ndarray:
        """Scores of all outcomes, one row per context (a number for each position)."""
        seen = sum(self.context[contexts[:, j]] @ self.combine[j] for j in range(contexts.shape[1]))
        return seen @ self.target.T + self.bias

    def log_probabilities(self, contexts: np.ndarray) -> np.ndarray:
        """log P(outcome | context); each row's probabilities add up to 1."""
        return log_normalised(self.scores(contexts), np.zeros(1, np.int64))


def log_normalised(score: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Scores less the logarithm of their sum of exponentials within each run of columns that begins at ``starts``."""
    sizes = np.diff(np.append(starts, score.shape[1]))
    score = score - np.repeat(np.maximum.reduceat(score, starts, axis=1), sizes, axis=1)
    return score - np.repeat(np.log(np.add.reduceat(np.exp(score), starts, axis=1)), sizes, axis=1)


def train_nce(counts: np.ndarray, contexts: np.ndarray, starts: np.ndarray | None = None, steps: int = STEPS, dimension: int = DIMENSION, noise: int = NOISE_SAMPLES, seed: int = 5) -> LogBilinear:
    """Fit by Adam on the noise-contrastive objective in expectation over ``counts`` (contexts x outcomes).

    ``contexts``: each row's context, a number for each position.  Noise is the
    outcomes' own share, within each run of columns that begins at ``starts``.
    A normal prior of variance one holds back vectors with few counts.
    """
    rng = np.random.default_rng(seed)
    total = max(counts.sum(), 1)
    starts = np.zeros(1, np.int64) if starts is None else starts
    sizes = np.diff(np.append(starts, counts.shape[1]))
    own = counts.sum(axis=0) + 0.5
    unigram = own / np.repeat(np.add.reduceat(own, starts), sizes)
    share = (counts / total).astype(np.float32)
    # noise is drawn for each token of a context within the run of the token
    noise_share = (noise * np.repeat(np.add.reduceat(counts, starts, axis=1) / total, sizes, axis=1) * unigram).astype(np.float32)
    log_noise = np.log(noise * unigram).astype(np.float32)
    positions, units = contexts.shape[1], int(contexts.max()) + 1
    p = {
        "context": rng.normal(0, 0.3, (units, dimension)).astype(np.float32),
        "combine": np.stack([np.eye(dimension, dtype=np.float32) / positions] * positions),
        "target": np.zeros((counts.shape[1], dimension), np.float32),
        "bias": np.log(unigram).astype(np.float32),
    }
    prior = {"context": 1 / total, "combine": 0.0, "target": 1 / total, "bias": 0.0}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    blocks = np.array_split(np.flatnonzero(counts.any(axis=1)), max(1, counts.size // 1_000_000))
    picked = [[(np.unique(contexts[b, j], return_inverse=True)) for j in range(positions)] for b in blocks]
    del counts
    for t in range(1, steps + 1):
        grads = {k: -np.float32(prior[k]) * v for k, v in p.items()}
        for b, parts in zip(blocks, picked, strict=True):
            if not len(b):
                continue
            at = contexts[b]
            seen = sum(p["context"][at[:, j]] @ p["combine"][j] for j in range(positions))
            data = seen @ p["target"].T
            data += p["bias"] - log_noise
            np.clip(data, -30, 30, out=data)
            np.negative(data, out=data)
            np.exp(data, out=data)
            data += 1
            np.reciprocal(data, out=data)
            # ascent direction: data pairs pull up, noise pairs push down
            g = share[b] * (1 - data)
            g -= noise_share[b] * data
            back = g @ p["target"]
            grads["target"] += g.T @ seen
            grads["bias"] += g.sum(axis=0)
            for j, (names, place) in enumerate(parts):
                grads["combine"][j] += p["context"][at[:, j]].T @ back
                order = np.argsort(place, kind="stable")
                first = np.searchsorted(place[order], np.arange(len(names)))
                grads["context"][names] += np.add.reduceat((back @ p["combine"][j].T)[order], first, axis=0)
        rate = 0.03 * min(1.0, 2 * (1 - (t - 1) / steps))
        for k, grad in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * grad
            s[k] = 0.99 * s[k] + 0.01 * grad * grad
            p[k] = p[k] + rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-10)
    return LogBilinear(**p)


@dataclass(frozen=True)
class Model:
    """Tables of log10 probabilities: ``next_class`` (class n-grams), ``next_word`` (class before x vocabulary word, within its class), and
    ``tail`` (log10 of tokens + words + 1 of each class of endings)."""

    units: Units
    class_of: np.ndarray
    next_class: np.ndarray
    next_word: np.ndarray
    tail: np.ndarray

    def log10_tokens(self, words: list[bytes], log_count: np.ndarray) -> np.ndarray:
        """log10 P of each token of a text and of its end; ``log_count``: log10(c + 1) of each."""
        a = np.array([self.units.end] * POSITIONS + self.units.numbers(words) + [self.units.end], np.int64)
        c = self.class_of[a]
        key = np.zeros(len(a) - POSITIONS, np.int64)
        for j in range(POSITIONS + 1):
            key = key * CLASSES + c[j : j + len(key)]
        out = self.next_class[key].astype(np.float64)
        now, before = a[POSITIONS:], c[POSITIONS - 1 : -1]
        known = now < len(self.units.index)
        out[known] += self.next_word[before[known], now[known]]
        rare = ~known & (now != self.units.end)
        out[rare] += log_count[rare] - self.tail[c[POSITIONS:][rare]]
        return out


def fit(units: Units, class_of: np.ndarray, grams: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(next_class, next_word) of ``Model`` from counts of class n-grams and of (class before, unit)."""
    rows = CLASSES**POSITIONS
    every = np.stack(np.unravel_index(np.arange(rows), (CLASSES,) * POSITIONS), axis=1)
    first = train_nce(grams.reshape(rows, CLASSES), every)
    first.bias[np.bincount(class_of, minlength=CLASSES) == 0] = -1e9  # no word could follow
    next_class = np.concatenate([first.log_probabilities(b) for b in np.array_split(every, 16)]).astype(np.float32).ravel() / np.float32(np.log(10))
    v = len(units.index)
    next_word = np.zeros((CLASSES, v), np.float32)
    if v:
        order = np.argsort(class_of[:v], kind="stable")
        ordered = class_of[:v][order]
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        before = np.arange(CLASSES)[:, None]
        second = train_nce(words[:, :v][:, order], before, starts, WORD_STEPS, WORD_DIMENSION)
        next_word[:, order] = log_normalised(second.scores(before), starts) / np.log(10)
    return next_class, next_word


def _score(held, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, log_count = held.value
        model = shared.value
        find = index.get
        names = ["doc_id", "n_tokens", "n_held", "base", "score", "rare", "times"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
        for batch in pieces(batches):
            rows, size = [], 0
            for i, text in zip(batch.column("doc_id").to_pylist(), column_bytes(batch, "text"), strict=True):
                words = split_words(text)
                at = np.array([find(w, -1) for w in words] + [len(index) - 1], np.int64)
                known = at >= 0
                logs = np.where(known, log_count[at], 0.0)
                # the counts of words that aren't held are joined later, to base and score alike
                rare = Counter(words[j] for j in np.flatnonzero(~known).tolist())
                score = float(model.log10_tokens(words, logs).sum())
                rows.append((i, len(at), int(known.sum()), float(logs.sum()), score, list(rare), list(rare.values())))
                size += len(rare)
                if size > 400_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return run


def _tail_totals(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, class_of = shared.value
        total = np.zeros((2, CLASSES), np.int64)
        for batch in batches:
            words = batch.column("word").to_pylist()
            at = np.array(units.numbers(words), np.int64)
            rare = (at >= len(units.index)) & (np.array(words, object) != END)
            for k, values in enumerate((batch.column("c").to_numpy()[rare], None)):
                total[k] += np.bincount(class_of[at[rare]], values, CLASSES).astype(np.int64)
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[0][at]), pa.array(total[1][at])], ["kind", "tokens", "words"])

    return run


def _most_frequent(counts: DataFrame) -> tuple[list[bytes], np.ndarray, int]:
    """Words from some frequency on, ``HELD_WORDS`` at most, most frequent first; their counts; the count of ends.

    The frequency is found on a coarse logarithmic scale, whose few values are
    all that is sorted on the driver.
    """
    scale = F.floor(F.log2("c") * 32)
    sizes = counts.groupBy(scale.alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("s")).collect()
    least, held = None, 0
    for row in sizes:
        held += row["n"]
        if held > HELD_WORDS:
            break
        least = row["s"]
    ends = counts.filter(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    if least is None:
        return [], np.zeros(0), ends
    found = counts.filter(scale >= least).toArrow()
    pairs = sorted(zip(found["word"].to_pylist(), found["c"].to_pylist(), strict=True), key=lambda p: (-p[1], p[0]))
    pairs = [p for p in pairs if p[0] != END]
    return [p[0] for p in pairs], np.array([p[1] for p in pairs], float), ends


def train(training: DataFrame, counts: DataFrame) -> tuple[Model, dict[bytes, int], np.ndarray, int]:
    """The model of ``training`` (text) with its ``word_counts``; the held words' places, the logarithms of their counts, the count of ends."""
    broadcast = training.sparkSession.sparkContext.broadcast
    # HELD_WORDS bounds what reaches the driver and every task.
    words, times, ends = _most_frequent(counts)
    units = Units({w: k for k, w in enumerate(words[: min(VOCABULARY, int((times >= MIN_COUNT).sum()))])})

    seed_of = broadcast((units, seeds(units)))
    neighbours = _gathered(training, _neighbours(seed_of), (units.end + 1) * SEEDS).reshape(-1, SEEDS)
    class_of = classes(units, neighbours)
    del neighbours
    dealt = broadcast((units, class_of))
    n_grams = CLASSES ** (POSITIONS + 1)
    found = _gathered(training, _ngrams(dealt), n_grams + CLASSES * (units.end + 1))
    next_class, next_word = fit(units, class_of, found[:n_grams], found[n_grams:].reshape(CLASSES, -1))
    del found

    tails = counts.mapInArrow(_tail_totals(dealt), "kind int, tokens long, words long").groupBy("kind").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).toArrow()
    tail = np.zeros(CLASSES)
    tail[tails["kind"].to_numpy()] = np.log10(tails["tokens"].to_numpy() + tails["words"].to_numpy() + 1.0)

    index = {w: k for k, w in enumerate([*words, END])}
    log_count = np.log10(np.append(times, float(ends)) + 1)
    return Model(units, class_of, next_class, next_word, tail), index, log_count, ends


def language_model_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    Scores are log10 probabilities of the whole text with its end.  Null and
    empty texts are the end alone.  Repeated rows count again in training and
    are each returned; rows without doc_id count by the empty id.  An empty
    table gives no rows; without training rows every word is unseen.  Other
    columns are ignored.
    """
    spark = docs.sparkSession
    broadcast = spark.sparkContext.broadcast
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held_out = id_crc_mod(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]
    training = slim.filter(~held_out)

    counts = materialize(word_counts(training), "counts")
    total, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    model, index, log_count, ends = train(training, counts)
    scored = slim.transform(small_batches).mapInArrow(
        _score(broadcast((index, log_count)), broadcast(model)),
        "doc_id long, n_tokens long, n_held long, base double, score double, rare array<binary>, times array<int>",
    )
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.inline(F.arrays_zip("rare", "times"))).withColumnsRenamed({"rare": "word"})
    joined = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("logs"))
    logs = F.coalesce("logs", F.lit(0.0))
    per_token = F.log10(F.lit(float(total + vocabulary + 1)))
    no_end = F.when(F.lit(ends == 0), 1).otherwise(0)
    return scored.select("row", "doc_id", "n_tokens", "n_held", "base", "score").join(joined, "row", "left").select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("n_held") - no_end + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )

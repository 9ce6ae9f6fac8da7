"""MinHash near-duplicates by an inverted join on signature coordinates.

1. One pass over the texts gives every document the digest of its shingle set
   and a signature of ``COORDINATES`` minima.  Documents with equal sets form
   one class at once (an aggregation with map-side combine), so copies never
   meet in pairs.
2. Classes are posted under coordinate-value pairs.  Two sets that agree in at
   least ``MATCHES`` coordinates share one of any ``COORDINATES - MATCHES + 1``
   coordinates when these are chosen by one global order, so only that prefix
   is posted.  The order puts rare values first; its frequencies come from a
   sketch of fixed size, and any frequencies give whole results.  The other
   coordinates are skipped: collisions are counted on the two signatures.
3. In each posting list the members are paired with the list's leaders, short
   lists fully.  A leader is the member that meets the most others over all its
   lists, so the lists of one group of near copies name the same few leaders.
   The members of a longer list that then still lie outside its largest
   component are paired with leaders of that component.
4. Where the members of a longer list even then lie in more than one component,
   those members are joined again on their full shingle sets: each posts its
   rarest shingles, just so many that two sets similar enough share one, and
   pairs whose places of the shared shingle leave too little room for the needed
   overlap are dropped.  Pairs within one component are not formed, so neither a
   large group of near copies nor a passage that many documents share is
   expanded, and no list is cut short.
5. Pairs that reach ``MATCHES`` are confirmed on the full shingle sets, with
   integers: 100 * common >= percent * union.

A pair at similarity 0.75 fails step 2 with probability below 2.9e-6 (at most
16 of 40 coordinates agree).  In long lists a pair at 0.75 is also lost if its
2,048-bit sketches differ in more bits than ``_most_bits`` allows, with
probability below 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, column_bytes, discard, materialize, mix64, pieces, shingle_hashes, small_batches, split_words
from .components import connected_components

COORDINATES = 40
MATCHES = 17
PREFIX = COORDINATES - MATCHES + 1
SKETCH_BITS = 18
SHORT_LIST = 24
#: Leaders of a list in the first pass, and of its largest component in the second.
LEADERS, MORE_LEADERS = 2, 4
#: Bits of the sketch that the members of long lists get.
SKETCH_PLACES = 2_048

_RNG = np.random.default_rng(7)
_XOR = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minima (documents x COORDINATES, uint32) of the shingle runs that begin at ``starts``."""
    out = np.empty((len(starts), COORDINATES), np.uint32)
    with np.errstate(over="ignore"):
        for j in range(COORDINATES):
            out[:, j] = np.minimum.reduceat(((hashes ^ _XOR[j]) * _MUL[j]) >> np.uint64(32), starts)
    return out


def _sign(width: int, chunk: int = 500_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()

        def emit(ids, sets):
            runs = [s for s in sets if len(s)]
            signs = iter(())
            if runs:
                starts = np.cumsum([0, *(len(s) for s in runs[:-1])])
                signs = iter(signature(np.concatenate(runs), starts).view(np.int32).tolist())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(signs) if len(s) else None for s in sets], pa.list_(pa.int32())),
                ],
                ["doc_id", "n_shingles", "digest", "sig"],
            )

        for batch in pieces(batches):
            ids, sets, size = [], [], 0
            for i, text in zip(batch.column("doc_id").to_pylist(), column_bytes(batch, "text"), strict=True):
                ids.append(i)
                sets.append(np.unique(shingle_hashes(split_words(text), known, width)))
                size += len(sets[-1])
                if size > chunk:
                    yield emit(ids, sets)
                    ids, sets, size = [], [], 0
            if ids:
                yield emit(ids, sets)

    return run


def _keys(signs: np.ndarray) -> np.ndarray:
    """One 64-bit key per coordinate-value pair."""
    return mix64(signs.astype(np.uint64) | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)))


def _signs_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("sig").values.to_numpy(zero_copy_only=False).view(np.uint32).reshape(-1, COORDINATES)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        if batch.num_rows:
            cells = (_keys(_signs_of(batch)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            total += np.bincount(cells.ravel(), minlength=len(total))
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells], pa.int64())], ["cell", "n"])


def _post(frequency):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequency.value
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _keys(_signs_of(batch))
            seen = often[(keys >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            order = np.lexsort((keys, seen), axis=1)[:, :PREFIX]
            chosen = np.take_along_axis(keys, order, axis=1).view(np.int64)
            nodes = np.repeat(batch.column("node").to_numpy(), PREFIX)
            yield pa.RecordBatch.from_arrays([pa.array(chosen.ravel()), pa.array(nodes)], ["key", "node"])

    return run


def _pack(width: int):
    """Keep the packed text of rows whose shingle set has the wanted digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pack = WordHashes(), zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches):
            nodes, texts = [], []
            for node, digest, text in zip(batch.column("node").to_pylist(), batch.column("digest").to_pylist(), column_bytes(batch, "text"), strict=True):
                words = split_words(text)
                if xxhash.xxh3_128_digest(np.unique(shingle_hashes(words, known, width)).tobytes()) == digest:
                    nodes.append(node)
                    texts.append(pack.compress(b" ".join(words)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(texts, pa.binary())], ["node", "packed"])

    return run


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, unpack = WordHashes(), zstandard.ZstdDecompressor()
        last, last_set = None, None

        def whole_set(packed):
            return np.unique(shingle_hashes(unpack.decompress(packed).split(), known, width))

        for batch in pieces(batches):
            a, b, keep = batch.column("a"), batch.column("b"), []
            for x, px, py in zip(a.to_pylist(), batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), strict=True):
                if x != last:
                    last, last_set = x, whole_set(px)
                other = whole_set(py)
                common = len(np.intersect1d(last_set, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(last_set) + len(other) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return run


def sign_documents(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, digest, sig) per row; digest and sig null without words."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(small_batches).mapInArrow(
        _sign(width), "doc_id long, n_shingles long, digest binary, sig array<int>"
    )


def post_prefixes(classes: DataFrame) -> DataFrame:
    """(key, node): each class under its rarest ``PREFIX`` coordinate-value pairs."""
    spark = classes.sparkSession
    cells = classes.select("sig").mapInArrow(_sketch, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(1 << SKETCH_BITS, np.int64)
    often[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return classes.select("node", "sig").mapInArrow(_post(spark.sparkContext.broadcast(often)), "key long, node long")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _met(postings: DataFrame) -> DataFrame:
    """(key, node, n, weight): postings of lists with several members.

    ``n`` is the list's length, ``weight`` the sum of the lengths of all lists
    of the node: how often it meets another document.
    """
    lists = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = materialize(postings.join(lists, "key"), "met")
    weighted = materialize(met.join(met.groupBy("node").agg(F.sum("n").alias("weight")), "node").select("key", "node", "n", "weight"), "weighted")
    discard(met)
    return weighted


def _leaders(members: DataFrame, by: list[str], count: int) -> DataFrame:
    """The heaviest member in each of ``count`` fixed parts of every group ``by``.

    Only maxima are aggregated, so a list of any length is combined map-side.
    """
    part = F.pmod(F.xxhash64("node"), F.lit(count)).alias("part")
    heaviest = F.max_by("node", F.struct("weight", "node")).alias("leader")
    return members.groupBy(*by, part).agg(heaviest).drop("part")


def _leader_pairs(met: DataFrame) -> DataFrame:
    """Members with their list's leaders; short lists in full."""
    star = met.join(_leaders(met, ["key"], LEADERS), "key").filter("node <> leader").select(*_ordered("node", "leader"))
    short = met.filter(F.col("n").between(3, SHORT_LIST)).select("key", "node")
    full = short.alias("x").join(short.alias("y"), "key").filter("x.node < y.node").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    return star.unionAll(full).distinct()


def _main_pairs(split: DataFrame) -> DataFrame:
    """Members of split lists outside the list's largest component, with its leaders.

    ``split`` has (key, node, label, weight).
    """
    parts = split.groupBy("key", "label").agg(F.count("*").alias("c"))
    main = parts.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    sided = split.join(main, "key")
    leaders = _leaders(sided.filter("label = main"), ["key"], MORE_LEADERS)
    return sided.filter("label <> main").join(leaders, "key").select(*_ordered("node", "leader")).distinct()


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in ``MATCHES`` coordinates at least."""
    signs = classes.select("node", "sig")
    same = F.aggregate(F.zip_with("sa", "sb", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, x: s + x)
    return (
        pairs.join(signs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
        .join(signs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
        .filter(same >= MATCHES)
        .select("a", "b")
    )


def _packed(nodes: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, packed): the words of one document of each class in ``nodes``."""
    wanted = classes.join(nodes.select("node").distinct(), "node").select("node", "digest", "cid")
    texts = docs.select(F.col("doc_id").cast("long").alias("cid"), F.col("text").cast("string").alias("text")).join(wanted, "cid")
    return materialize(texts.select("node", "digest", "text").transform(small_batches).mapInArrow(_pack(width), "node long, packed binary").dropDuplicates(["node"]), "packed")


def _confirmed(pairs: DataFrame, packed: DataFrame, width: int, percent: int) -> DataFrame:
    """Links among ``pairs``, by the full sets of one document of each class."""
    both = pairs.join(packed.select(F.col("node").alias("b"), F.col("packed").alias("pb")), "b").join(packed.select(F.col("node").alias("a"), F.col("packed").alias("pa")), "a")
    return both.select("a", "b", "pa", "pb").transform(small_batches).mapInArrow(_confirm(width, percent), "a long, b long")


def _shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, unpack = WordHashes(), zstandard.ZstdDecompressor()
        for batch in pieces(batches):
            for node, packed in zip(batch.column("node").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                own = np.unique(shingle_hashes(unpack.decompress(packed).split(), known, width)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), node, np.int64)), pa.array(np.full(len(own), len(own), np.int64)), pa.array(own)], ["node", "n", "shingle"])

    return run


def _bits(width: int):
    """One bit of each of ``SKETCH_PLACES`` minima of the shingle set, as 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, unpack = WordHashes(), zstandard.ZstdDecompressor()
        places = np.random.default_rng(13).integers(0, 2**63, (2, SKETCH_PLACES), dtype=np.uint64)
        multiply = places[1] * np.uint64(2) + np.uint64(1)
        for batch in pieces(batches):
            nodes, out = [], []
            for node, packed in zip(batch.column("node").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                own = np.unique(shingle_hashes(unpack.decompress(packed).split(), known, width))
                least = np.full(SKETCH_PLACES, np.iinfo(np.uint64).max, np.uint64)
                with np.errstate(over="ignore"):
                    for part in np.array_split(own, len(own) // 2_000 + 1):
                        if len(part):
                            least = np.minimum(least, ((part[:, None] ^ places[0]) * multiply).min(axis=0))
                nodes.append(node)
                out.append(np.packbits((mix64(least) & np.uint64(1)).astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["node", "bits"])

    return run


def _most_bits(percent: int) -> int:
    """Differing sketch bits that a pair at the threshold stays under but for five standard deviations."""
    p = (100 - percent) / 200
    return int(SKETCH_PLACES * p + 5 * (SKETCH_PLACES * p * (1 - p)) ** 0.5) + 1


def _apart_pairs(apart: DataFrame, packed: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs of ``apart`` (node, label) in different components that may be similar enough.

    Prefix filter on the full sets: with the rarest shingles first, sets at the
    threshold share one of the first n - ceil(n * percent / 100) + 1.  At the
    first shared one, the places left bound the overlap from above.  This leaves
    none out; the sketches, compared at last, may lose a pair as ``_most_bits`` says.
    """
    rows = materialize(packed.transform(small_batches).mapInArrow(_shingles(width), "node long, n long, shingle long"), "shingles")
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle")) - 1
    first = rows.join(often, "shingle").withColumn("place", place).filter((F.col("n") - F.col("place")) * 100 >= F.col("n") * percent).filter("often > 1")
    known = materialize(apart.join(packed.transform(small_batches).mapInArrow(_bits(width), "node long, bits array<long>"), "node"), "bits")
    posted = materialize(first.join(known, "node").select("shingle", "node", "label", "n", "place", "bits"), "posted")
    main = posted.groupBy("shingle", "label").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("parts"))
    met = materialize(posted.join(main.filter("parts > 1").select("shingle", "main"), "shingle"), "met")
    x, y = met.filter("label <> main").alias("x"), met.alias("y")
    room = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    differ = F.aggregate(F.zip_with("x.bits", "y.bits", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    near = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") != F.col("y.label")) & (room * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent) & (differ <= _most_bits(percent))
    return x.join(y, near).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _split_lists(met: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label, weight): the long lists whose members lie in several components."""
    members = met.filter(F.col("n") > SHORT_LIST).join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"), "weight")
    split = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    return members.join(split, "key")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further ``links``."""
    if links.isEmpty():
        return labels
    return connected_components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionAll(links))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text).

    Null or wordless texts have no shingles, are linked with nothing and are
    their own component.  Under ``width`` words the sequence is one shingle.
    Rows that repeat a doc_id are documents of their own when their sets
    differ; equal rows share a class, and each is returned.  Rows without
    doc_id can't represent a class: alone they have no component (null) and
    are kept.  Other columns are ignored.  An empty table gives no rows.
    """
    signed = materialize(sign_documents(docs, width), "signed")
    classes = materialize(
        signed.filter("n_shingles > 0")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("cid"), F.first("sig").alias("sig"))
        .filter("cid is not null")
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    postings = materialize(post_prefixes(classes), "postings")
    met = _met(postings)
    discard(postings)
    tested = materialize(_agreeing(_leader_pairs(met), classes), "pairs")
    ends = tested.select(F.col("a").alias("node")).unionAll(tested.select(F.col("b").alias("node")))
    texts = _packed(ends, classes, docs, width)
    links = materialize(_confirmed(tested, texts, width, percent), "confirmed")
    discard(texts)
    labels = connected_components(links)

    split = materialize(_split_lists(met, labels), "split")
    if not split.isEmpty():
        packed = _packed(split, classes, docs, width)
        second = materialize(_agreeing(_main_pairs(split).join(tested, ["a", "b"], "left_anti"), classes), "pairs")
        labels = _joined(labels, materialize(_confirmed(second, packed, width, percent), "confirmed"))
        apart = materialize(_split_lists(met, labels).select("node", "label").distinct(), "apart")
        if not apart.isEmpty():
            rest = packed.join(apart.select("node"), "node", "left_semi")
            third = materialize(_apart_pairs(apart, rest, width, percent).join(tested.unionAll(second), ["a", "b"], "left_anti"), "pairs")
            labels = _joined(labels, materialize(_confirmed(third, rest, width, percent), "confirmed"))
        discard(packed)

    discard(met)
    named = classes.join(labels, "node", "left").select("digest", "cid", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("cid").alias("component_id"))
    of_class = named.join(least, "label").select("digest", "component_id")
    out = signed.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns, without those that copy another of smaller doc_id.

    Rows that repeat a doc_id are one document here: they stay if one of them
    represents its group.  Rows without doc_id stay.
    """
    gone = near_duplicates(docs, width, percent).groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")

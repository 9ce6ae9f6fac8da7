"""Connected components by alternating stars, wholly on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(links: DataFrame) -> DataFrame:
    """One round: each node's neighbours are hung on its smallest neighbour.

    ``links`` has rows (hi, lo) with hi > lo.  Large star, then small star;
    only minima per node are aggregated (combined map-side), neighbour lists
    are never gathered, so a hub of any degree is spread over many tasks.
    """
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi > lo").distinct()
    down = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(down, "hi").select("lo", "m").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return small.unionAll(down.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``links``; label: the component's smallest node.

    Null ends and self links are ignored, repeated links count once.  The
    number of rounds grows with the logarithm of the longest chain.
    """
    current = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    current = materialize(current, "links")
    seen = None
    while True:
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen, old = mark, current
        current = materialize(_star(old), "links")
        discard(old)
    labels = current.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    return labels.unionAll(current.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())

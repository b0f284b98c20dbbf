"""Connected components by alternating large-star and small-star steps.

Every step is an aggregate (partial sums before the shuffle) and one equality join; a node with a huge number of links is an
ordinary skewed key, never a collected list. Each round's links are written to the shared folder, so plans stay short and lost
executors cost no more than the round. Links never outnumber those given."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``links`` (a, b); links to itself count as none."""
    links = materialize(links.select("a", "b").filter("a <> b").distinct(), "links")
    state = _state(links)
    while True:
        links = materialize(_small_star(_large_star(links)), "links")
        after = _state(links)
        if after == state:
            break
        state = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()

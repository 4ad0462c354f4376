"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node now links to the smallest of the node and its neighbours."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours now link to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) for the nodes of links (a, b: of one orderable type).

    Minima are taken by an aggregate, so a node with very many neighbours is combined before the
    shuffle, and each round is written to the shared folder and the one before deleted. Rounds grow with the logarithm of the
    longest chain. Links from a node to itself and repeated links are allowed; nodes that occur
    only in links to themselves are absent from the result.
    """
    state = links.select("a", "b").where("a <> b")
    seen = before = None
    while True:
        state = written(_small(_large(state)))
        if before is not None:
            forget(before)
        before = state
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not now[0] or now == seen:
            break
        seen = now
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)

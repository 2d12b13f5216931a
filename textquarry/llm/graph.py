"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import materialize, release

#: Rounds double the reach of a label at least; more than this means a fault.
MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node reachable.

    Large-star and small-star rounds (Kiveris and others, 2014). Neighbours are
    never listed: a node's smallest neighbour is an aggregate, joined back to its
    links, and the join of a hot node can be split.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "graph-links")
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: neighbours above a node go to the smallest around it.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of these.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        after = materialize(small.where("u <> v").distinct(), "graph-round")
        settled = _fingerprint(after) == _fingerprint(edges)
        release(edges)
        edges = after
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    # Settled: every link goes from a node to the root of its star.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(h, F.lit(1_000_003))), F.bit_xor(h)).first())

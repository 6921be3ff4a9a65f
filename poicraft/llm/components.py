"""Connected components of a graph that no task and no driver holds whole.

Alternating large-star and small-star steps (Kiveris et al., 2014). Each step
rewrites the edges so that they point to smaller nodes; after a few rounds every
component is a star around its smallest node. Every round is written to the
shared folder, so neither the plan nor the recovery of a lost executor grows
with the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poicraft.llm.common import stored

#: The rounds grow with the logarithm of the longest path; more than this is an error.
MAX_ROUNDS = 60


def _smallest(links: DataFrame, name: str) -> DataFrame:
    """``u, m``: the smallest of each node and its neighbours. Stored, so the join
    that reads it has two shuffled sides and a node with very many links is split."""
    return stored(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)`` that isn't its component's smallest.

    Nodes are integers; loops and repeated edges are allowed; null ends are dropped.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), "a", "b")
    links = stored(pairs.filter("a is not null and b is not null and u > v").select("u", "v").distinct(), "links")
    mark = None
    for _ in range(MAX_ROUNDS):
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both, "large"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "large-links")
        least = _smallest(large, "small")
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"),
                              F.expr("sum(cast(u as decimal(38,0)) - v)")).first())
        if now == mark:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError(f"components have not settled in {MAX_ROUNDS} rounds")

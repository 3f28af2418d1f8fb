"""Connected components of an edge table by alternating large and small stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): every
round is two group-by-minimum steps and joins on the node, so a node with a
third of all edges is an ordinary skewed join key, and the number of rounds
grows with the logarithm of the number of nodes.  Nothing but the two numbers
that tell whether a round changed anything reaches the driver; every round is
written to the shared folder, so a lost executor costs no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abuse_lens.plans.settle import files_for, settle


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) and the smallest of u and all its neighbours v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge already points from the larger to the smaller node
    # both are hooked to the smallest, in one pass; where v is the smallest itself, its edge is a loop
    ends = F.explode(F.array("u", "v")).alias("u")
    return _star(edges).select(ends, F.col("m").alias("v"))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x or 0


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Null ends, loops, repeated and reversed edges are allowed and change nothing;
    a node whose only edges are loops is not returned.  No edges: no rows.
    """
    edges = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    edges = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        starred = _large_star(edges).where("u <> v").distinct()
        edges = settle(_small_star(starred).where("u <> v").distinct(), files_for(state[0]))
        before, state = state, _state(edges)
        if state == before:
            break
    # now every edge runs from a node to the smallest node of its component
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

"""Connected components by randomised contraction.

Each round every node moves to the neighbour (or itself) that a fresh hash
ranks first, and the edges are rewritten to where their ends went; the number
of nodes that still have edges shrinks by a constant factor in expectation,
whatever the shape of the graph.  Neighbourhoods are never gathered: a round
is one minimum per node (summed up before the shuffle) and joins against a
table with one row a node, so a node with very many edges does no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): nodes have equal roots if and only if a path joins them.

    Edges from a node to itself do not count.  Written to the checkpoint folder
    once a round, so a lost executor costs one round at most.
    """
    tidy = lambda e: e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, moves = cut(tidy(edges)), []
    while not left.isEmpty():
        rank = lambda c, r=len(moves): F.struct(F.xxhash64(F.lit(r), c).alias("h"), F.col(c).alias("to"))
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("near"))
        moved = cut(best.select(F.col("a").alias("node"), F.least(F.col("near"), rank("a"))["to"].alias("to")))
        moves.append(moved)
        ends = lambda c: moved.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}"))  # noqa: B023, E731
        left = cut(tidy(left.join(ends("a"), "a").join(ends("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))))
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = moves[-1].select("node", F.col("to").alias("root"))
    for moved in reversed(moves[:-1]):
        later = found.select(F.col("node").alias("to"), "root")
        found = moved.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return found

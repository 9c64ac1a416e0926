"""Connected components of an edge table by repeated contraction.

In every round each node joins the neighbour (or itself) with the smallest random
rank; edges are redrawn between the joined nodes. A constant share of the nodes goes
each round, so the tables shrink geometrically and the rounds grow with the logarithm
of the longest chain. Minima combine before the shuffle, so a hub costs no more than
its edges; joins on a hub's key are split by adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.shared import kept


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; ``edges`` has long columns a, b.
    Nodes are in one component exactly when they share a root. Loops and repeated
    edges do no harm; an empty table gives no rows."""
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    left = kept(edges.where("a <> b").select(*pair).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        seed = F.lit(len(rounds))
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", seed).alias("rank"), "b")).alias("m"))
        own = F.struct(F.xxhash64("a", seed).alias("rank"), F.col("a").alias("b"))
        joined = kept(near.select(F.col("a").alias("node"), F.least("m", own)["b"].alias("root")), "joined")
        rounds.append(joined)
        new_a = joined.select(F.col("node").alias("a"), F.col("root").alias("new_a"))
        new_b = joined.select(F.col("node").alias("b"), F.col("root").alias("new_b"))
        redrawn = left.join(new_a, "a").join(new_b, "b").where("new_a <> new_b")
        redrawn = redrawn.select(F.col("new_a").alias("a"), F.col("new_b").alias("b"))
        left = kept(redrawn.select(*pair).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    roots = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        final = roots.select(F.col("node").alias("root"), F.col("root").alias("final"))
        roots = earlier.join(final, "root", "left").select("node", F.coalesce("final", "root").alias("root"))
    return roots

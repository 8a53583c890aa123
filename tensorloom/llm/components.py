"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import stored


#: Nodes with more than this share of all arcs are hubs; so there are at most as many as its inverse.
HUBS = 1000


def _stars(arcs: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """(b, m) for arcs (a, b) and the least neighbour m of each a, of least(a, m, n) with n arcs.

    The arcs of a hub stay where they are and meet its row by broadcast, so that no task gets them all.
    """
    edge = max(1, total // HUBS)
    # Written, as both ways read it; a node has one row.
    least = stored(least)
    hubs = F.broadcast(least.where(F.col("n") > edge).select("a", F.col("m").alias("hub")))
    marked = arcs.join(hubs, "a", "left")
    far = marked.where("hub IS NOT NULL").select(F.col("b").alias("a"), F.col("hub").alias("b"))
    near = marked.where("hub IS NULL").select("a", "b").join(least.where(F.col("n") <= edge).select("a", "m"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return far.unionByName(near).where("a != b").distinct()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the links (a, b): root is the smallest node it can reach.

    Each round points every neighbour above a node to the node's smallest neighbour, then does
    the same below it. Links stay in Spark and each round is a written table. Nodes without a
    link (or with links to themselves only) have no row; an empty table gives an empty result.
    """
    arcs = stored(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, total = None, arcs.count()
    for _ in range(most_rounds):
        if not total:
            break
        both = arcs.unionByName(arcs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = stored(_stars(both.where("b > a"), least, 2 * total))
        # Below each node: its smallest neighbour takes the node and the other neighbours.
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        own = large.select("a", F.col("a").alias("b")).distinct()
        arcs = stored(_stars(large.unionByName(own), least, total))
        total, digest = arcs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (total, digest) == before:
            break
        before = total, digest
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    roots = arcs.select(F.col("b").alias("node")).distinct()
    return arcs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))

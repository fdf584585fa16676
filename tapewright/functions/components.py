"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapewright.functions.durable import checkpoint

#: Ways in which the links of one node are dealt out.
SHARES = 8


def _dealt(links: DataFrame, node: str, by: str, least: DataFrame) -> DataFrame:
    """`links` whose `node` has a row (u, m) in `least`, with m: the links of a node are dealt out by `by`, its row goes to every share."""
    shares = least.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    own = links.withColumn("_share", F.pmod(F.xxhash64(by), F.lit(SHARES)).cast("int"))
    return own.join(shares, (own[node] == shares["u"]) & (own["_share"] == shares["_share"])).select("hi", "lo", "m")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every end of the links (a, b): comp is the smallest node it reaches. Null ends are no nodes.

    A link is kept as (hi, lo). The large star hangs the larger neighbours of a node on its smallest one, the small star the smaller
    neighbours and the node itself; alternating, they end in one star a component after a number of rounds that grows with the
    logarithm of its size. Smallest neighbours are found by min() with map-side combining. Only the links of nodes that still change
    are joined, dealt out in shares, so neither a node with a third of all links nor the center of a large star is in one task. Every
    step is written to shared storage.
    """
    ends = links.select(F.col("a"), F.col("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    both = checkpoint(ends.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    alone = both.filter("hi = lo").select(F.col("hi").alias("node"))
    edges = both.filter("hi > lo")
    while True:
        near = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"), F.lit(0).alias("below")).unionByName(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"), F.lit(1).alias("below")))
        least = checkpoint(near.groupBy("u").agg(F.min("v").alias("m"), F.sum("below").alias("below"), F.min("below").alias("leaf")))
        # A node is settled as a center (no smaller neighbour) or as a leaf of one (one smaller neighbour and no larger one).
        if least.filter("below > 1 OR (below = 1 AND leaf = 0)").isEmpty():
            break
        moved = least.filter("m < u AND leaf = 0").select("u", "m")
        hung = _dealt(edges, "lo", "hi", moved).select("hi", F.col("m").alias("lo"))
        kept = edges.join(moved.select(F.col("u").alias("lo")), "lo", "left_anti").select("hi", "lo")
        edges = checkpoint(hung.unionByName(kept).distinct())
        below = edges.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"), F.max("lo").alias("_most"))
        several = below.filter("_most > m").select("u", "m")
        lower = _dealt(edges, "hi", "lo", several).filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = checkpoint(below.select(F.col("u").alias("hi"), F.col("m").alias("lo")).unionByName(lower).distinct())
    stars = edges.select(F.col("hi").alias("node"), F.col("lo").alias("comp"))
    centers = edges.select(F.col("lo").alias("node")).unionByName(alone).distinct()
    single = centers.join(stars.select("node"), "node", "left_anti").select("node", F.col("node").alias("comp"))
    return checkpoint(stars.unionByName(single))

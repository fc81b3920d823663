"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import shuffles_removed


def _spread(df: DataFrame) -> DataFrame:
    """Deals rows anew, so that the join above shuffles both sides itself and can split a hot key at run time."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(_spread(least), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``a > b`` in every edge here."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(_spread(least), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _unfinished(edges: DataFrame) -> int:
    """How many nodes keep the edges from being stars: those with two centres, and centres that have one themselves."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    per_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    with shuffles_removed(edges.sparkSession):
        return per_node.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def connected_components(edges: DataFrame, checkpoint) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its least node.

    Self-links and repeated links are allowed, null ends are ignored, an empty
    table gives an empty result. Each round is one pair of star operations, cut
    off by ``checkpoint(df)``; rounds end when every edge leads from a node to
    its only centre. The number of rounds grows with the logarithm of the number
    of nodes, and only one number of a round reaches the driver.
    """
    clean = edges.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    given = checkpoint(clean.distinct())
    stars = given.filter("a <> b")
    while _unfinished(stars):
        stars = checkpoint(_small_star(_large_star(stars)))
    leaves = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    # a node with links to itself alone is in no star
    looped = given.filter("a = b").select(F.col("a").alias("node"))
    alone = looped.join(leaves.select("node").union(centres.select("node")), "node", "left_anti")
    return leaves.union(centres).union(alone.select("node", F.col("node").alias("component")))

"""Connected components of a link table, by alternating large and small stars.

Every round replaces links by links to smaller nodes; rounds end when nothing
changes, after about the logarithm of the longest chain.  Lineage is cut each
round by a checkpoint, so a lost executor costs one round at most.  A link table that fits in
one partition (:data:`.common.ROWS_A_TASK`) stays in it, and its rounds have no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gathered


def _both(links: DataFrame, first: str = "b", second: str = "a") -> DataFrame:
    """Each link, and ``a``, ``b`` of columns *first* and *second*; no union, which would have more partitions."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col(first).alias("a"), F.col(second).alias("b")))
    return links.select(F.explode(ways).alias("l")).select("l.a", "l.b")


def _large(links: DataFrame, sent=lambda df: df) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour or itself."""
    both = _both(links)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    return both.filter("b > a").join(sent(least), "a").select(F.col("b").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct()


def _small(links: DataFrame, sent=lambda df: df) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("root"))
    moved = links.join(sent(least), "a").select(F.col("b").alias("a"), F.col("root").alias("b"), F.col("a").alias("own"))
    return _both(moved, "own", "b").filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node that has a link.

    *links* has two columns of one orderable type; direction, repeats and links
    from a node to itself do not matter.  Nodes without a link are not returned.
    """
    a, b = links.columns[:2]
    pairs = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    pairs = gathered(cut(pairs))
    # Spark shuffles two tables of one partition to join them, but not for a broadcast
    alone = pairs.rdd.getNumPartitions() == 1
    sent = F.broadcast if alone else lambda df: df
    state = None
    while True:
        pairs = cut(_small(_large(pairs, sent), sent))
        pairs = pairs.coalesce(1) if alone else pairs
        # stars: every node on the left appears once and no root is itself linked on
        now = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if now == state or not now.n:
            break
        state = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select(F.col("b"), F.col("b")).distinct())

"""Connected components of a graph given as a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of every node are linked to the smallest node in its neighbourhood."""
    both = links.union(links.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them (``links`` point downwards)."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long) to (node, root): every linked node with the smallest node of its component.

    Groups are only reduced to their minimum (partly before the shuffle) and joined back, so that a node with very
    many links is split by adaptive execution. Every round is written to the shared folder. Nodes without links,
    null links and links of a node to itself give no rows; repeated links count once; no links give an empty table.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = written(links, "links"), None
    while True:
        links = written(_small_star(_large_star(links)), "links")
        now = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        ).first()
        if now == before:
            return links.toDF("node", "root")
        before = now

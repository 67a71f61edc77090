"""Connected components of a link table, by alternating large and small stars.

Each round is a grouping with partial aggregation and a join; a node with very many links is split by
the join, and nothing is gathered by node. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import stored


def _star(links: DataFrame) -> DataFrame:
    """Tie every neighbour of a node, and the node, to the smallest of them.

    ``links`` has (a, b). Rows are (a, b) with b the smaller one.
    """
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    tied = links.join(least, "a").select(
        F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")),
                          F.struct("a", F.col("least").alias("b")))).alias("x")
    )
    return tied.select("x.a", "x.b").filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node that it can reach."""
    edges = stored(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links"
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: only larger neighbours move, to the smallest of node and neighbours.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        edges = stored(_star(large), "links")
        # A row of sums stands for the whole table: when it stays, every tree is a star.
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))
        ).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now

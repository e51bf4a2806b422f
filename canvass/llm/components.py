"""Connected components of a link table, as joins and groupings alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import Scratch


def _least(links: DataFrame) -> DataFrame:
    """Beside each link a -> b the smallest of a and all that a links to."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return links.join(least, F.col("a") == F.col("u")).select("a", "b", "m")


def _starred(links: DataFrame) -> bool:
    """Whether every node that has a smaller neighbour has one alone, which has none."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    open_ = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1")
    return not open_.agg(F.count("*")).first()[0]


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of the
    table ``a, b``.  Rounds alternate between tying each node's larger
    neighbours and then its smaller ones to its smallest; the number of rounds
    grows with the logarithm of a component's size.  They end when all links are
    stars about smallest nodes.  Each round is a written table, and all that comes
    to the driver is a count."""
    now = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _starred(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A link yields one row here at most; rows that are alike meet in the next table.
        large = scratch.keep(_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"))
        near = _least(large)
        small = near.select("b", "m").unionByName(near.select(F.col("a").alias("b"), "m")).where("b <> m")
        after = scratch.keep(small.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        scratch.drop(now, large)
        now = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

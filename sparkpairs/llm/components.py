"""Connected components of an edge table, as joins and grouped minima.

Alternating stars: every node first hands its larger neighbours to its smallest
one (large star), then its smaller neighbours to the smallest of them (small
star), until every edge points at the smallest node of its component. Rounds
grow with the logarithm of the longest chain. Every round is checkpointed in
the shared folder; no links or components reach the driver. A node with very many neighbours is grouped by partial minima and joined
by a sort-merge join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkpairs.session import materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return (both.where("b > a").join(least, both["a"] == least["u"])
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    # edges point from the larger node a to the smaller node b
    least = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    handed = e.join(least, e["a"] == least["u"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.where("a != b").unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _unsettled(e: DataFrame) -> DataFrame:
    """Nodes that point at two others, or at one while being pointed at."""
    ends = e.select(F.col("a").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionAll(
        e.select(F.col("b").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    return (ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
            .where("child > 1 OR (child = 1 AND parent = 1)"))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) of every node with an edge ``a, b``.

    Nulls and loops are ignored; an empty edge table gives an empty result."""
    e = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e)
    while not _unsettled(e).isEmpty():  # else every edge points at the one root of its component
        e = materialize(_small_star(_large_star(e)))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
